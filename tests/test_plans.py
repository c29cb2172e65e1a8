"""What the physical plans must and must not contain."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from starmart.model import Star
from starmart.plans import build, dashboard, pairs
from starmart.sources.given import operational_tables
from tests.frames import plan_of, small_star, values

FOLDER = "/root/testdata/sf0.001"
QUERIES = queries()


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_no_python_and_no_cross_join(spark, key):
    plan = plan_of(QUERIES[key](spark, FOLDER))
    for node in ("Python", "Pandas", "ArrowEval", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan


@pytest.mark.parametrize(
    "key", ["top10_products", "top5_states_active", "slowest_cities", "norm_top_products"]
)
def test_top_k_is_not_a_full_sort(spark, key):
    assert "TakeOrderedAndProject" in plan_of(QUERIES[key](spark, FOLDER))


def test_scan_reads_only_what_is_asked(spark):
    plan = plan_of(QUERIES["kpi_revenue"](spark, FOLDER))
    assert "ReadSchema: struct<total_harga:decimal(12,2)>" in plan
    # Keys of this star are enforced and no dimension column is asked for.
    assert "Join" not in plan


def test_year_filter_selects_partitions(spark):
    plan = plan_of(QUERIES["sales_by_month"](spark, FOLDER))
    assert re.search(r"PartitionFilters: \[isnotnull\(tahun#\d+\), \(tahun#\d+ = 1997\)\]", plan)


def test_month_filter_selects_partitions(spark):
    found = lambda key: re.search(r"PartitionFilters: (\[[^\]]*\])", plan_of(QUERIES[key](spark, FOLDER))).group(1)
    assert re.search(r"bulan#\d+ = 5", found("sales_by_year"))
    assert re.search(r"bulan#\d+ = 5", found("sales_by_day")) and re.search(r"tahun#\d+ = 1997", found("sales_by_day"))


def test_foreign_keys_read_each_fact_once(spark):
    plan = plan_of(QUERIES["check_foreign_keys"](spark, FOLDER))
    assert len(re.findall(r"FileScan", plan)) == 10


@pytest.mark.parametrize("key, scans", [("category_movers", 1), ("recommendations", 2)])
def test_movers_read_the_sales_once(spark, key, scans):
    plan = plan_of(QUERIES[key](spark, FOLDER))
    assert 1 <= len(re.findall(r"ReadSchema: struct<[^>]*total_harga", plan)) <= scans


def test_only_dimensions_of_known_small_size_are_broadcast(spark, settings):
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    tables = small_star(spark).tables
    known = {"dim_waktu": 5, "dim_produk": 5, "dim_pelanggan": 5}
    small = plan_of(dashboard.sales_by_year_month(Star(tables, known)))
    assert "BroadcastHashJoin" in small and "SortMergeJoin" not in small
    large = {"dim_waktu": 5, "dim_produk": 5, "dim_pelanggan": 2 * 10**9}
    mixed = plan_of(dashboard.sales_by_year_month(Star(tables, large)))
    assert "SortMergeJoin [pelanggan_key" in mixed
    unknown = plan_of(dashboard.sales_by_year_month(Star(tables)))
    assert "BroadcastHashJoin" not in unknown


def test_rows_are_summed_before_the_shuffle_of_a_large_dimension(spark, settings):
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    sizes = {"dim_waktu": 5, "dim_produk": 5, "dim_pelanggan": 2 * 10**9}
    df = dashboard.top5_states_active(Star(small_star(spark).tables, sizes))
    lines = plan_of(df).splitlines()
    join = next(i for i, line in enumerate(lines) if "SortMergeJoin [pelanggan_key" in line)
    below = [line for line in lines[join:] if "Exchange" in line or "HashAggregate" in line]
    # Final sum, shuffle by customer, partial sum per task, with no shuffle in between.
    assert "HashAggregate(keys=[pelanggan_key" in below[0]
    assert "Exchange hashpartitioning(pelanggan_key" in below[1]
    assert "HashAggregate(keys=[pelanggan_key" in below[2]


def test_operational_sides_meet_on_one_partitioning(spark, settings):
    """Items and payments are summed per order and joined without another shuffle."""
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    plan = plan_of(pairs.norm_monthly_trend(operational_tables(spark, FOLDER)))
    assert len(re.findall(r"Exchange hashpartitioning\(order_id#\d+L, ", plan)) == 3


@pytest.fixture
def eager_splits(settings):
    """Skew thresholds that fit rows by the thousand."""
    settings(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        # At this size everything would be merged into one partition first.
        spark__sql__adaptive__coalescePartitions__enabled="false",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="20kb",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="20kb",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.5",
    )


def _items(spark, hot: str):
    """60,000 items of which a third have 7 in column ``hot``."""
    columns = {"order_id": F.col("id") % 5000, "product_id": F.col("id") % 1000}
    columns[hot] = F.when(F.col("id") % 3 == 0, 7).otherwise(columns[hot])
    return spark.range(0, 60000, 1, 8).select(
        *[expr.alias(name) for name, expr in columns.items()],
        F.lit(1).alias("order_item_id"),
        (F.col("id") % 10).alias("seller_id"),
        F.lit(1).cast("decimal(12,2)").alias("price"),
        F.lit(1).alias("quantity"),
    )


def test_a_hot_product_is_split_by_the_build(spark, eager_splits):
    orders = spark.range(5000).selectExpr(
        "id AS order_id", "1 AS waktu_id", "2017 AS tahun", "1 AS bulan", "id % 9 AS pelanggan_key",
        "3 AS durasi_pengiriman",
    )
    produk = spark.range(1000).selectExpr("id AS product_id", "id + 1 AS produk_key")
    seller = spark.range(10).selectExpr("id AS source_seller_id", "id + 1 AS seller_key")
    lines = build.keyed_lines(_items(spark, "product_id"), orders, produk, seller)
    keys = lines.select("produk_key", "order_id")
    counted = Counter(row.produk_key for row in keys.collect())
    assert counted == Counter(7 + 1 if i % 3 == 0 else i % 1000 + 1 for i in range(60000))
    assert "SortMergeJoin(skew=true) [product_id" in plan_of(keys)


@pytest.mark.parametrize(
    "question, total",
    [("norm_sales_by_category", 120000.0), ("norm_top_categories", 60000),
     ("norm_review_by_product", 60000)],
)
def test_a_hot_order_is_split(spark, eager_splits, question, total):
    op = {
        "order_items": _items(spark, "order_id"),
        "orders": spark.range(5000).selectExpr("id AS order_id", "id % 9 AS customer_id"),
        "customers": spark.range(9).selectExpr("id AS customer_id"),
        "sellers": spark.range(10).selectExpr("id AS seller_id"),
        "products": spark.range(1000).selectExpr(
            "id AS product_id", "cast(id % 4 AS string) AS product_category_name"
        ),
        "order_payments": spark.range(10000).selectExpr("id % 5000 AS order_id"),
        "order_reviews": spark.range(5000).selectExpr(
            "id AS review_id", "id AS order_id", "4 AS review_score"
        ),
    }
    df = getattr(pairs, question)(op)
    rows = values(df)
    assert len(rows) == 4 and sum(row[-1] for row in rows) == total
    assert re.search(r"SortMergeJoin\(skew=true\) \[order_id", plan_of(df))
