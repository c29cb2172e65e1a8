"""Sales and customers laid out by their key, and distinct counts in bitmaps."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from starmart.filters import FilterSpec
from starmart.model import STAR_SCHEMAS, Star
from starmart.operators.aggregates import aggregate, distinct_count, row_count, total
from starmart.plans import dashboard, joined
from starmart.sources.colocated import colocate, hot_keys, open_bucketed
from tests.frames import frame, money, plan_of, small_star, values


def _sales(rows: int = 3000) -> list[tuple]:
    """A third of the sales are of customer 7, some of none, some of customers without a row."""
    draw = random.Random(5)
    who = lambda i: 7 if i % 3 == 0 else None if i % 50 == 1 else draw.randint(1, 120)
    return [(draw.randint(1, 5), draw.randint(1, 5), who(i), 1, draw.randint(1, 3), money(i % 17)) for i in range(rows)]


@pytest.fixture
def many(spark, settings):
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    customers = [(k, f"C{k}" if k % 5 else None, "x", ("SP", "RJ", "")[k % 3]) for k in range(1, 101)]
    tables = dict(small_star(spark, fakta_penjualan=_sales()).tables)
    tables["dim_pelanggan"] = frame(spark, STAR_SCHEMAS["dim_pelanggan"], customers)
    return Star(tables, {"dim_waktu": 5, "dim_produk": 5, "dim_pelanggan": 100, "dim_seller": 3})


def test_rows_are_those_of_the_plain_star(many, tmp_path):
    apart = colocate(many, "fakta_penjualan", "dim_pelanggan", str(tmp_path), buckets=8)
    for op in (
        joined.join_sales_star, joined.join_left_customer_label, dashboard.top10_customers_revenue,
        dashboard.top5_states_active, dashboard.kpi_sales_summary, dashboard.kpi_customers_active,
        lambda s: dashboard.top10_customers_revenue(s, FilterSpec(year=2017, state="SP")),
        lambda s: dashboard.kpi_sales_summary(s, FilterSpec(year=2017, month=3, state="RJ")),
    ):
        expected = sorted(values(op(many)), key=str)
        assert expected and sorted(values(op(apart)), key=str) == expected


def test_hot_and_missing_keys_stay_out_of_the_buckets(many, tmp_path):
    apart = colocate(many, "fakta_penjualan", "dim_pelanggan", str(tmp_path), buckets=8)
    assert [r[0] for r in values(hot_keys(many["fakta_penjualan"], "pelanggan_key", 8))] == [7]
    cold, hot = apart.parts("fakta_penjualan", "dim_pelanggan")
    assert {r[0] for r in values(hot["fakta_penjualan"].select("pelanggan_key").distinct())} == {7, None}
    assert cold["fakta_penjualan"].filter("pelanggan_key IS NULL OR pelanggan_key = 7").isEmpty()
    assert cold["fakta_penjualan"].count() + hot["fakta_penjualan"].count() == 3000
    assert values(hot["dim_pelanggan"].select("pelanggan_key")) == [(7,)]
    # Elsewhere the star is what it was.
    assert apart["fakta_penjualan"].count() == 3000 and not apart.is_small("dim_pelanggan")
    assert [s is apart for s in apart.parts("fakta_review", "dim_pelanggan")] == [True]


@pytest.mark.parametrize("op", [joined.join_sales_star, joined.join_left_customer_label])
def test_neither_bucketed_side_is_moved(many, tmp_path, op):
    apart = colocate(many, "fakta_penjualan", "dim_pelanggan", str(tmp_path), buckets=8)
    plan = plan_of(op(apart))
    assert plan.count("Bucketed: true") == 2
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if "SortMergeJoin [pelanggan_key" in line)
    depth = re.search(r"\w", lines[at]).start()
    below = []
    for line in lines[at + 1:]:
        if re.search(r"\w", line).start() <= depth:
            break
        below.append(line)
    assert any("Bucketed: true" in line for line in below)
    assert not any("Exchange hashpartitioning" in line for line in below)


def test_another_session_can_open_the_buckets(spark, tmp_path):
    rows = frame(spark, "pelanggan_key long, x int, tahun int, bulan int", [(i % 9, i, 2017, i % 2) for i in range(50)])
    path = str(tmp_path / "fact")
    rows.repartition(4, "pelanggan_key").write.bucketBy(4, "pelanggan_key").sortBy("pelanggan_key").partitionBy(
        "tahun", "bulan"
    ).option("path", path).format("parquet").saveAsTable("fact_for_test")
    again = open_bucketed(spark, path, "pelanggan_key long, x int, tahun int, bulan int", "pelanggan_key", 4, True)
    assert sorted(values(again)) == sorted(values(rows))
    plan = plan_of(again.groupBy("pelanggan_key").agg(F.sum("x")))
    assert "Bucketed: true" in plan and "Exchange" not in plan


def test_an_empty_fact_has_empty_parts(spark, tmp_path):
    empty = small_star(spark, fakta_penjualan=[])
    apart = colocate(empty, "fakta_penjualan", "dim_pelanggan", str(tmp_path))
    assert values(joined.join_left_customer_label(apart)) == []
    assert values(dashboard.kpi_sales_summary(apart)) == [(0, 0, 0, 0.0)]


def test_two_distinct_counts_in_one_scan_without_expand(spark):
    plan = plan_of(dashboard.kpi_sales_summary(small_star(spark)))
    assert "Expand" not in plan and "bitmap_construct_agg" in plan
    sales = [line for line in plan.splitlines() if "Scan" in line and "total_harga" in line]
    assert len(sales) == 1


@pytest.mark.parametrize("keys", [[1, 2, 2, None], [32768, 32769, 32768, 65536, 65537], [10**12, 1, 10**12 + 1], [0, -1, -32768, 1], [None], []])
def test_bitmaps_count_exactly(spark, keys):
    rows = [(i, 1, 1 + i % 2, k, 1, 2, money(3)) for i, k in enumerate(keys)]
    tables = dict(small_star(spark).tables)
    tables["fakta_penjualan"] = frame(spark, STAR_SCHEMAS["fakta_penjualan"], rows)
    whole = Star(tables, {}, True)
    measures = {
        "rows": row_count(), "who": distinct_count("pelanggan_key"),
        "units": total("jumlah"), "what": distinct_count("produk_key"),
    }
    n, distinct = len(keys), len({k for k in keys if k is not None})
    expected = (n, distinct, 2 * n if n else None, min(n, 2))
    assert values(aggregate(whole, "fakta_penjualan", (), measures)) == [expected]
    alone = aggregate(whole, "fakta_penjualan", (), {"who": distinct_count("pelanggan_key"), "rows": row_count()})
    assert values(alone) == [(distinct, n)]


def test_bitmaps_per_group_are_those_of_plain_sql(many):
    by = {"state": ("dim_pelanggan", F.col("state")), "year": ("dim_waktu", F.col("tahun"))}
    measures = {"who": distinct_count("pelanggan_key"), "what": distinct_count("produk_key"), "n": row_count()}
    found = aggregate(many, "fakta_penjualan", ("dim_pelanggan", "dim_waktu"), measures, by)
    plain = (
        many["fakta_penjualan"].join(many["dim_pelanggan"], "pelanggan_key").join(many["dim_waktu"], "waktu_id")
        .groupBy("state", F.col("tahun").alias("year"))
        .agg(F.count_distinct("pelanggan_key"), F.count_distinct("produk_key"), F.count("*"))
    )
    assert sorted(values(found)) == sorted(values(plain))
