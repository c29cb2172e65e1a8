from __future__ import annotations

from datetime import datetime

import pytest

from starmart.model import DIMENSION_KEYS, OPERATIONAL_SCHEMAS, STAR_SCHEMAS
from starmart.operators.keys import check_foreign_keys, check_unique_keys, cleanse
from starmart.plans import build, dashboard
from starmart.session import shared_folder
from starmart.sources.given import operational_tables
from starmart.sources.tables import (
    jdbc_options, read_operational, read_star, star_from_catalog, write_star,
)
from starmart.sources.warehouse import Warehouse
from tests.frames import frame, money, plan_of, small_star, values
from starmart.filters import FilterSpec

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def warehouse(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("warehouse"))
    built = Warehouse(spark, operational_tables(spark, FOLDER), folder)
    built.load()
    return built


def test_operational_schemas(spark):
    for name, df in operational_tables(spark, FOLDER).items():
        expected = [(f.name, f.dataType) for f in OPERATIONAL_SCHEMAS[name].fields]
        assert [(f.name, f.dataType) for f in df.schema.fields] == expected, name


def test_operational_round_trip(spark, tmp_path):
    tables = operational_tables(spark, FOLDER)
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / name))
    again = read_operational(spark, str(tmp_path))
    assert {n: d.count() for n, d in again.items()} == {n: d.count() for n, d in tables.items()}


def test_star_schemas_and_keys(spark, warehouse):
    star = warehouse.star()
    for name, schema in STAR_SCHEMAS.items():
        columns = [(f.name, f.dataType) for f in star[name].schema.fields if f.name in schema.fieldNames()]
        assert columns == [(f.name, f.dataType) for f in schema.fields], name
    assert {n for *_, n in values(check_foreign_keys(star))} == {0}
    assert {n for *_, n in values(check_unique_keys(star))} == {0}


def test_write_and_read_star(spark, warehouse, tmp_path):
    star = warehouse.star()
    write_star(star, str(tmp_path))
    again = read_star(spark, str(tmp_path), enforced=True)
    assert {d: again.row_counts[d] for d in DIMENSION_KEYS} == {
        d: star.row_counts[d] for d in DIMENSION_KEYS
    }
    for operator in (dashboard.kpi_sales_summary, dashboard.sales_by_year_month):
        assert values(operator(again)) == values(operator(star))
    unchecked = read_star(spark, str(tmp_path))
    assert values(dashboard.kpi_revenue(unchecked)) == values(dashboard.kpi_revenue(star))
    year = plan_of(dashboard.kpi_revenue(again, FilterSpec(year=1997)))
    assert "PartitionFilters: [isnotnull(tahun" in year


def test_seller_dimension_goes_by_either_name(spark):
    star = small_star(spark)
    for name in STAR_SCHEMAS:
        view = "dim_penjual" if name == "dim_seller" else name
        star[name].createOrReplaceTempView(f"t1_{view}")
        star[name].createOrReplaceTempView(f"t2_{name}")
    for prefix in ("t1_", "t2_"):
        found = star_from_catalog(spark, prefix)
        assert sorted(values(found["dim_seller"])) == sorted(values(star["dim_seller"]))


def test_jdbc_options():
    options = jdbc_options("jdbc:postgresql://host/db", "orders", "id", 1, 1000, 8)
    assert options["numPartitions"] == "8" and options["upperBound"] == "1000"
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x", "orders", "id", 5, 5, 8)


def test_shared_folder_is_the_configured_one(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    folder = shared_folder(spark)
    if configured:
        assert folder.startswith(configured.rstrip("/"))
    assert folder == shared_folder(spark)


def test_build_on_awkward_rows(spark):
    """Missing and repeated keys, untranslated categories, undelivered orders."""
    def table(name, rows):
        return frame(spark, OPERATIONAL_SCHEMAS[name], rows)

    bought, brought = datetime(2017, 1, 30, 23, 0), datetime(2017, 2, 2, 1, 0)
    orders = table("orders", [
        (10, 7, bought, brought), (10, 7, bought, brought), (11, 8, bought, None),
        (12, 5, bought, brought), (None, 7, bought, brought),
    ])
    products = table("products", [
        (3, "P3", "x", "x", 1, 1), (3, "P3", "x", "x", 1, 1), (1, "P1", "y", "y", 1, 1),
        (2, "P2", None, None, 1, 1),
    ])
    translation = table("category_translation", [("x", "X-en")])
    customers = table("customers", [(8, "C8", "a", "SP"), (7, "C7", "b", "RJ"), (None, "C", "c", "d")])
    sellers = table("sellers", [(4, "S4", "a", "SP")])
    items = table("order_items", [
        (10, 1, 3, 4, money(5), 2), (10, 2, 3, 4, money(5), 3), (11, 1, 1, 4, money(1), 1),
        (11, 2, 99, 4, money(1), 1), (12, 1, 1, 4, money(1), 1),
        (13, 1, 1, 55, money(2), 4),
    ])
    payments = table("order_payments", [
        (10, 1, "b", "boleto", money(9)), (10, 2, "v", "voucher", money(1)),
        (11, 1, "a", None, money(2)), (12, 1, None, None, money(4)), (13, 1, "b", "boleto", money(3)),
    ])
    reviews = table("order_reviews", [(1, 10, 5), (1, 10, 5), (2, 11, 3), (4, 13, 1)])

    waktu = build.dim_waktu(orders)
    produk = build.dim_produk(products, translation)
    pelanggan = build.dim_pelanggan(customers)
    seller = build.dim_seller(sellers)
    metode = build.dim_metode_pembayaran(payments)
    keyed = build.keyed_orders(orders, waktu, pelanggan)
    lines = build.keyed_lines(items, keyed, produk, seller)
    sales = build.fakta_penjualan(lines)

    assert sorted((r[0], r[1], r[3]) for r in values(produk)) == [
        (1, "P1", None), (2, "P2", None), (3, "P3", "X-en"),
    ]
    assert sorted(r[:2] for r in values(pelanggan)) == [(1, "C7"), (2, "C8")]
    assert sorted(r[:2] for r in values(metode)) == [(1, None), (2, "boleto"), (3, "voucher")]
    rows = lambda df: sorted(values(df), key=str)
    # Order 12 has no customer row, item 99 no product row, order 13 is not there at all.
    assert rows(sales) == sorted([
        (1, 1, 2, 1, 1, money(1), 2017, 1), (1, None, 2, 1, 1, money(1), 2017, 1),
        (1, 3, 1, 1, 2, money(5), 2017, 1), (1, 3, 1, 1, 3, money(5), 2017, 1),
        (1, 1, None, 1, 1, money(1), 2017, 1), (None, 1, None, None, 4, money(2), None, None),
    ], key=str)
    assert rows(build.fakta_pengiriman(lines)) == sorted([
        (1, 1, 1, 3, 3, 2017, 1), (1, 1, 1, 3, 3, 2017, 1), (1, 2, 1, 1, None, 2017, 1),
        (1, 2, 1, None, None, 2017, 1), (1, None, 1, 1, 3, 2017, 1), (None, None, None, 1, None, None, None),
    ], key=str)
    assert rows(build.fakta_pembayaran(payments, keyed, metode)) == sorted([
        (1, 1, 1, 2, money(9), 2017, 1), (2, 1, 1, 3, money(1), 2017, 1), (3, 1, 2, 1, money(2), 2017, 1),
        (4, 1, None, None, money(4), 2017, 1), (5, None, None, 2, money(3), None, None),
    ], key=str)
    assert rows(build.fakta_review(reviews, lines)) == sorted([
        (1, 1, 3, 5, 2017, 1), (1, 1, 3, 5, 2017, 1), (1, 2, 1, 3, 2017, 1), (1, 2, None, 3, 2017, 1),
        (None, None, 1, 1, None, None),
    ], key=str)
    assert rows(build.fakta_seller(sales)) == sorted([
        (1, 1, 1, 2017, 1, 2), (1, 1, 3, 2017, 1, 5), (1, 1, None, 2017, 1, 1), (None, None, 1, None, None, 4),
    ], key=str)


def test_cleanse_keeps_the_same_row_in_any_order(spark):
    rows = [(1, "b", 2), (1, "a", 9), (1, None, 7), (2, "z", 1), (None, "a", 1)]
    schema = "id long, name string, n int"
    for some in (rows, rows[::-1]):
        df = spark.createDataFrame(some, schema).repartition(3)
        assert sorted(values(cleanse(df, "id")), key=str) == [(1, None, 7), (2, "z", 1)]
