"""Loads that follow one another, unknown keys, tables of other shapes, typed cleansing."""

from __future__ import annotations

import random
from datetime import date, datetime
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from starmart.filters import FilterSpec
from starmart.model import OPERATIONAL_SCHEMAS, STAR_SCHEMAS
from starmart.operators.keys import check_foreign_keys, check_unique_keys, cleanse_typed, cleansing_counts, surrogate_keys
from starmart.plans import build, dashboard, pairs, trend
from starmart.sources import loads
from starmart.sources.adapter import adapt_operational
from starmart.sources.tables import date_predicates, read_star, replace_months, text_predicates, write_star
from starmart.sources.warehouse import Warehouse
from tests.frames import frame, money, values

JANUARY, FEBRUARY = datetime(2017, 1, 30, 23, 0), datetime(2017, 2, 2, 1, 0)


def operational(spark, **more):
    rows = {
        "orders": [(10, 7, JANUARY, FEBRUARY), (11, 8, FEBRUARY, None), (12, 5, JANUARY, FEBRUARY), (13, 7, None, None)],
        "order_items": [(10, 1, 3, 4, money(5), 2), (11, 1, 1, 4, money(1), 1), (11, 2, 99, 4, money(7), 1), (12, 1, 1, 4, money(2), 1), (13, 1, 3, 77, money(4), 1)],
        "products": [(3, "P3", "x", "x", 1, 1), (1, "P1", "y", "y", 1, 1)],
        "category_translation": [("x", "X-en"), ("y", "Y-en")],
        "customers": [(8, "C8", "a", "SP"), (7, None, "b", "RJ")],
        "sellers": [(4, "S4", "a", "SP")],
        "order_payments": [(10, 1, "b", "boleto", money(9)), (12, 1, "v", "voucher", money(1))],
        "order_reviews": [(1, 10, 5), (2, 11, 3)],
    }
    for name, extra in more.items():
        rows[name] = rows[name] + extra
    return {name: frame(spark, OPERATIONAL_SCHEMAS[name], some) for name, some in rows.items()}


def test_rows_with_unknown_keys_stay_and_leave_the_joins(spark, tmp_path):
    warehouse = Warehouse(spark, operational(spark), str(tmp_path))
    warehouse.load()
    star = warehouse.star()
    assert star["fakta_penjualan"].count() == 5
    assert warehouse.null_keys("fakta_penjualan") == {"dim_waktu": 1, "dim_produk": 1, "dim_pelanggan": 1, "dim_seller": 1}
    assert not star.holds("fakta_penjualan", "dim_produk") and star.holds("fakta_pembayaran", "dim_waktu")
    # All dimensions: the unknown product, customer and date leave. The trend joins the date only.
    assert values(dashboard.kpi_revenue(star)) == [(6.0,)]
    assert sum(r[2] for r in values(trend.trend_monthly(star))) == 15.0
    # A customer without a code goes by its key, a sale without a customer by nothing.
    assert sorted(values(dashboard.top10_customers_revenue(star)), key=str) == [("1", 5.0), ("C8", 1.0), (None, 2.0)]
    assert {n for *_, n in values(check_foreign_keys(star))} == {0}
    assert {n for *_, n in values(check_unique_keys(star))} == {0}
    sides = {r.fact: r for r in build.reconcile(star, warehouse.source).collect()}
    assert all(r.source_rows == r.fact_rows and r.source_total == r.fact_total for r in sides.values()) and len(sides) == 4


def test_keys_go_on_from_those_known(spark):
    rng = random.Random(2)
    ids = rng.sample(range(10**6), 600)
    known = surrogate_keys(frame(spark, "id long", [(i,) for i in ids[:400]]), "id").select("id", "key")
    before = dict(values(known))
    after = dict(values(surrogate_keys(frame(spark, "id long", [(i,) for i in ids[200:]]), "id", known=known).select("id", "key")))
    assert {i: k for i, k in after.items() if i in before} == {i: before[i] for i in ids[200:400]}
    assert {i: after[i] for i in ids[400:]} == {i: n for n, i in enumerate(sorted(ids[400:]), 401)}
    none = surrogate_keys(frame(spark, "id long", [(5,)]), "id", known=known.limit(0))
    assert [(r.id, r.key) for r in none.collect()] == [(5, 1)]


def test_a_second_load_keeps_keys_and_the_first_star(spark, tmp_path):
    folder = str(tmp_path)
    first = loads.load_star(spark, operational(spark), folder)
    labels = lambda star: {r.produk_id: r.produk_key for r in star["dim_produk"].collect()}
    assert labels(first) == {"P1": 1, "P3": 2}
    grown = operational(
        spark, products=[(2, "P2", "x", "x", 1, 1)], orders=[(14, 8, datetime(2016, 5, 1), None)],
        order_items=[(14, 1, 2, 4, money(3), 1)],
    )
    # Product 1 is gone from the source; its key is not given again.
    grown["products"] = grown["products"].filter("product_id <> 1")
    second = loads.load_star(spark, grown, folder)
    assert labels(second) == {"P3": 2, "P2": 3}
    assert {r.tanggal: r.waktu_id for r in second["dim_waktu"].collect()} == {date(2017, 1, 30): 1, date(2017, 2, 2): 2, date(2016, 5, 1): 3}
    assert second["fakta_penjualan"].count() == 6 and first["fakta_penjualan"].count() == 5
    third = loads.load_star(spark, operational(spark), folder)
    assert labels(third) == {"P1": 1, "P3": 2}
    for star in (third, loads.open_star(spark, folder), loads.open_star(spark, folder, 1)):
        assert sorted(values(star["fakta_penjualan"].drop("id")), key=str) == sorted(values(first["fakta_penjualan"].drop("id")), key=str)
        assert star.holds("fakta_review", "dim_waktu") and not star.holds("fakta_penjualan", "dim_waktu")
    assert loads.drop_loads(spark, folder, keep=1) == [1, 2]
    assert loads.open_star(spark, folder)["dim_produk"].count() == 2
    with pytest.raises(ValueError):
        loads.drop_loads(spark, folder, keep=0)


def test_a_load_that_breaks_off_is_not_seen(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        loads.open_star(spark, folder)
    loads.load_star(spark, operational(spark), folder)

    def broken(*_):
        raise RuntimeError("no more disk")

    monkeypatch.setattr(build, "fakta_review", broken)
    with pytest.raises(RuntimeError):
        loads.load_star(spark, operational(spark, order_items=[(10, 2, 1, 4, money(1), 1)]), folder)
    assert [r.load for r in loads.manifest(spark, folder).collect()] == [1]
    assert loads.open_star(spark, folder)["fakta_penjualan"].count() == 5


def test_months_are_replaced_and_a_star_is_not_written_over_itself(spark, tmp_path):
    warehouse = Warehouse(spark, operational(spark), str(tmp_path / "w"))
    folder = str(tmp_path / "star")
    write_star(warehouse.star(), folder)
    star = read_star(spark, folder)
    with pytest.raises(ValueError):
        write_star(star, folder)
    path = f"{folder}/fakta_penjualan"
    replace_months(star.fact("fakta_penjualan", 2017, 2).withColumn("jumlah", F.lit(50)), path)
    spark.catalog.refreshByPath(path)
    units = {(r.tahun, r.bulan): r.n for r in read_star(spark, folder)["fakta_penjualan"].groupBy("tahun", "bulan").agg(F.sum("jumlah").alias("n")).collect()}
    assert units == {(2017, 1): 3, (2017, 2): 100, (None, None): 1}
    with pytest.raises(ValueError):
        replace_months(star["fakta_penjualan"].drop("bulan"), path)
    assert values(dashboard.kpi_units(warehouse.star(), FilterSpec(year=2017, month=1))) == [(2,)]
    written = warehouse.paths["keyed_lines"]
    warehouse.close()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(written)
    assert warehouse.star()["fakta_penjualan"].count() == 5


def test_star_of_tables_with_text_ids_and_few_columns(spark, tmp_path):
    make = lambda schema, rows: frame(spark, schema, rows)
    tables = {
        "orders": make("order_id string, customer_id string, order_purchase_timestamp timestamp, order_delivered_customer_date timestamp", [("o1", "c1", JANUARY, FEBRUARY), ("o2", "c2", FEBRUARY, None)]),
        "order_items": make("order_id string, product_id string, seller_id string, price double", [("o1", "p1", "s1", 10.5), ("o1", "p1", "s1", 10.5), ("o2", "p2", "s1", 3.0)]),
        "products": make("product_id string, product_category_name string", [("p1", "livros"), ("p2", None)]),
        "customers": make("customer_id string, customer_city string, customer_state string", [("c1", "Santos", "SP"), ("c2", "Rio", "RJ")]),
        "sellers": make("seller_id string", [("s1",)]),
        "order_payments": make("order_id string, payment_type string", [("o1", "boleto"), ("o2", "voucher"), ("o2", "voucher")]),
        "order_reviews": make("review_id string, order_id string, review_score int", [("r1", "o1", 4)]),
    }
    source = adapt_operational(tables)
    warehouse = Warehouse(spark, source, str(tmp_path))
    warehouse.load()
    star = warehouse.star()
    for name, schema in STAR_SCHEMAS.items():
        assert [star[name].schema[f.name].dataType for f in schema.fields] == [f.dataType for f in schema.fields], name
    assert values(dashboard.top10_products(star)) == [("p1", 2), ("p2", 1)]
    assert values(dashboard.kpi_revenue(star)) == [(24.0,)]
    assert sorted(values(dashboard.payment_method_counts(star))) == [("boleto", 1), ("voucher", 2)]
    for question in pairs.STAR_QUESTIONS.values():
        question(star).collect()
    for question in pairs.NORMALISED_QUESTIONS.values():
        question(source).collect()
    # With a translation, and a column that goes by another name.
    tables["products"] = tables["products"].withColumnRenamed("product_category_name", "kind")
    tables["category_translation"] = make("product_category_name string, product_category_name_english string", [("livros", "books")])
    again = adapt_operational(tables, {"products": {"product_category_name": "kind"}})
    produk = build.dim_produk(again["products"], again["category_translation"])
    assert sorted(values(produk.select("produk_id", "kategori", "kategori_inggris"))) == [("p1", "livros", "books"), ("p2", None, None)]
    with pytest.raises(ValueError, match="review_score"):
        adapt_operational({**tables, "order_reviews": tables["order_reviews"].drop("review_score")}, {"products": {"product_category_name": "kind"}})
    with pytest.raises(ValueError, match="sellers"):
        adapt_operational({k: v for k, v in tables.items() if k != "sellers"}, {"products": {"product_category_name": "kind"}})


def test_typed_cleansing_accounts_for_every_row(spark):
    schema = OPERATIONAL_SCHEMAS["order_items"]
    rows = [
        ("1", "1", "5", "6", "1.50", "2"), ("1", "1", "5", "6", "1.50", "2"), ("1", "2", "5", "6", "0.50", "2"),
        ("2", "x", "5", "6", "1.50", "two"), (None, "1", "5", "6", "1.50", "2"), (None, "?", "5", "6", None, None),
        ("3", None, None, None, None, None), ("99999999999999999999", "1", "1", "1", "1", "1"), ("4", "1", "1", "1", "12345678901.00", "1"),
        ("2", "x", "5", "6", "1.50", "two"),
    ]
    df = spark.createDataFrame([(*r, "extra") for r in rows], ", ".join(f"{c} string" for c in schema.fieldNames()) + ", note string")
    found = cleanse_typed(df.repartition(4), schema, "order_id")
    assert found.accepted.schema.fieldNames() == schema.fieldNames()
    assert sorted(values(found.accepted), key=str) == [(1, 1, 5, 6, Decimal("1.50"), 2), (3, None, None, None, None, None)]
    rejected = {(r.column, r.reason, r.rows, len(r.faults)) for r in found.rejected.collect()}
    assert rejected == {
        ("order_id", "repeated", 1, 1), ("order_item_id", "not int", 2, 2), ("order_id", "missing", 1, 1),
        ("order_id", "missing", 1, 2), ("order_id", "not bigint", 1, 1), ("price", "not decimal(12,2)", 1, 1),
    }
    counts = cleansing_counts(found).collect()
    assert sum(r.rows for r in counts) == len(rows)
    empty = cleanse_typed(df.limit(0), schema, "order_id")
    assert [tuple(r) for r in cleansing_counts(empty).collect()] == [("accepted", None, None, 0)]


def test_extract_predicates_meet_every_row_once():
    rows = [None, *[f"2017-0{m}-1{d}" for m in range(1, 8) for d in range(3)]]
    connection = duckdb.connect()
    connection.execute("CREATE TABLE t AS SELECT unnest(?::VARCHAR[]) AS s", [rows])
    days = date_predicates("CAST(s AS DATE)", [date(2017, 2, 11), date(2017, 3, 1), date(2017, 7, 12)])
    texts = text_predicates("s", 5, "CAST(hash({}) % 4294967296 AS BIGINT)")
    for found in (days, texts):
        each = [connection.execute(f"SELECT count(*) FROM t WHERE {p}").fetchall()[0][0] for p in found]
        assert sum(each) == len(rows) and len(each) in (4, 5)
    assert text_predicates("id", 2)[1] == "(hashtext(id) & 2147483647) % 2 = 1"
    for bad in (lambda: date_predicates("d", []), lambda: date_predicates("d", [date(2017, 2, 1), date(2017, 1, 1)]), lambda: text_predicates("d", 0)):
        with pytest.raises(ValueError):
            bad()
