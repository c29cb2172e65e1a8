"""Handmade frames and stars."""

from __future__ import annotations

import contextlib
import io
from datetime import date
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from starmart.model import STAR_SCHEMAS, Star


def frame(spark: SparkSession, schema: StructType | str, rows: list[tuple]) -> DataFrame:
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    names = schema.fieldNames()
    table = pa.Table.from_pylist(
        [dict(zip(names, row)) for row in rows], schema=to_arrow_schema(schema)
    )
    return spark.createDataFrame(table, schema=schema)


def star(spark: SparkSession, row_counts=None, enforced: bool = False, **tables) -> Star:
    """A star of the given rows; tables not given are empty. Fact ids are numbered."""
    unknown = set(tables) - set(STAR_SCHEMAS)
    assert not unknown, unknown
    frames = {}
    for name, schema in STAR_SCHEMAS.items():
        rows = tables.get(name, [])
        if schema.fieldNames()[0] == "id":
            rows = [(i, *row) for i, row in enumerate(rows)]
        frames[name] = frame(spark, schema, rows)
    return Star(frames, row_counts or {}, enforced)


def values(df: DataFrame) -> list[tuple]:
    return [tuple(row) for row in df.collect()]


def plan_of(df: DataFrame) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain()
    return text.getvalue()


def money(amount) -> Decimal:
    return Decimal(str(amount)).quantize(Decimal("0.01"))


DAYS = [
    (1, date(2016, 12, 31), 31, 12, 2016),
    (2, date(2017, 1, 5), 5, 1, 2017),
    (3, date(2017, 1, 20), 20, 1, 2017),
    (4, date(2017, 3, 5), 5, 3, 2017),
    (5, date(2018, 3, 9), 9, 3, 2018),
]
PRODUCTS = [
    (1, "P1", "brinquedos", "toys", 10, 100),
    (2, "P2", "livros", "books", 20, 200),
    (3, "P3", "livros", "books", 20, 200),
    (4, "P4", "outros", "", 5, 50),
    (5, "P5", None, None, 5, 50),
]
CUSTOMERS = [
    (1, "C1", "Santos", "SP"),
    (2, "C2", "Campinas", "SP"),
    (3, "C3", "Niterói", "RJ"),
    (4, "C4", "Nowhere", ""),
    (5, "C5", "Nowhere", None),
]
SELLERS = [(1, "S1", "Santos", "SP"), (2, "S2", "Manaus", "AM"), (3, "S3", "Manaus", None)]
METHODS = [(1, "boleto"), (2, "credit_card"), (3, None)]
# date, product, customer, seller, units, amount
SALES = [
    (1, 1, 1, 1, 1, money(10)),
    (2, 1, 1, 1, 2, money("20.05")),
    (2, 2, 2, 2, 1, money(30)),
    (3, 3, 3, 2, 5, money("7.77")),
    (3, 4, 4, 1, 1, money(1)),
    (4, 5, 5, 3, 1, money("99.99")),
    (4, 2, 1, 2, 2, money(60)),
    (5, 1, 2, 3, 3, money("30.10")),
    (5, 2, 2, 1, 1, money(30)),
]


def small_star(spark: SparkSession, **extra) -> Star:
    return star(
        spark,
        dim_waktu=DAYS,
        dim_produk=PRODUCTS,
        dim_pelanggan=CUSTOMERS,
        dim_seller=SELLERS,
        dim_metode_pembayaran=METHODS,
        **{"fakta_penjualan": SALES, **extra},
    )
