"""Readers of operational and star tables, and the sinks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date
from functools import reduce
from itertools import pairwise

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from starmart.model import (
    DIMENSION_KEYS,
    FACT_KEYS,
    LAYOUT,
    OPERATIONAL_SCHEMAS,
    STAR_SCHEMAS,
    Star,
)
from starmart.operators.keys import Cleansed, cleanse_typed
from starmart.session import laid_out_by_month


def read_operational(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Operational tables kept as one Parquet folder each."""
    return {
        name: spark.read.schema(schema).parquet(f"{folder}/{name}")
        for name, schema in OPERATIONAL_SCHEMAS.items()
    }


def jdbc_options(
    url: str, table: str, column: str, lower: int, upper: int, partitions: int
) -> dict[str, str]:
    """Options that read ``table`` in parallel ranges of its numeric ``column``."""
    if partitions < 1 or upper <= lower:
        raise ValueError("a parallel read needs partitions >= 1 and upper > lower")
    return {
        "url": url,
        "dbtable": table,
        "partitionColumn": column,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
        "fetchsize": "10000",
    }


def read_jdbc(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """Extract one table of the operational database."""
    return spark.read.format("jdbc").options(**options).load()


def date_predicates(column: str, days: Sequence[date]) -> list[str]:
    """Conditions that part rows by date: before the first day, from each day to the next, and
    from the last on. Every row meets exactly one; those without a date meet the first."""
    if not days or list(days) != sorted(set(days)):
        raise ValueError("days must be given in order, each once")
    first = [f"{column} < DATE '{days[0]}' OR {column} IS NULL"]
    between = [f"{column} >= DATE '{a}' AND {column} < DATE '{b}'" for a, b in pairwise(days)]
    return [*first, *between, f"{column} >= DATE '{days[-1]}'"]


def text_predicates(column: str, partitions: int, hashed: str = "hashtext({})") -> list[str]:
    """Conditions that part rows by the hash of a text id; ``hashed`` is the database's function.

    Every row meets exactly one; those without an id meet the first.
    """
    if partitions < 1:
        raise ValueError("at least one partition is needed")
    place = f"({hashed.format(column)} & 2147483647) % {partitions}"
    found = [f"{place} = {i}" for i in range(partitions)]
    return [f"{found[0]} OR {column} IS NULL", *found[1:]]


def extract(
    spark: SparkSession, url: str, table: str, predicates: list[str], business_key: str,
    properties: dict[str, str] | None = None,
) -> Cleansed:
    """An operational table, read in one task per predicate and cast to its schema."""
    rows = spark.read.jdbc(url, table, predicates=predicates, properties=properties)
    return cleanse_typed(rows, OPERATIONAL_SCHEMAS[table], business_key)


def star_from_catalog(spark: SparkSession, prefix: str = "") -> Star:
    """The star registered in the session catalog, optionally as ``prefix`` + name.

    The seller dimension may go by its other name, ``dim_penjual``.
    """
    def find(name: str) -> DataFrame:
        if name == "dim_seller" and not spark.catalog.tableExists(prefix + name):
            name = "dim_penjual"
        return spark.table(prefix + name)

    return Star({name: find(name) for name in STAR_SCHEMAS})


def write_star(star: Star, folder: str) -> None:
    """Write the ten tables; facts that carry year and month are laid out by them.

    A star is not written over the tables that it is read from; ``loads.load_star`` writes each
    load beside the one before.
    """
    for name in STAR_SCHEMAS:
        if reads_from(star[name], f"{folder}/{name}"):
            raise ValueError(f"{name} is read from {folder}; write it elsewhere")
    for name in STAR_SCHEMAS:
        df = star[name]
        by_month = name in FACT_KEYS and set(LAYOUT) <= set(df.columns)
        if by_month:
            df = laid_out_by_month(df)
        writer = df.write.mode("overwrite")
        if by_month:
            writer = writer.partitionBy(*LAYOUT)
        writer.parquet(f"{folder}/{name}")


def reads_from(df: DataFrame, folder: str) -> bool:
    """Whether a file below ``folder`` is among those that ``df`` is read from."""
    plain = lambda path: "/" + path.split(":", 1)[-1].strip("/") + "/"
    return any(plain(file).startswith(plain(folder)) for file in df.inputFiles())


def replace_months(fact: DataFrame, path: str) -> None:
    """Put the rows of ``fact`` in place of all rows that a written fact has of the same months.

    Other months stay as they are. Spark stages the files and moves them when all are written, so
    ``fact`` may itself be read from ``path``.
    """
    missing = set(LAYOUT) - set(fact.columns)
    if missing:
        raise ValueError(f"no column {sorted(missing)} to tell months by")
    laid_out_by_month(fact).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(*LAYOUT).parquet(path)


def read_star(spark: SparkSession, folder: str, enforced: bool = False) -> Star:
    """A written star; say ``enforced`` only of one that passes the key checks."""
    tables = {name: read_table(spark, f"{folder}/{name}", name) for name in STAR_SCHEMAS}
    counts = {name: tables[name].count() for name in DIMENSION_KEYS}
    return Star(tables, counts, enforced)


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A written table of the star; year and month come along where it is laid out by them."""
    schema = STAR_SCHEMAS[name]
    if name in FACT_KEYS:
        there = spark.read.parquet(path).columns
        schema = StructType([*schema.fields, *[StructField(c, t) for c, t in LAYOUT.items() if c in there]])
    return spark.read.schema(schema).parquet(path)


def write_json(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").json(folder)


def table_counts(tables: Iterable[tuple[str, DataFrame]]) -> DataFrame:
    """Rows per table, read in full."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        for name, df in tables
    ]
    return reduce(DataFrame.unionByName, counts)
