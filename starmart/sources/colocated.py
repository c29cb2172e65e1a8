"""A fact and a dimension too large to broadcast, laid out by the key that they share.

Both are written in the same number of buckets of the key, so Spark joins them, and sums the
fact by the key, without moving either. A bucket is read by one task, so keys with more rows than an even
bucket stay out of the buckets, as do missing keys: their rows go to a table of its own, which may be cut
anywhere, and meet the few dimension rows of these keys by broadcast. There are at most as many such keys
as buckets, whatever the size of the data.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starmart.model import DIMENSION_KEYS, LAYOUT, Star
from starmart.session import laid_out_by_month, write_and_read

#: Fact rows that a bucket is to hold. One task sorts and joins a bucket, in about 300 bytes a row.
BUCKET_ROWS = 2_000_000


def _bucketed(df: DataFrame, path: str, key: str, buckets: int) -> DataFrame:
    """``df`` as a table of files by bucket. The session's catalog knows it by a name of its own."""
    name = f"bucketed_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path)
    if set(LAYOUT) <= set(df.columns):
        writer = writer.partitionBy(*LAYOUT)
    writer.format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def open_bucketed(
    spark: SparkSession, path: str, schema: str, key: str, buckets: int, by_month: bool = False
) -> DataFrame:
    """A bucketed table that another session has written, made known to this one's catalog."""
    name = f"bucketed_{uuid.uuid4().hex}"
    parts = f"PARTITIONED BY ({', '.join(LAYOUT)}) " if by_month else ""
    spark.sql(
        f"CREATE TABLE {name} ({schema}) USING parquet {parts}"
        f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    if by_month:
        spark.sql(f"MSCK REPAIR TABLE {name}")
    return spark.table(name)


def _plain(fact: DataFrame, path: str) -> DataFrame:
    if not set(LAYOUT) <= set(fact.columns):
        return write_and_read(fact, path)
    return write_and_read(laid_out_by_month(fact), path, tuple(LAYOUT))


def hot_keys(fact: DataFrame, key: str, buckets: int) -> DataFrame:
    """Keys with more rows than an even bucket has; fewer than ``buckets`` of them."""
    counted = fact.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    even = fact.count() / buckets
    return counted.filter(F.col("n") > F.lit(even)).select(key)


def colocate(star: Star, fact: str, dimension: str, folder: str, buckets: int | None = None) -> Star:
    """``star`` with ``fact`` also laid out by the key of ``dimension``, which counts as large."""
    key = DIMENSION_KEYS[dimension]
    rows, side = star[fact], star[dimension]
    if buckets is None:
        buckets = max(1, -(-rows.count() // BUCKET_ROWS))
    hot = write_and_read(hot_keys(rows, key, buckets), f"{folder}/hot-{uuid.uuid4().hex}")
    marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left").select(*rows.columns, "_hot")
    path = f"{folder}/{fact}-by-{key}-{uuid.uuid4().hex}"
    apart = F.col("_hot").isNotNull() | F.col(key).isNull()
    cold = {
        fact: _bucketed(marked.filter(~apart).drop("_hot"), f"{path}/fact", key, buckets),
        dimension: _bucketed(side, f"{path}/dimension", key, buckets),
    }
    known = side.join(F.broadcast(hot), key, "left_semi")
    kept = {
        fact: _plain(marked.filter(apart).drop("_hot"), f"{path}/hot-fact"),
        dimension: write_and_read(known, f"{path}/hot-dimension"),
    }
    sizes = {d: star.row_counts[d] for d in star.row_counts if d != dimension}
    parts = {**star.colocated, (fact, dimension): (cold, kept)}
    return replace(star, row_counts=sizes, colocated=parts)
