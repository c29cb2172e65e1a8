"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starmart.llm.store import keep
from starmart.operators.joins import reshuffled


def _lowest(df: DataFrame, key: str, value: str) -> DataFrame:
    """Each row beside the lowest value of its key.

    The lowest are found map-side first, one row per key and task. They are shuffled once more before the join:
    only then do both of its sides come straight from a shuffle, so that adaptive execution
    may split the rows of a hot key.
    """
    low = df.groupBy(F.col(key).alias("node")).agg(F.min(value).alias("low"))
    return df.join(reshuffled(low, "node"), df[key] == F.col("node"))


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` to ``(node, root)``: the lowest node that each can reach.

    Every node of a link comes out, the root itself included. Links with a null end
    are ignored; a link of a node to itself gives that node alone.
    """
    links = keep(
        links.dropna(subset=["a", "b"])
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    edges = links.filter("a <> b")
    before = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        large = (
            _lowest(both, "a", "b")
            .filter("b > a")
            .select(F.col("b").alias("a"), F.least("a", "low").alias("b"))
            .distinct()
        )
        small = (
            _lowest(large, "a", "b")
            .select(F.explode(F.array("a", "b")).alias("a"), F.col("low").alias("b"))
            .filter("a <> b")
            .distinct()
        )
        edges = keep(small, "stars")
        now = edges.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if now == before:
            break
        before = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = stars.select(F.col("root").alias("node"), "root").distinct()
    lone = links.filter("a = b").select(F.col("a").alias("node"), F.col("a").alias("root"))
    return stars.union(roots).union(lone.join(stars.union(roots), "node", "left_anti"))
