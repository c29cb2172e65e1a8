"""Filter interaction audit: what each filter removes under every order of five filters.

Texts are read once and leave a mask of the filters that they fail. Masks are counted
per part, so what follows works on at most 32 rows of a part.

A document with mask m is removed at step s of an order exactly if the first s - 1 filters are
not in m and the s-th is. The orders that begin with such s filters have neighbouring
lexicographic (Lehmer) ranks, ``(5 - s)!`` of them. So a mask adds its count at the first
rank of each such interval and takes it off behind the last, and running sums over the
120 ranks give what each order removes at each step.

Null texts are empty, a null part is the empty string. Words are maximal runs outside
``[\\x20\\x09-\\x0D]``. A document repeats an earlier one if a smaller id has the same text,
anywhere in the table; rows without an id neither repeat nor are repeated, and rows that share id
and text are all first. Texts are told apart by SHA-256; of any length they stay one row. Of several labels
of an id, one that says 1 is enough; labels of unknown ids are ignored. Rows that
share an id each count. An empty table has no parts. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starmart.llm.store import keep, prepare

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]

_SPACE = r"[\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def rank(prefix: str) -> int:
    """Lehmer rank of the first order that begins with ``prefix``."""
    left, at = list(FILTERS), 0
    for i, letter in enumerate(prefix):
        at += left.index(letter) * factorial(len(FILTERS) - 1 - i)
        left.remove(letter)
    return at


def interval_ends() -> list[tuple[int, int, int, int]]:
    """``(mask, step, rank, change)``: where the intervals of a mask begin (1) and end (-1).

    Ends that meet a beginning cancel out.
    """
    rows = []
    for mask in range(1, 1 << len(FILTERS)):
        failed = [x for i, x in enumerate(FILTERS) if mask >> i & 1]
        passed = [x for x in FILTERS if x not in failed]
        for step in range(1, len(passed) + 2):
            ends: Counter[int] = Counter()
            for before in permutations(passed, step - 1):
                for letter in failed:
                    first = rank("".join(before) + letter)
                    ends[first] += 1
                    ends[first + factorial(len(FILTERS) - step)] -= 1
            rows += [(mask, step, at, n) for at, n in sorted(ends.items()) if n and at < len(ORDERS)]
    return rows


def _table(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(pa.table(dict(zip(columns, map(list, zip(*rows))))))


def _bit(test: Column, letter: str) -> Column:
    return F.when(test, 1 << FILTERS.index(letter)).otherwise(0)


def failed_filters(docs: DataFrame, part: Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(part, id, digest, mask, n)``: rows counted by part, id and text, with the filters A to D that they fail."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    trimmed = F.btrim("text", F.lit(" \t\n\x0b\f\r"))
    found = F.split(trimmed, _SPACE)
    # An empty text splits into one empty piece.
    n = F.size(found) - (trimmed == "").cast("int")
    distinct = F.size(F.array_distinct(found))
    upper = F.length("text") - F.length(F.translate("text", _UPPER, ""))
    mask = (
        _bit(n < 100, "A")
        + _bit(F.lit(100).cast("long") * distinct < F.lit(80).cast("long") * n, "B")
        + _bit(F.lit(100).cast("long") * upper > F.lit(10).cast("long") * F.length("text"), "C")
        + _bit(F.col("text").rlike(r"[#$%&*|]"), "D")
    )
    rows = docs.select(
        F.coalesce(part.cast("string"), F.lit("")).alias("part"), F.col(id_column).cast("long").alias("id"), text.alias("text")
    )
    return (
        rows.select("part", "id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), mask.alias("mask"))
        .groupBy("part", "id", "digest", "mask")
        .agg(F.count("*").alias("n"))
    )


def count_masks(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, n, good, toxic)`` with filter E added to the masks of ``failed_filters``.

    The smallest id of a text comes from a sum per task; rows then meet it by text *and*
    id, so copies of one text, however many, are spread over all tasks.
    """
    known = rows.filter("id is not null")
    first = known.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    judged = (
        known.join(marks, "id", "left").join(first, ["id", "digest"], "left")
        .withColumn("mask", F.col("mask") + _bit(F.col("first").isNull(), "E"))
        .select("part", "mask", "n", "good", "toxic")
    )
    nameless = rows.filter("id is null").select("part", "mask", "n", F.lit(None).alias("good"), F.lit(None).alias("toxic"))
    flagged = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return judged.union(nameless).groupBy("part", "mask").agg(F.sum("n").alias("n"), flagged("good"), flagged("toxic"))


def interactions(masks: DataFrame) -> DataFrame:
    """What each order removes at each step, from counted masks."""
    spark = masks.sparkSession
    measures = ("n", "good", "toxic")
    ends = _table(spark, ["mask", "step", "rank", "change"], interval_ends())
    changes = masks.join(F.broadcast(ends), "mask").groupBy("part", "step", "rank").agg(
        *[F.sum(F.col("change") * F.col(c)).alias(c) for c in measures]
    )
    places = _table(
        spark, ["place", "rank", "step", "filter_order", "letter"],
        [(5 * r + s, r, s + 1, order, order[s]) for r, order in enumerate(ORDERS) for s in range(5)],
    )
    totals = masks.groupBy("part").agg(F.sum("n").alias("total"))
    grid = totals.withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5 * len(ORDERS) - 1).cast("long")))).join(
        F.broadcast(places), "place"
    )
    up_to = Window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over_ranks = up_to.partitionBy("part", "step").orderBy("rank")
    sums = grid.join(changes, ["part", "step", "rank"], "left").select(
        "part", "step", "rank", "filter_order", "letter", "total",
        *[F.coalesce(F.sum(c).over(over_ranks), F.lit(0)).cast("long").alias(c) for c in measures],
    )
    letters = masks.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(len(FILTERS) - 1)))).filter(
        F.expr("shiftright(mask, i) & 1 = 1")
    )
    fails = letters.groupBy("part", F.substring(F.lit(FILTERS), F.col("i") + 1, F.lit(1)).alias("letter")).agg(
        F.sum("n").alias("fails"), F.sum(F.when(F.expr("mask = shiftleft(1, i)"), F.col("n")).otherwise(0)).alias("only")
    )
    over_steps = up_to.partitionBy("part", "rank").orderBy("step")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return sums.join(fails, ["part", "letter"], "left").select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        (F.col("total") - F.sum("n").over(over_steps)).alias("kept"),
        F.col("n").alias("removed"),
        (zero("fails") - F.col("n")).alias("redundant"),
        zero("only").alias("unique_fails"),
        F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"),
        F.sum("n").over(Window.partitionBy("part", "letter")).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, part: str = "lang", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row per part, order and step; ``labels`` holds ``doc_id``, ``quality`` and ``toxic``."""
    prepare(docs.sparkSession)
    rows = keep(failed_filters(docs, F.col(part), id_column, text_column), "failed")
    return interactions(keep(count_masks(rows, labels), "masks"))
