"""Surrogate keys and the checks that stand in for key constraints."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import StructType

from starmart.model import BROADCAST_ROWS, DIMENSION_KEYS, FACT_KEYS, FOREIGN_KEYS, Star
from starmart.session import COMPACT, scratch_table

# monotonically_increasing_id() holds the partition above this many bits of row index.
_INDEX_BITS = 33
# Keys per row of a table of bits, as a power of two.
_BLOCK_BITS = 6


def surrogate_keys(
    df: DataFrame,
    business_key: str | Sequence[str],
    key: str = "key",
    known: DataFrame | None = None,
) -> DataFrame:
    """Add ``key``: 1, 2, 3, … in the order of ``business_key``, of one column or several.

    ``known(business_key, key)`` holds the keys given earlier: rows found there keep
    theirs, the others are numbered on from the highest.

    Rows are range-partitioned and sorted, so a row's number is its index in its
    partition plus the rows of the partitions before it. The indexed rows are
    written first: the counts and the numbering then read the same layout even
    if tasks are run again.
    """
    names = [business_key] if isinstance(business_key, str) else list(business_key)
    if known is not None:
        given = known.select(*names, key)
        last = given.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
        fresh = surrogate_keys(df.join(given, names, "left_anti"), names, key)
        fresh = fresh.withColumn(key, F.col(key) + F.lit(last))
        return df.join(given, names).unionByName(fresh)
    order = [F.col(name).asc_nulls_last() for name in names]
    indexed = scratch_table(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_index", F.monotonically_increasing_id()),
        "keys",
        COMPACT,
    )
    part = F.shiftright("_index", _INDEX_BITS)
    # One row per range partition, so a single-task window is enough.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        indexed.groupBy(part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    in_part = F.col("_index").bitwiseAND(F.lit((1 << _INDEX_BITS) - 1))
    return (
        indexed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(key, F.col("_offset") + in_part + F.lit(1))
        .drop("_part", "_offset", "_index")
    )


def cleanse(df: DataFrame, business_key: str) -> DataFrame:
    """Drop rows without a business key and keep one row per key.

    Of rows that differ the lowest stays, column by column, so a run that is repeated
    keeps the same one.
    """
    others = [name for name in df.columns if name != business_key]
    rows = df.dropna(subset=[business_key])
    if not others:
        return rows.distinct()
    lowest = rows.groupBy(business_key).agg(F.min(F.struct(*others)).alias("_row"))
    return lowest.select(*[name if name == business_key else f"_row.{name}" for name in df.columns])


class Cleansed(NamedTuple):
    """``accepted`` has the asked types and one row per key. ``rejected`` says why the others
    are left out: the row as JSON, its first faulty column and the reason, all faulty columns, and
    how many such rows there are. Rows accepted and rows rejected add up to the rows given."""

    accepted: DataFrame
    rejected: DataFrame


def cleanse_typed(df: DataFrame, schema: StructType, business_key: str) -> Cleansed:
    """Cast ``df`` to ``schema``, and tell rows that cannot be from those that can.

    A row is rejected when a value is not of its column's type, when its key is missing, and
    when its key has been accepted once already; of such rows the lowest is accepted.
    """
    given = F.to_json(F.struct(*[F.col(f.name) for f in schema.fields]), {"ignoreNullFields": "false"})
    faults = [
        F.when(
            F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull(),
            F.struct(F.lit(f.name).alias("column"), F.lit(f"not {f.dataType.simpleString()}").alias("reason")),
        )
        for f in schema.fields
    ]
    nameless = F.when(
        F.col(business_key).isNull(),
        F.struct(F.lit(business_key).alias("column"), F.lit("missing").alias("reason")),
    )
    typed = df.select(
        *[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields],
        given.alias("_row"),
        F.array_compact(F.array(nameless, *faults)).alias("_faults"),
    )
    names = schema.fieldNames()
    faulty = (
        typed.filter(F.size("_faults") > 0)
        .groupBy("_row", "_faults").agg(F.count(F.lit(1)).alias("rows"))
        .select(
            F.col("_row").alias("row"), F.col("_faults")[0]["column"].alias("column"),
            F.col("_faults")[0]["reason"].alias("reason"), F.col("_faults").alias("faults"), "rows",
        )
    )
    sound = typed.filter(F.size("_faults") == 0)
    # Equal rows are counted before any key is brought together.
    counted = sound.groupBy(*names, "_row").agg(F.count(F.lit(1)).alias("rows"))
    others = [name for name in names if name != business_key]
    lowest = counted.groupBy(business_key).agg(F.min(F.struct(*others, "_row")).alias("_lowest"))
    accepted = lowest.select(*[n if n == business_key else f"_lowest.{n}" for n in names])
    chosen = lowest.select(business_key, F.col("_lowest._row").alias("_chosen"))
    left = F.col("rows") - F.when(F.col("_row") == F.col("_chosen"), 1).otherwise(0)
    repeated = (
        counted.join(chosen, business_key).withColumn("rows", left).filter("rows > 0")
        .select(
            F.col("_row").alias("row"), F.lit(business_key).alias("column"), F.lit("repeated").alias("reason"),
            F.array(F.struct(F.lit(business_key).alias("column"), F.lit("repeated").alias("reason"))).alias("faults"),
            "rows",
        )
    )
    return Cleansed(accepted, faulty.unionByName(repeated))


def cleansing_counts(cleansed: Cleansed) -> DataFrame:
    """Rows accepted, and rows rejected by column and reason."""
    none = F.lit(None).cast("string")
    accepted = cleansed.accepted.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit("accepted").alias("outcome"), none.alias("column"), none.alias("reason"), "rows"
    )
    rejected = cleansed.rejected.groupBy("column", "reason").agg(F.sum("rows").alias("rows"))
    return accepted.union(rejected.select(F.lit("rejected").alias("outcome"), "column", "reason", "rows"))


def _labelled(df: DataFrame, table: str, column: str) -> DataFrame:
    return df.select(F.lit(table).alias("table"), F.lit(column).alias("column"), "*")


def check_foreign_keys(star: Star) -> DataFrame:
    """Fact rows per foreign key whose non-NULL value has no dimension row.

    Keys of dimensions number their rows, so they are held as 64 bits a row. Where each dimension is known to fill
    at most ``BROADCAST_ROWS`` such rows, the keys of the facts are looked up where they lie; otherwise they are
    counted per value and shuffled.
    """
    found = [
        star[fact].select(F.lit(fact).alias("table"), F.explode(_stacked(dimensions)).alias("x"))
        for fact, dimensions in FOREIGN_KEYS.items()
    ]
    used = (
        reduce(DataFrame.unionByName, found)
        .select("table", "x.column", "x.value").filter("value IS NOT NULL")
    )
    known = reduce(
        DataFrame.unionByName,
        [
            star[d].select(F.lit(key).alias("column"), F.col(key).cast("long").alias("value"))
            for d, key in DIMENSION_KEYS.items()
        ],
    )
    most = BROADCAST_ROWS << _BLOCK_BITS
    block = F.shiftright("value", _BLOCK_BITS).alias("block")
    bit = F.col("value").bitwiseAND(F.lit((1 << _BLOCK_BITS) - 1))
    held = known.filter("value IS NOT NULL").groupBy("column", block).agg(_bits())
    if all(star.row_counts.get(d, most) < most for d in DIMENSION_KEYS):
        counted, held = used.withColumn("n", F.lit(1).cast("long")), F.broadcast(held)
    else:
        counted = used.groupBy("table", "column", "value").agg(F.count(F.lit(1)).alias("n"))
    # An anti join would be pushed below the sums and the union, to every fact by itself.
    orphans = (
        counted.withColumn("block", block).join(held, ["column", "block"], "left")
        .filter(F.col("bits").isNull() | (F.getbit("bits", bit) == 0)).select("table", "column", "n")
    )
    every = _zeros(star, [(t, DIMENSION_KEYS[d]) for t, ds in FOREIGN_KEYS.items() for d in ds])
    return orphans.union(every).groupBy("table", "column").agg(F.sum("n").alias("orphans"))


def _stacked(dimensions: Sequence[str]) -> Column:
    """The keys of one fact row, one under the other, so that the fact is read once."""
    return F.array(
        *[
            F.struct(F.lit(DIMENSION_KEYS[d]).alias("column"), F.col(DIMENSION_KEYS[d]).cast("long").alias("value"))
            for d in dimensions
        ]
    )


def check_unique_keys(star: Star) -> DataFrame:
    """Values per unique column that occur more than once.

    A missing primary key counts as such a value; a unique label may be missing.

    Keys are first counted per block of 64 that may stand, beside a bit for each that does. Only blocks
    with more keys than bits, which are written first, hold repeated ones; the keys of these are counted singly.
    """
    label = ("dim_metode_pembayaran", "metode_pembayaran")
    primary = [*DIMENSION_KEYS.items(), *FACT_KEYS.items()]
    keys = reduce(
        DataFrame.unionByName,
        [
            _labelled(star[table].select(F.col(column).cast("long").alias("value")), table, column)
            for table, column in primary
        ],
    )
    present = keys.filter("value IS NOT NULL").withColumn("block", F.shiftright("value", _BLOCK_BITS))
    crowded = scratch_table(
        present.groupBy("table", "column", "block").agg(F.count(F.lit(1)).alias("n"), _bits())
        .filter(F.col("n") > F.bit_count("bits")).select("table", "column", "block"),
        "crowded",
        COMPACT,
    )
    if crowded.count() <= BROADCAST_ROWS:
        crowded = F.broadcast(crowded)
    repeated = (
        present.join(crowded, ["table", "column", "block"], "left_semi")
        .groupBy("table", "column", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    )
    missing = keys.filter("value IS NULL").select("table", "column").distinct()
    labels = star[label[0]].groupBy(label[1]).agg(F.count(F.lit(1)).alias("n"))
    twice = _labelled(labels.filter(F.col(label[1]).isNotNull() & (F.col("n") > 1)).select(), *label)
    one = F.lit(1).cast("long").alias("n")
    broken = reduce(DataFrame.union, [df.select("table", "column", one) for df in (repeated, missing, twice)])
    every = _zeros(star, [*primary, label])
    return broken.union(every).groupBy("table", "column").agg(F.sum("n").alias("duplicates"))


def _bits() -> Column:
    """The values of a block as bits."""
    return F.bit_or(F.expr(f"shiftleft(1L, int(value & {(1 << _BLOCK_BITS) - 1}))")).alias("bits")


def _zeros(star: Star, columns: Sequence[tuple[str, str]]) -> DataFrame:
    """A row for each of the columns, also for those that nothing is wrong with."""
    rows = F.explode(F.array(*[F.struct(*map(F.lit, row)) for row in columns])).alias("x")
    return star[next(iter(DIMENSION_KEYS))].sparkSession.range(1).select(rows).select(
        F.col("x.col1").alias("table"), F.col("x.col2").alias("column"), F.lit(0).cast("long").alias("n")
    )
