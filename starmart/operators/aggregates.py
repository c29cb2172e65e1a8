"""Grouped measures over a fact and its dimensions."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starmart.functions.scalars import or_zero
from starmart.model import DIMENSION_KEYS, Star
from starmart.operators.joins import attach, attach_all


class Measure(NamedTuple):
    """An aggregate that can be taken in two steps, before and after a join."""

    kind: str
    column: str | None = None

    def first(self) -> Column | None:
        """The step over fact rows; distinct values are kept as group keys instead."""
        if self.kind == "sum":
            return F.sum(self.column)
        if self.kind == "rows":
            return F.count(F.lit(1))
        if self.kind == "values":
            return F.count(self.column)
        return None

    def second(self, name: str | Column) -> Column:
        """The step over the results of the first, held in column ``name``."""
        merged = F.sum(name)
        return merged if self.kind == "sum" else or_zero(merged)


def total(column: str) -> Measure:
    return Measure("sum", column)


def row_count() -> Measure:
    return Measure("rows")


def value_count(column: str) -> Measure:
    return Measure("values", column)


def distinct_count(column: str) -> Measure:
    """Distinct values of a surrogate key. Such keys are dense, so they are counted in bitmaps."""
    return Measure("distinct", column)


def _merged(
    rows: DataFrame, by: list[str], measures: dict[str, Measure], steps: dict[str, Column]
) -> DataFrame:
    """``measures`` per ``by``, those other than distinct counts by ``steps``.

    A distinct count goes by blocks of 32,768 keys: each task sends a bitmap of 4 KB for a block that it
    meets, and the set bits are counted once the bitmaps of a block are merged. Several distinct counts
    share one scan: a row stands once for each of them, and the other measures go with the first.
    """
    counted = {n: m for n, m in measures.items() if m.kind == "distinct"}
    if not counted:
        return rows.groupBy(*by).agg(*[expr.alias(n) for n, expr in steps.items()])
    used = {x for n, m in measures.items() if m.kind != "distinct" for x in (n, m.column)}
    inputs = [c for c in rows.columns if c in used and c not in by]
    stands = [
        F.struct(
            F.lit(i).alias("_of"),
            F.bitmap_bucket_number(F.col(m.column).cast("long")).alias("_block"),
            F.bitmap_bit_position(F.col(m.column).cast("long")).alias("_bit"),
            *[F.col(c) if i == 0 else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in inputs],
        )
        for i, m in enumerate(counted.values())
    ]
    if len(stands) == 1:
        rows = rows.withColumns({n: stands[0][n] for n in ("_of", "_block", "_bit")})
    else:
        rows = rows.select(*by, F.explode(F.array(*stands)).alias("_stand")).select(*by, "_stand.*")
    first = F.col("_of") == 0
    blocks = rows.groupBy(*by, "_of", "_block").agg(
        F.bitmap_construct_agg("_bit").alias("_bitmap"),
        *[expr.alias(n) for n, expr in steps.items()],
    )
    found = {n: F.sum(F.when(F.col("_of") == i, F.bitmap_count("_bitmap"))) for i, n in enumerate(counted)}
    return blocks.groupBy(*by).agg(
        *[
            or_zero(found[n]).alias(n) if n in found else m.second(F.when(first, F.col(n))).alias(n)
            for n, m in measures.items()
        ]
    )


def _aggregate(rows: DataFrame, keys: list[str], aggs: list[Column]) -> DataFrame:
    if not aggs:
        return rows.select(*keys).distinct()
    return rows.groupBy(*keys).agg(*aggs)


def aggregate(
    star: Star,
    fact: str,
    dimensions: tuple[str, ...],
    measures: dict[str, Measure],
    by: dict[str, tuple[str, Column]] | None = None,
    where: dict[str, Column] | None = None,
    year: int | None = None,
    month: int | None = None,
) -> DataFrame:
    """Measures of ``fact`` inner-joined with ``dimensions``, grouped by ``by``.

    ``by`` maps an output name to a dimension and an expression on its columns, or
    to the fact for a column of its own; ``where`` maps a dimension to a predicate
    on its columns.

    Small dimensions are joined first, by broadcast, then large ones that a
    predicate makes selective. Ahead of the last large one the rows are summed
    per key of it, so the shuffle carries one row per key and map task however
    often the key occurs.
    """
    by, where = by or {}, where or {}
    columns = {
        d: [expr.alias(name) for name, (table, expr) in by.items() if table == d]
        for d in dimensions
    }
    columns = {d: c for d, c in columns.items() if c or d in where or not star.holds(fact, d)}
    large = sorted((d for d in columns if not star.is_small(d)), key=lambda d: d not in where)
    keys = [DIMENSION_KEYS[d] for d in columns]
    inputs = [m.column for m in measures.values() if m.column]
    inputs += [name for name, (table, _) in by.items() if table == fact]
    scan = lambda part: part.fact(fact, year, month).select(*dict.fromkeys(keys + inputs))

    if not large:
        rows = attach_all(scan(star), star, columns, where)
        return _merged(rows, list(by), measures, {n: m.first() for n, m in measures.items() if m.kind != "distinct"})

    last = large[-1]
    known = [name for name, (table, _) in by.items() if table != last]
    distinct = [m.column for m in measures.values() if m.kind == "distinct"]
    kept = list(dict.fromkeys([DIMENSION_KEYS[last], *known, *distinct]))
    steps = [m.first().alias(n) for n, m in measures.items() if m.kind != "distinct"]

    def met(part: Star) -> DataFrame:
        rows = attach_all(scan(part), part, {d: c for d, c in columns.items() if d != last}, where)
        return attach(_aggregate(rows, kept, steps), part, last, *columns[last], where=where.get(last))

    rows = reduce(DataFrame.unionByName, [met(part) for part in star.parts(fact, last)])
    return _merged(rows, list(by), measures, {n: m.second(n) for n, m in measures.items() if m.kind != "distinct"})
