"""Joins of a fact with its dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starmart.model import DIMENSION_KEYS, Star


def attach(
    rows: DataFrame,
    star: Star,
    dimension: str,
    *columns: Column | str,
    where: Column | None = None,
    how: str = "inner",
) -> DataFrame:
    """Join ``rows`` with a dimension narrowed to its key and ``columns``.

    A dimension of known small size is broadcast. Any other is left to a
    shuffle join, where adaptive execution splits the partition of a hot key.
    """
    key = DIMENSION_KEYS[dimension]
    side = star[dimension]
    if where is not None:
        side = side.filter(where)
    side = side.select(key, *columns)
    if star.is_small(dimension):
        side = F.broadcast(side)
    return rows.join(side, key, how)


def attach_all(
    rows: DataFrame, star: Star, columns: dict[str, list], where: dict[str, Column]
) -> DataFrame:
    """Attach several dimensions: small filtered ones first, large ones last."""
    order = sorted(columns, key=lambda d: (not star.is_small(d), d not in where))
    for dimension in order:
        rows = attach(rows, star, dimension, *columns[dimension], where=where.get(dimension))
    return rows


def reshuffled(df: DataFrame, key: str) -> DataFrame:
    """``df`` off the partitioning by ``key`` that its own joins left it in.

    Adaptive execution splits a hot key's partition only where both sides of a
    join come straight from a shuffle. A narrow side that was itself joined on
    ``key`` would go in without one; moved by another hash, it is shuffled again.
    """
    return df.repartition(F.xxhash64(key))
