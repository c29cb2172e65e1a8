"""Bounded samples: rows with the lowest hashes, found without sending rows to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranges of the hash that are counted at a time, as bits.
_BITS = 12
_WHOLE = 60


def lowest(df: DataFrame, most: int, *keys: str) -> DataFrame:
    """Rows of ``df`` with the lowest hashes of ``keys``, ``most`` of them or a hundredth less.

    ``df`` is read a few times, so it should be narrow and written, and its keys distinct.
    Only counts per range of the hash reach the driver: the range in which the
    ``most``-th row lies is cut into finer ones until what is left out does not matter.
    Rows with equal hashes stay or go together.
    """
    place = F.shiftrightunsigned(F.xxhash64(*keys), 64 - _WHOLE)
    low, shift, need = 0, _WHOLE - _BITS, most
    while True:
        inside = df.select(place.alias("place")).filter((F.col("place") >= low) & (F.col("place") < low + (1 << shift + _BITS)))
        counts = inside.groupBy(F.shiftright("place", shift).alias("range")).count().collect()
        for at, n in sorted((r["range"], r["count"]) for r in counts):
            if n > need:
                low = at << shift
                break
            need -= n
        else:
            return df if low == 0 and shift == _WHOLE - _BITS else df.filter(place < low + (1 << shift + _BITS))
        if need * 100 <= most or not shift:
            return df.filter(place < low)
        shift = max(shift - _BITS, 0)
