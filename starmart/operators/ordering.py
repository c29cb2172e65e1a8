"""Sort orders and top-k with a fixed answer among ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def descending(name: str) -> Column:
    return F.col(name).desc_nulls_first()


def ascending(name: str) -> Column:
    return F.col(name).asc_nulls_last()


def ranked(df: DataFrame, by: str, *ties: str) -> DataFrame:
    return df.orderBy(descending(by), *[ascending(t) for t in ties])


def top(df: DataFrame, k: int, by: str, *ties: str) -> DataFrame:
    return ranked(df, by, *ties).limit(k)


def bottom(df: DataFrame, k: int, by: str, *ties: str) -> DataFrame:
    return df.orderBy(ascending(by), *[ascending(t) for t in ties]).limit(k)
