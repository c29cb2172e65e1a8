from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from starmart.functions import scalars
from tests.frames import frame, values

PERIOD = "tahun int, bulan int"


@pytest.mark.parametrize(
    "period, label, short, text",
    [
        ((2017, 5), "2017-05", "Mei '17", " di Mei 2017"),
        ((2017, 12), "2017-12", "Des '17", " di Desember 2017"),
        ((2017, None), "2017-", None, " di tahun 2017"),
        ((None, 1), "-01", None, " di bulan Januari"),
        ((None, None), "-", None, ""),
    ],
)
def test_period_labels(spark, period, label, short, text):
    year, month = F.col("tahun"), F.col("bulan")
    row = frame(spark, PERIOD, [period]).select(
        scalars.year_month_label(year, month),
        scalars.short_month_label(year, month),
        scalars.period_description(year, month),
    )
    assert values(row) == [(label, short, "Pelanggan aktif bertransaksi" + text)]


def test_safe_ratio(spark):
    df = frame(spark, "n double, d double", [(1.0, 4.0), (1.0, 0.0), (1.0, -2.0), (1.0, None)])
    ratios = df.select(scalars.safe_ratio(F.col("n"), F.col("d")))
    assert [r[0] for r in values(ratios)] == [0.25, 0.0, 0.0, 0.0]


def test_exact_mean_rounds_once_and_half_up(spark):
    df = frame(spark, "t long, n long", [(5, 2), (107, 40), (1, 3), (0, 0), (10**18 + 5, 10)])
    means = df.select(scalars.exact_mean(F.col("t"), F.col("n"), 0))
    assert [r[0] for r in values(means)] == [3.0, 3.0, 0.0, None, float(10**17 + 1)]
    two = df.select(scalars.exact_mean(F.col("t"), F.col("n"), 2))
    assert [r[0] for r in values(two)][:3] == [2.5, 2.68, 0.33]


def test_elapsed_days(spark):
    times = [(datetime(2017, 1, 1), datetime(2017, 1, 2, 12)), (datetime(2017, 1, 1), None)]
    df = frame(spark, "a timestamp, b timestamp", times)
    days = df.select(scalars.elapsed_days(F.col("a"), F.col("b")))
    assert [r[0] for r in values(days)] == [1.5, None]


def test_non_empty(spark):
    df = frame(spark, "s string", [("a",), ("",), (None,), (" ",)])
    assert values(df.filter(scalars.non_empty(F.col("s")))) == [("a",), (" ",)]
