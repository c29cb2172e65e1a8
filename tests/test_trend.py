from __future__ import annotations

import numpy as np
import pytest

from starmart.plans import trend
from tests.frames import frame, money, small_star, star, values

MONTHS = "tahun int, bulan int, total_penjualan double, jumlah_transaksi long"
CATEGORY_MONTHS = "kategori string, tahun int, bulan int, total double"


def _months(spark, rows):
    return frame(spark, MONTHS, rows)


def test_fit_is_least_squares_over_positions(spark):
    # A gap in the calendar is none on the axis.
    rows = [(2016, 11, 10.0, 3), (2017, 2, 14.0, 2), (2017, 3, 11.0, 9), (2017, 9, 30.0, 4)]
    slope, intercept = np.polyfit(range(4), [r[2] for r in rows], 1)
    count_slope, count_intercept = np.polyfit(range(4), [r[3] for r in rows], 1)
    fit = {r.metric: r for r in trend.linear_fit(_months(spark, rows)).collect()}
    assert fit["penjualan"].slope == pytest.approx(slope)
    assert fit["penjualan"].intercept == pytest.approx(intercept)
    assert fit["transaksi"].slope == pytest.approx(count_slope)
    assert fit["transaksi"].intercept == pytest.approx(count_intercept)
    assert fit["penjualan"].n == 4 and fit["penjualan"].valid

    ahead = trend.forecast(_months(spark, rows)).collect()
    assert [(r.ke, r.tahun, r.bulan) for r in ahead] == [(1, 2017, 10), (2, 2017, 11), (3, 2017, 12)]
    assert [r.penjualan for r in ahead] == pytest.approx([intercept + slope * x for x in (4, 5, 6)])


def test_one_month_and_none(spark):
    one = _months(spark, [(2017, 5, 100.0, 7)])
    assert values(trend.linear_fit(one)) == [
        ("penjualan", 1, 0.0, 0.0, False), ("transaksi", 1, 0.0, 0.0, False),
    ]
    assert values(trend.forecast(one)) == [
        (1, 2017, 6, 0.0, 0), (2, 2017, 7, 0.0, 0), (3, 2017, 8, 0.0, 0),
    ]
    assert values(trend.growth(one)) == [(0.0, "stabil")]
    none = _months(spark, [])
    assert values(trend.growth(none)) == [(0.0, "stabil")]
    assert [r[3:] for r in values(trend.forecast(none))] == [(0.0, 0)] * 3


def test_projection_wraps_the_year_and_stays_positive(spark):
    falling = _months(spark, [(2017, 11, 100.0, 10), (2017, 12, 10.0, 1)])
    assert values(trend.forecast(falling)) == [
        (1, 2018, 1, 0.0, 0), (2, 2018, 2, 0.0, 0), (3, 2018, 3, 0.0, 0),
    ]


@pytest.mark.parametrize(
    "second, arah", [(103.0, "naik"), (97.0, "turun"), (100.5, "stabil"), (99.5, "stabil")]
)
def test_direction(spark, second, arah):
    months = _months(spark, [(2017, 1, 100.0, 1), (2017, 2, second, 1)])
    [(persen, found)] = values(trend.growth(months))
    assert found == arah
    assert persen == pytest.approx(100 * (second - 100) / ((second + 100) / 2))


def test_category_trend_edge_cases(spark):
    rows = [("two", 2017, m, 1.0 * m) for m in (1, 2)]
    rows += [("gap", 2017, m, v) for m, v in ((1, 10.0), (5, 20.0), (6, 30.0))]
    rows += [("flat", 2017, m, 5.0) for m in (1, 2, 3)]
    rows += [("zero", 2017, m, 0.0) for m in (1, 2, 3)]
    rows += [(None, 2017, m, float(m)) for m in (1, 2, 3)]
    found = {r.kategori: (r.persen, r.rata) for r in trend.category_trend_of(
        frame(spark, CATEGORY_MONTHS, rows)).collect()}
    assert found == {
        "gap": (50.0, 20.0), "flat": (0.0, 5.0), "zero": (0.0, 0.0), None: (50.0, 2.0),
    }


def test_movers_take_both_ends_of_one_order(spark):
    rates = frame(
        spark, "kategori string, persen double, rata double",
        [("a", 5.0, 1.0), ("b", 5.0, 1.0), ("c", 1.0, 1.0), ("d", -3.0, 1.0), ("e", -3.0, 1.0)],
    )
    rows = values(trend.movers(rates, k=2))
    assert [r for r in rows if r[0] == "naik"] == [("naik", 1, "a", 5.0), ("naik", 2, "b", 5.0)]
    assert [r for r in rows if r[0] == "turun"] == [("turun", 1, "e", -3.0), ("turun", 2, "d", -3.0)]


def _advice(
    spark, persen=0.0, arah="stabil", moves=(), reviews=(4.0, 100, 0), cities=(), mean=10.0, mix=()
):
    rows = trend.advise(
        frame(spark, "persen double, arah string", [(persen, arah)]),
        frame(spark, "side string, rank int, kategori string, persen double", list(moves)),
        frame(spark, "rata2 double, jumlah_review long, review_rendah long", [reviews]),
        frame(spark, "kota string, state string, rata_rata_hari double, jumlah long", list(cities)),
        frame(spark, "rata2 double", [(mean,)]),
        frame(spark, "metode_pembayaran string, jumlah long, total double", list(mix)),
    )
    return values(rows)


def test_only_the_first_rule_always_fires(spark):
    assert _advice(spark) == [("R1c", 1, "Sedang", "Penjualan", "stabil", 0.0)]


def test_each_rule_fires_above_its_threshold(spark):
    rows = _advice(
        spark,
        persen=-1.25,
        arah="turun",
        moves=[
            ("naik", 1, "up", 2.01), ("naik", 2, "edge", 2.0),
            ("turun", 1, "down", -2.01), ("turun", 2, "edge", -2.0),
        ],
        reviews=(3.0, 100, 16),
        cities=[("Kota", "SP", 13.1, 9), ("Lain", "RJ", 12.0, 9)],
        mix=[("card", 61, 1.0), ("boleto", 39, 1.0)],
    )
    assert rows == [
        ("R1a", 1, "Tinggi", "Penjualan", "turun", -1.3),
        ("R2", 11, "Tinggi", "Produk", "down", -2.0),
        ("R4", 31, "Tinggi", "Kepuasan Pelanggan", None, 16.0),
        ("R3", 21, "Sedang", "Produk", "up", 2.0),
        ("R5", 41, "Sedang", "Logistik", "Kota (SP)", 13.1),
        ("R6", 51, "Rendah", "Pembayaran", "card", 61.0),
    ]


def test_no_rule_fires_at_its_threshold(spark):
    rows = _advice(
        spark, persen=1.2, arah="naik", reviews=(3.0, 100, 15),
        cities=[("Kota", "SP", 13.0, 9)], mix=[("card", 60, 1.0), ("boleto", 40, 1.0)],
    )
    assert rows == [("R1b", 1, "Sedang", "Penjualan", "naik", 1.2)]


def test_a_city_without_durations_silences_the_logistics_rule(spark):
    deliveries = [(1, 3, 1, 1, None)] * 5 + [(1, 1, 1, 1, 90)] * 5 + [(1, 2, 1, 1, 1)] * 20
    deliveries += [(1, 4, 1, 1, 500)] * 4
    s = small_star(spark, fakta_pengiriman=deliveries)
    cities = trend.slowest_cities(s)
    assert values(cities) == [
        ("Niterói", "RJ", None, 5), ("Santos", "SP", 90.0, 5), ("Campinas", "SP", 1.0, 20),
    ]
    rules = {r.rule_id for r in trend.recommendations(s).collect()}
    assert "R5" not in rules


def test_series_joins_history_and_projection(spark):
    months = _months(spark, [(2017, 11, 10.0, 1), (2017, 12, 12.5, 1)])
    assert values(trend.series(months)) == [
        (0, "Nov '17", 10.0, None),
        (1, "Des '17", 12.5, 12.5),
        (2, "Jan '18 (proy.)", None, 15.0),
        (3, "Feb '18 (proy.)", None, 17.5),
        (4, "Mar '18 (proy.)", None, 20.0),
    ]


def test_a_last_month_without_sales_gives_no_joining_point(spark):
    months = _months(spark, [(2017, 5, 10.0, 1), (2017, 6, 0.0, 0)])
    assert values(trend.series(months))[1] == (1, "Jun '17", 0.0, None)


def test_summaries(spark):
    reviews = [(1, 1, 1, s) for s in (1, 2, 5, 5, None)]
    s = small_star(
        spark, fakta_review=reviews, fakta_pengiriman=[(1, 1, 1, 1, d) for d in (1, 2, 2, None)],
        fakta_pembayaran=[(1, 1, 1, 1, money(5)), (2, 1, 1, 2, money(7)), (3, 1, 1, 3, money(9))],
    )
    assert values(trend.review_summary(s)) == [(3.25, 5, 2)]
    assert values(trend.delivery_summary(s)) == [(1.7,)]
    assert values(trend.payment_mix(s)) == [("boleto", 1, 5.0), ("credit_card", 1, 7.0)]
    assert values(trend.last_period(s)) == [(2018, 3)]
    assert values(trend.review_summary(star(spark))) == [(None, 0, 0)]
    assert values(trend.top5_categories(s, k=2)) == [
        ("livros", "books", 127.77, 9), (None, None, 99.99, 1),
    ]
    assert values(trend.bottom5_categories(s, k=1)) == [("outros", "", 1.0, 1)]
