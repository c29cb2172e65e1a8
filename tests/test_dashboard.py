from __future__ import annotations

from itertools import product

import pytest

from starmart.filters import FilterSpec
from starmart.operators.ordering import top
from starmart.plans import dashboard, joined
from tests.frames import (
    CUSTOMERS, DAYS, PRODUCTS, SALES, frame, money, small_star, star, values,
)

MATRIX = [
    FilterSpec(year=y, month=m, category=c, state=s)
    for y, m, c, s in product((None, 2017), (None, 3), (None, "books"), (None, "SP"))
]


def _left(spec: FilterSpec) -> list[tuple]:
    """Sales that a filter set leaves, by brute force."""
    days = {d[0]: d for d in DAYS}
    products = {p[0]: p for p in PRODUCTS}
    customers = {c[0]: c for c in CUSTOMERS}
    kept = []
    for sale in SALES:
        day, item, customer = days[sale[0]], products[sale[1]], customers[sale[2]]
        if (
            spec.year in (None, day[4])
            and spec.month in (None, day[3])
            and spec.category in (None, item[3])
            and spec.state in (None, customer[3])
        ):
            kept.append(sale)
    return kept


@pytest.mark.parametrize("spec", MATRIX, ids=str)
def test_filter_matrix(spark, spec):
    left = _left(spec)
    summary = values(dashboard.kpi_sales_summary(small_star(spark), spec))
    assert summary == [
        (
            len({s[2] for s in left}),
            len({s[1] for s in left}),
            sum(s[4] for s in left),
            float(sum(s[5] for s in left)),
        )
    ]


@pytest.mark.parametrize("spec", MATRIX[::5], ids=str)
def test_ignored_filters(spark, spec):
    paid = [(10, 2, 1, 2, money(5)), (11, 4, 3, 2, money(5)), (12, 4, 2, 1, money(5))]
    s = small_star(spark, fakta_pembayaran=paid)
    days = {d[0]: d for d in DAYS}
    customers = {c[0]: c for c in CUSTOMERS}

    all_customers = [c for c in CUSTOMERS if spec.state in (None, c[3])]
    assert values(dashboard.kpi_customers_all(s, spec)) == [(len(all_customers),)]
    assert values(dashboard.top5_states_all(s, spec)) == [("SP", 2), ("RJ", 1)]

    counted: dict[str, int] = {}
    for _, day, customer, method, _ in paid:
        if (
            spec.year in (None, days[day][4])
            and spec.month in (None, days[day][3])
            and spec.state in (None, customers[customer][3])
        ):
            name = {1: "boleto", 2: "credit_card"}[method]
            counted[name] = counted.get(name, 0) + 1
    assert dict(values(dashboard.payment_method_counts(s, spec))) == counted

    labels = {row[0] for row in values(dashboard.top10_categories(s, spec))}
    products = {p[0]: p for p in PRODUCTS}
    assert labels == {products[x[1]][3] for x in _left(spec.without("category"))}


def test_filter_lists(spark):
    s = small_star(spark)
    assert values(dashboard.filter_years(s)) == [(2018,), (2017,), (2016,)]
    assert values(dashboard.filter_months(s)) == [(1,), (3,), (12,)]
    assert values(dashboard.filter_months(s, 2017)) == [(1,), (3,)]
    assert values(dashboard.filter_categories(s)) == [("books",), ("toys",)]
    assert values(dashboard.filter_states(s)) == [("RJ",), ("SP",)]


def test_hybrid_operators_follow_the_time_filter(spark):
    s = small_star(spark)
    assert values(dashboard.kpi_customers(s)) == [(5,)]
    assert values(dashboard.kpi_customers(s, FilterSpec(year=2018))) == [(1,)]
    assert values(dashboard.top5_states(s, FilterSpec(year=2018))) == [("SP", 1)]
    assert values(dashboard.top5_states(s)) == [("SP", 2), ("RJ", 1)]


def test_top_items_choose_the_label(spark):
    s = small_star(spark)
    assert values(dashboard.top10_items(s, top_by="category"))[0] == ("books", 9)
    assert values(dashboard.top10_items(s, top_by="nonsense"))[0] == ("P1", 6)


def test_categories_count_the_empty_name_but_not_null(spark):
    assert values(dashboard.kpi_categories(small_star(spark))) == [(3,)]


def test_empty_star(spark):
    s = star(spark)
    assert values(dashboard.kpi_sales_summary(s)) == [(0, 0, 0, 0.0)]
    assert values(dashboard.kpi_units(s)) == [(0,)]
    assert values(dashboard.kpi_revenue(s)) == [(0.0,)]
    assert values(dashboard.kpi_avg_delivery(s)) == [(None,)]
    assert values(dashboard.kpi_categories(s)) == [(0,)]
    assert values(dashboard.filter_states(s)) == []
    assert values(dashboard.top10_products(s)) == []


def test_missing_and_orphan_keys_drop_out_of_inner_joins(spark):
    gaps = [
        (1, None, 1, 1, 1, money(1)),
        (1, 1, 99, 1, 1, money(2)),
        (None, 1, 1, 1, 1, money(4)),
        (1, 1, 1, 1, 1, money(8)),
    ]
    s = small_star(spark, fakta_penjualan=gaps)
    assert values(dashboard.kpi_revenue(s)) == [(8.0,)]
    # Only the customer join is an outer one here.
    ranking = values(dashboard.top10_customers_revenue(s))
    assert ranking == [("C1", 8.0), ("99", 2.0)]
    assert values(dashboard.top10_customers_revenue(s, FilterSpec(state="SP"))) == [("C1", 8.0)]
    assert dict(values(joined.join_left_customer_label(s))) == {"C1": 8.0, "99": 2.0}


def test_small_large_and_enforced_plans_agree(spark):
    """Broadcast, summed-before-shuffle and left-out joins give one answer."""
    spec = FilterSpec(year=2017, category="books")
    tables = dict(
        dim_waktu=DAYS, dim_produk=PRODUCTS, dim_pelanggan=CUSTOMERS,
        dim_seller=[(1, "S1", "x", "SP"), (2, "S2", "y", "AM"), (3, "S3", "y", None)],
        fakta_penjualan=SALES,
    )
    sizes = {"dim_waktu": 5, "dim_produk": 5, "dim_pelanggan": 5, "dim_seller": 3}
    stars = [
        star(spark, **tables),
        star(spark, row_counts=sizes, **tables),
        star(spark, row_counts=sizes, enforced=True, **tables),
        star(spark, row_counts={"dim_waktu": 5}, enforced=True, **tables),
    ]
    operators = [
        lambda s: dashboard.kpi_sales_summary(s, spec),
        lambda s: dashboard.kpi_sales_summary(s),
        lambda s: dashboard.top5_states_active(s, FilterSpec(year=2017)),
        lambda s: dashboard.top10_sellers_units(s),
        lambda s: dashboard.sales_by_year_month(s),
        lambda s: dashboard.top10_products(s),
        lambda s: dashboard.kpi_categories(s),
        lambda s: dashboard.top10_customers_revenue(s),
    ]
    for operator in operators:
        answers = [values(operator(s)) for s in stars]
        assert all(a == answers[0] for a in answers[1:])


def test_sales_by_period_picks_the_grain(spark):
    s = small_star(spark)
    assert values(dashboard.sales_by_period(s)) == [
        ("2016-12", 10.0, 1), ("2017-01", 58.82, 9), ("2017-03", 159.99, 3), ("2018-03", 60.1, 4),
    ]
    assert values(dashboard.sales_by_period(s, FilterSpec(year=2017))) == [
        ("01", 58.82, 9), ("03", 159.99, 3),
    ]
    assert values(dashboard.sales_by_period(s, FilterSpec(month=3))) == [
        ("2017", 159.99, 3), ("2018", 60.1, 4),
    ]
    assert values(dashboard.sales_by_period(s, FilterSpec(year=2017, month=1))) == [
        ("5 Jan", 50.05, 3), ("20 Jan", 8.77, 6),
    ]
    with pytest.raises(ValueError):
        dashboard.sales_by_day(s, FilterSpec(year=2017))


def test_revenue_per_period_adds_up(spark):
    s = small_star(spark)
    parts = [row[2] for row in values(dashboard.sales_by_year_month(s))]
    assert sum(parts) == pytest.approx(values(dashboard.kpi_revenue(s))[0][0])


def test_means_round_half_up_and_keep_null_groups_first(spark):
    deliveries = [
        (1, 1, 1, 1, 1), (1, 1, 1, 1, 2), (1, 2, 1, 2, 2), (1, 2, 1, 2, 3),
        (1, 1, 1, 1, 1), (1, 2, 1, 1, 1), (1, 2, 1, 1, 1), (1, 1, 1, 1, 2),
        (1, 3, 1, 2, None),
    ]
    s = small_star(spark, fakta_pengiriman=deliveries)
    # SP: 13 / 8 = 1.625
    assert values(dashboard.avg_delivery_state(s)) == [("RJ", None), ("SP", 1.63)]
    assert values(dashboard.avg_delivery_category(s)) == [("books", 3, 2.5), ("toys", 6, 1.33)]
    assert values(dashboard.kpi_avg_delivery(s)) == [(1.63,)]


def test_ratings(spark):
    reviews = [(1, 1, 1, 5), (2, 1, 1, 4), (3, 1, 1, 3), (3, 1, 1, None)]
    s = small_star(spark, fakta_review=reviews)
    assert values(dashboard.rating_by_year(s)) == [(2016, 5.0), (2017, 3.5)]
    assert values(dashboard.rating_by_month(s)) == [("2016-12", 5.0), ("2017-01", 3.5)]


def test_payment_share(spark):
    paid = [(i, 1, 1, m, money(1)) for i, m in enumerate((1, 2, 2, 2))]
    s = small_star(spark, fakta_pembayaran=paid)
    assert values(dashboard.payment_share(s)) == [("credit_card", 3, 75.0), ("boleto", 1, 25.0)]


def test_ties_at_the_cut_go_by_label(spark):
    rows = [(f"L{i:02}", 100 - i if i < 8 else 7) for i in range(12)][::-1]
    cut = values(top(frame(spark, "label string, total_qty long", rows), 10, "total_qty", "label"))
    assert [label for label, _ in cut] == [f"L{i:02}" for i in range(10)]


def test_seller_rankings_from_both_facts(spark):
    s = small_star(spark, fakta_seller=[(1, 1, 1, 3), (2, 2, 1, 9), (3, 1, 1, 4)])
    assert values(dashboard.rank_seller_volume(s)) == [("S2", 9), ("S1", 7)]
    assert values(dashboard.top10_sellers_units(s, k=2)) == [
        ("S2", 8, 97.77), ("S1", 5, 61.05),
    ]
    assert values(dashboard.top10_sellers_revenue(s, k=1)) == [("S3", 4, 130.09)]
