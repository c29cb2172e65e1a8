"""The weighted plans of the operational side against plain joins."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from starmart.model import OPERATIONAL_SCHEMAS
from starmart.plans import pairs
from tests.frames import frame, money, small_star, values

START = datetime(2017, 1, 30)


@pytest.fixture(scope="module")
def op(spark):
    """Orders with several payments and reviews, none at all, and rows that match nothing."""
    rows = {
        "orders": [
            (o, c, START + timedelta(days=o), None if o == 3 else START + timedelta(days=2 * o, hours=o))
            for o, c in ((1, 1), (2, 1), (3, 2), (4, 3), (5, 99), (6, 2))
        ],
        "order_items": [
            (1, 1, 1, 1, money(10), 1), (1, 2, 2, 1, money("5.5"), 1), (1, 3, 1, 2, money(3), 1),
            (2, 1, 3, 2, money(7), 1), (3, 1, 2, 1, money(8), 2), (4, 1, 77, 1, money(9), 1),
            (4, 2, 1, 66, money(2), 1), (5, 1, 1, 1, money(4), 1), (9, 1, 1, 1, money(100), 1),
        ],
        "products": [
            (1, "P1", "a", "a", 1, 1), (2, "P2", "b", "b", 1, 1), (3, "P3", None, None, 1, 1),
        ],
        "category_translation": [],
        "customers": [(1, "C1", "X", "SP"), (2, "C2", "Y", "RJ"), (3, "C3", "X", ""), (4, "C4", "Z", None)],
        "sellers": [(1, "S1", "X", "SP"), (2, "S2", "Y", "RJ")],
        "order_payments": [
            (1, 1, "c", "card", money(1)), (1, 2, "v", "voucher", money(1)),
            (1, 3, "v", "voucher", money(1)), (2, 1, "c", "card", money(1)),
            (3, 1, "n", None, money(1)), (3, 2, "v", "voucher", money(1)),
            (4, 1, "c", "card", money(1)), (5, 1, "c", "card", money(1)),
        ],
        "order_reviews": [
            (1, 1, 5), (2, 1, 2), (3, 2, 4), (4, 4, None), (5, 5, 1), (None, 3, 3), (7, 88, 5),
        ],
    }
    tables = {name: frame(spark, OPERATIONAL_SCHEMAS[name], r) for name, r in rows.items()}
    for name, df in tables.items():
        df.createOrReplaceTempView(f"op_{name}")
    return tables


_ITEMS = "FROM op_orders o JOIN op_order_items i USING (order_id)"
_DAYS = """round(cast(avg(unix_timestamp(order_delivered_customer_date)
  - unix_timestamp(order_purchase_timestamp)) AS decimal(30,12)) / 86400, {})"""
PLAIN = {
    "sales_by_category": f"""SELECT product_category_name, cast(sum(price) AS double) {_ITEMS}
JOIN op_products USING (product_id) JOIN op_customers USING (customer_id)
JOIN op_sellers USING (seller_id) JOIN op_order_payments USING (order_id) GROUP BY 1""",
    "customer_analysis": f"""SELECT customer_state, customer_city, count(DISTINCT customer_id),
cast(sum(price) AS double) {_ITEMS} JOIN op_customers USING (customer_id)
JOIN op_order_payments USING (order_id) JOIN op_products USING (product_id) GROUP BY 1, 2""",
    "monthly_trend": f"""SELECT year(order_purchase_timestamp), month(order_purchase_timestamp),
cast(sum(price) AS double), count(DISTINCT order_id) {_ITEMS}
JOIN op_order_payments USING (order_id) GROUP BY 1, 2""",
    "review_by_product": f"""SELECT product_category_name,
cast(round(cast(avg(review_score) AS decimal(20,10)), 2) AS double), count(review_id) {_ITEMS}
JOIN op_order_reviews USING (order_id) JOIN op_products USING (product_id) GROUP BY 1""",
    "delivery_by_city": f"""SELECT customer_city, customer_state,
cast({_DAYS.format(1)} AS double), count(*) {_ITEMS} JOIN op_customers USING (customer_id)
JOIN op_sellers USING (seller_id) JOIN op_products USING (product_id)
JOIN op_order_payments USING (order_id) GROUP BY 1, 2""",
    "payment_methods": """SELECT payment_type, count(*) FROM op_order_payments
WHERE payment_type IS NOT NULL GROUP BY 1""",
    "top_products": f"SELECT product_id, count(*) {_ITEMS} GROUP BY 1",
    "top_customer_states": """SELECT customer_state, count(*) FROM op_customers
WHERE customer_state <> '' GROUP BY 1""",
    "rating_by_year": """SELECT year(order_purchase_timestamp),
cast(round(cast(avg(review_score) AS decimal(20,10)), 2) AS double)
FROM op_order_reviews JOIN op_orders USING (order_id) GROUP BY 1""",
    "top_sellers_revenue": f"""SELECT seller_id, count(*), cast(sum(price) AS double) {_ITEMS}
GROUP BY 1""",
    "top_categories": f"""SELECT product_category_name, count(*) {_ITEMS}
JOIN op_products USING (product_id) GROUP BY 1""",
    "sales_trend": f"""SELECT year(order_purchase_timestamp), month(order_purchase_timestamp),
cast(sum(price) AS double), count(*) {_ITEMS} GROUP BY 1, 2""",
    "delivery_by_state": f"""SELECT customer_state, cast({_DAYS.format(2)} AS double)
FROM op_orders JOIN op_customers USING (customer_id) GROUP BY 1""",
}


@pytest.mark.parametrize("key", sorted(PLAIN))
def test_question_against_plain_joins(spark, op, key):
    ours = values(pairs.NORMALISED_QUESTIONS[key](op))
    assert len(ours) > 0
    assert sorted(ours, key=repr) == sorted(values(spark.sql(PLAIN[key])), key=repr)


def test_fanout_counts_matches_without_making_them(spark, op):
    plain = f"""SELECT year(order_purchase_timestamp), count(*), cast(sum(price) AS double)
{_ITEMS} JOIN op_order_payments USING (order_id) GROUP BY 1"""
    assert values(pairs.payment_fanout(op)) == values(spark.sql(plain))


def test_both_sides_ask_the_same_questions():
    assert list(pairs.STAR_QUESTIONS) == list(pairs.NORMALISED_QUESTIONS)
    assert set(PLAIN) == set(pairs.STAR_QUESTIONS)


def test_pair_rowcounts(spark, op):
    keys = ("top_customer_states", "monthly_trend")
    rows = sorted(values(pairs.pair_rowcounts(small_star(spark), op, keys)))
    assert rows == [("monthly_trend", 4, 2), ("top_customer_states", 2, 2)]
