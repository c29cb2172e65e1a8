"""Operational tables derived from the given Parquet tables, as lazy frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starmart.model import MONEY

_GIVEN = {
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
    "l_quantity double, l_extendedprice double",
    "part": "p_partkey long, p_brand string, p_size int, p_retailprice double",
    "customer": "c_custkey long, c_name string, c_nationkey int",
    "supplier": "s_suppkey long, s_name string, s_nationkey int",
}

# State code per nation key, with padded, empty, missing and
# unknown codes among them.
_STATES = {
    0: "SP", 1: "RJ", 2: "MG", 3: "RS", 4: "PR", 5: "SC", 6: "BA", 7: "DF", 8: "GO",
    9: "PE", 10: "CE", 11: "PA", 12: "MA", 13: "ES", 14: "MT", 15: "MS", 16: "AM",
    17: "RN", 18: "PB", 19: "AL", 20: "SE", 21: "TO ", 22: "", 24: "XX",
}


def given_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(_GIVEN[name]).parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _state(nation: Column) -> Column:
    codes = F.create_map(*[F.lit(x) for pair in _STATES.items() for x in pair])
    return F.try_element_at(codes, nation)


def _city(key: Column) -> Column:
    return F.concat(F.lit("KOTA_"), (key % 97).cast("string"))


def _orders(orders: DataFrame) -> DataFrame:
    placed = F.col("o_orderdate").cast("date")
    days = (1 + (F.col("o_orderkey") * 13 + F.col("o_custkey")) % 60).cast("int")
    return orders.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").cast("timestamp").alias("order_purchase_timestamp"),
        F.when(F.col("o_orderstatus") != "P", F.date_add(placed, days).cast("timestamp")).alias(
            "order_delivered_customer_date"
        ),
    )


def _order_items(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_extendedprice").cast(MONEY).alias("price"),
        F.col("l_quantity").cast("int").alias("quantity"),
    )


def _categorised(part: DataFrame) -> DataFrame:
    brand = F.lower("p_brand")
    code = (
        F.when(F.col("p_size") == 50, F.lit(None))
        .when(F.col("p_size") == 49, F.concat(brand, F.lit("/untranslated")))
        .otherwise(brand)
    )
    return part.withColumn("category_code", code)


def _products(part: DataFrame) -> DataFrame:
    return _categorised(part).select(
        F.col("p_partkey").alias("product_id"),
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("product_code"),
        "category_code",
        F.when(F.col("p_size") != 50, F.lower("p_brand")).alias("product_category_name"),
        F.col("p_size").alias("product_length"),
        F.col("p_retailprice").cast("int").alias("product_weight"),
    )


def _category_translation(part: DataFrame) -> DataFrame:
    english = F.when(F.col("p_size") == 49, F.lit("")).otherwise(F.col("p_brand"))
    return (
        _categorised(part).filter("category_code IS NOT NULL")
        .select("category_code", english.alias("product_category_english"))
        .distinct()
    )


def _customers(customer: DataFrame) -> DataFrame:
    return customer.select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("customer_code"),
        _city(F.col("c_custkey")).alias("customer_city"),
        _state(F.col("c_nationkey")).alias("customer_state"),
    )


def _sellers(supplier: DataFrame) -> DataFrame:
    return supplier.select(
        F.col("s_suppkey").alias("seller_id"),
        F.col("s_name").alias("seller_code"),
        _city(F.col("s_suppkey")).alias("seller_city"),
        _state(F.col("s_nationkey")).alias("seller_state"),
    )


def _order_payments(orders: DataFrame) -> DataFrame:
    """One payment per order, and a voucher as second payment of every tenth order.

    Both come from one scan that reads only the columns a query asks for.
    """
    count = F.when(F.col("o_orderkey") % 10 == 0, 2).otherwise(1)
    code = F.col("o_orderpriority")
    kind = F.when(code != "4-NOT SPECIFIED", F.lower(F.substr(code, F.lit(3))))
    is_first = F.col("payment_sequential") == 1
    return orders.withColumn(
        "payment_sequential", F.explode(F.sequence(F.lit(1), count))
    ).select(
        F.col("o_orderkey").alias("order_id"),
        "payment_sequential",
        F.when(is_first, code).otherwise("voucher").alias("payment_code"),
        F.when(is_first, kind).otherwise("voucher").alias("payment_type"),
        F.when(is_first, F.col("o_totalprice").cast(MONEY))
        .otherwise(F.lit(1).cast(MONEY))
        .alias("payment_value"),
    )


def _order_reviews(orders: DataFrame) -> DataFrame:
    score = (1 + (F.col("o_orderkey") * 7 + F.col("o_custkey")) % 5).cast("int")
    return orders.select(
        F.col("o_orderkey").alias("review_id"),
        F.col("o_orderkey").alias("order_id"),
        score.alias("review_score"),
    )


def raw_orders(spark: SparkSession, folder: str) -> DataFrame:
    """The orders as a feed of text brings them: some keys missing or no numbers, some dates
    unreadable, every fiftieth order twice, every hundredth of them with another delivery."""
    orders = _orders(given_table(spark, folder, "orders"))
    key, copy = F.col("order_id"), F.col("copy")
    copies = F.when(key % 50 == 0, 2).otherwise(1)
    delivered = F.col("order_delivered_customer_date").cast("string")
    return orders.withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).select(
        F.when(key % 101 == 0, None).when(key % 103 == 0, F.concat(F.lit("ORD-"), key.cast("string")))
        .otherwise(key.cast("string")).alias("order_id"),
        F.col("customer_id").cast("string").alias("customer_id"),
        F.when(key % 97 == 0, "00/00/0000").otherwise(F.col("order_purchase_timestamp").cast("string"))
        .alias("order_purchase_timestamp"),
        F.when((key % 100 == 0) & (copy == 2), "2001-01-01 00:00:00").otherwise(delivered)
        .alias("order_delivered_customer_date"),
    )


def operational_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    given = {name: given_table(spark, folder, name) for name in _GIVEN}
    return {
        "orders": _orders(given["orders"]),
        "order_items": _order_items(given["lineitem"]),
        "products": _products(given["part"]),
        "category_translation": _category_translation(given["part"]),
        "customers": _customers(given["customer"]),
        "sellers": _sellers(given["supplier"]),
        "order_payments": _order_payments(given["orders"]),
        "order_reviews": _order_reviews(given["orders"]),
    }
