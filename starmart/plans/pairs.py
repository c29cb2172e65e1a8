"""Thirteen questions, each asked of the star and of the operational tables.

The operational side is a set of inner joins on ``order_id``, where every item
meets every payment (or review) of its order. What is asked of those matches
are only sums and counts, so one side is first summed per order and the other
weighted by it: the same answer, without a row per match.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starmart.functions.scalars import exact_mean, money, non_empty, or_zero
from starmart.model import Star
from starmart.operators.aggregates import (
    aggregate,
    distinct_count,
    row_count,
    total,
    value_count,
)
from starmart.operators.joins import reshuffled
from starmart.operators.ordering import ascending, descending, ranked, top

Operational = Mapping[str, DataFrame]


def _on(dimension: str, **columns: str) -> dict:
    return {name: (dimension, F.col(column)) for name, column in columns.items()}


def _money(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: money(F.col(name)) for name in names})


# Star side --------------------------------------------------------------------


def _sales(star: Star, dimension: str, measures: dict, **by: str) -> DataFrame:
    return aggregate(star, "fakta_penjualan", (dimension,), measures, _on(dimension, **by))


def star_sales_by_category(star: Star) -> DataFrame:
    sums = _sales(
        star, "dim_produk", {"total": total("total_harga"), "cnt": row_count()},
        kategori="kategori", kategori_inggris="kategori_inggris",
    )
    return ranked(_money(sums, "total"), "total", "kategori", "kategori_inggris")


def star_customer_analysis(star: Star) -> DataFrame:
    sums = _sales(
        star, "dim_pelanggan",
        {
            "jumlah_pelanggan": distinct_count("pelanggan_key"),
            "total_belanja": total("total_harga"),
        },
        state="state", kota="kota",
    )
    return ranked(_money(sums, "total_belanja"), "total_belanja", "state", "kota")


def star_monthly_trend(star: Star) -> DataFrame:
    sums = _sales(
        star, "dim_waktu", {"total": total("total_harga"), "jumlah_transaksi": row_count()},
        tahun="tahun", bulan="bulan",
    )
    return _money(sums, "total").orderBy(ascending("tahun"), ascending("bulan"))


def star_review_by_product(star: Star) -> DataFrame:
    sums = aggregate(
        star, "fakta_review", ("dim_produk",),
        {
            "score": total("skor_review"),
            "n": value_count("skor_review"),
            "jumlah_review": row_count(),
        },
        _on("dim_produk", kategori="kategori"),
    )
    means = sums.select(
        "kategori", exact_mean(F.col("score"), F.col("n"), 2).alias("rata_rata_skor"),
        "jumlah_review",
    )
    return ranked(means, "rata_rata_skor", "kategori")


def _deliveries(star: Star, **by: str) -> DataFrame:
    return aggregate(
        star, "fakta_pengiriman", ("dim_pelanggan",),
        {
            "days": total("durasi_pengiriman"),
            "n": value_count("durasi_pengiriman"),
            "jumlah_pengiriman": row_count(),
        },
        _on("dim_pelanggan", **by),
    )


def star_delivery_by_city(star: Star) -> DataFrame:
    means = _deliveries(star, kota="kota", state="state").select(
        "kota", "state", exact_mean(F.col("days"), F.col("n"), 1).alias("rata_rata_hari"),
        "jumlah_pengiriman",
    )
    return ranked(means, "rata_rata_hari", "kota", "state")


def star_payment_methods(star: Star) -> DataFrame:
    counts = aggregate(
        star, "fakta_pembayaran", ("dim_metode_pembayaran",), {"jumlah": row_count()},
        _on("dim_metode_pembayaran", metode_pembayaran="metode_pembayaran"),
    )
    return ranked(counts, "jumlah", "metode_pembayaran")


def star_top_products(star: Star) -> DataFrame:
    sums = _sales(star, "dim_produk", {"total_qty": total("jumlah")}, label="produk_id")
    return top(sums, 10, "total_qty", "label")


def star_top_customer_states(star: Star) -> DataFrame:
    named = star["dim_pelanggan"].filter(non_empty(F.col("state")))
    counts = named.groupBy("state").agg(F.count(F.lit(1)).alias("total_customers"))
    return top(counts, 5, "total_customers", "state")


def star_rating_by_year(star: Star) -> DataFrame:
    sums = aggregate(
        star, "fakta_review", ("dim_waktu",),
        {"score": total("skor_review"), "n": value_count("skor_review")},
        _on("dim_waktu", label="tahun"),
    )
    means = sums.select("label", exact_mean(F.col("score"), F.col("n"), 2).alias("avg_rating"))
    return means.orderBy(ascending("label"))


def star_top_sellers_revenue(star: Star) -> DataFrame:
    sums = _sales(
        star, "dim_seller",
        {"total_qty": total("jumlah"), "total_revenue": total("total_harga")},
        label="seller_id",
    )
    return top(_money(sums, "total_revenue"), 10, "total_revenue", "label")


def star_top_categories(star: Star) -> DataFrame:
    sums = _sales(star, "dim_produk", {"total_qty": total("jumlah")}, label="kategori_inggris")
    return top(sums, 10, "total_qty", "label")


def star_sales_trend(star: Star) -> DataFrame:
    sums = _sales(
        star, "dim_waktu", {"revenue": total("total_harga"), "qty": total("jumlah")},
        tahun="tahun", bulan="bulan",
    )
    return _money(sums, "revenue").orderBy(ascending("tahun"), ascending("bulan"))


def star_delivery_by_state(star: Star) -> DataFrame:
    means = _deliveries(star, state="state").select(
        "state", exact_mean(F.col("days"), F.col("n"), 2).alias("avg_delivery_days")
    )
    return ranked(means, "avg_delivery_days", "state")


# Operational side -------------------------------------------------------------


def _per_order(df: DataFrame, **aggs: Column) -> DataFrame:
    return df.groupBy("order_id").agg(*[agg.alias(name) for name, agg in aggs.items()])


def _payments_per_order(op: Operational) -> DataFrame:
    return _per_order(op["order_payments"], payments=F.count(F.lit(1)))


def _weighted(price: str) -> Column:
    """A price counted once per payment of its order."""
    return F.sum(F.col(price) * F.col("payments").cast("decimal(10,0)"))


def _year_month() -> list[Column]:
    placed = F.col("order_purchase_timestamp")
    return [F.year(placed).alias("tahun"), F.month(placed).alias("bulan")]


def payment_fanout(op: Operational) -> DataFrame:
    """Items joined with the payments of their order: matches and their price, per year."""
    items = _per_order(
        op["order_items"], price=F.sum("price"), items=F.count(F.lit(1))
    )
    joined = (
        op["orders"].select("order_id", F.year("order_purchase_timestamp").alias("tahun"))
        .join(items, "order_id")
        .join(_payments_per_order(op), "order_id")
    )
    sums = joined.groupBy("tahun").agg(
        F.sum(F.col("items") * F.col("payments")).alias("rows"),
        _weighted("price").alias("total"),
    )
    return _money(sums, "total").orderBy("tahun")


def norm_sales_by_category(op: Operational) -> DataFrame:
    orders = (
        op["orders"].select("order_id", "customer_id")
        .join(op["customers"].select("customer_id"), "customer_id")
        .join(_payments_per_order(op), "order_id")
    )
    per_product = (
        op["order_items"].select("order_id", "product_id", "seller_id", "price")
        .join(op["sellers"].select("seller_id"), "seller_id")
        .join(reshuffled(orders.select("order_id", "payments"), "order_id"), "order_id")
        .groupBy("product_id").agg(_weighted("price").alias("price"))
    )
    sums = (
        per_product.join(op["products"].select("product_id", "product_category_name"), "product_id")
        .groupBy("product_category_name").agg(F.sum("price").alias("total"))
    )
    return ranked(_money(sums, "total"), "total", "product_category_name")


def norm_customer_analysis(op: Operational) -> DataFrame:
    items = _per_order(
        op["order_items"].join(op["products"].select("product_id"), "product_id"),
        price=F.sum("price"),
    )
    per_customer = (
        op["orders"].select("order_id", "customer_id")
        .join(items, "order_id")
        .join(_payments_per_order(op), "order_id")
        .groupBy("customer_id").agg(_weighted("price").alias("price"))
    )
    sums = (
        op["customers"].select("customer_id", "customer_state", "customer_city")
        .join(per_customer, "customer_id")
        .groupBy("customer_state", "customer_city")
        .agg(
            F.count_distinct("customer_id").alias("jumlah_pelanggan"),
            F.sum("price").alias("total_belanja"),
        )
    )
    return ranked(
        _money(sums, "total_belanja"), "total_belanja", "customer_state", "customer_city"
    )


def norm_monthly_trend(op: Operational) -> DataFrame:
    items = _per_order(op["order_items"], price=F.sum("price"))
    sums = (
        op["orders"].select("order_id", *_year_month())
        .join(items, "order_id")
        .join(_payments_per_order(op), "order_id")
        .groupBy("tahun", "bulan")
        .agg(
            _weighted("price").alias("total"),
            F.count_distinct("order_id").alias("jumlah_transaksi"),
        )
    )
    return _money(sums, "total").orderBy(ascending("tahun"), ascending("bulan"))


def norm_review_by_product(op: Operational) -> DataFrame:
    score = F.col("review_score")
    reviews = _per_order(
        op["order_reviews"],
        score=or_zero(F.sum(score)),
        scores=F.count(score),
        reviews=F.count("review_id"),
    )
    reviewed = op["orders"].select("order_id").join(reviews, "order_id")
    per_product = (
        op["order_items"].select("order_id", "product_id")
        .join(reshuffled(reviewed, "order_id"), "order_id")
        .groupBy("product_id")
        .agg(*[F.sum(c).alias(c) for c in ("score", "scores", "reviews")])
    )
    sums = (
        per_product.join(op["products"].select("product_id", "product_category_name"), "product_id")
        .groupBy("product_category_name")
        .agg(*[F.sum(c).alias(c) for c in ("score", "scores", "reviews")])
    )
    means = sums.select(
        "product_category_name",
        exact_mean(F.col("score"), F.col("scores"), 2).alias("rata_rata_skor"),
        F.col("reviews").alias("jumlah_review"),
    )
    return ranked(means, "rata_rata_skor", "product_category_name")


def _delivery_seconds() -> Column:
    return F.unix_timestamp("order_delivered_customer_date") - F.unix_timestamp(
        "order_purchase_timestamp"
    )


def _mean_days(digits: int) -> Column:
    return exact_mean(F.col("seconds"), F.col("n") * 86400, digits)


def norm_delivery_by_city(op: Operational) -> DataFrame:
    items = _per_order(
        op["order_items"]
        .join(op["sellers"].select("seller_id"), "seller_id")
        .join(op["products"].select("product_id"), "product_id"),
        items=F.count(F.lit(1)),
    )
    weight = F.col("items") * F.col("payments")
    per_customer = (
        op["orders"].select("order_id", "customer_id", _delivery_seconds().alias("seconds"))
        .join(items, "order_id")
        .join(_payments_per_order(op), "order_id")
        .groupBy("customer_id")
        .agg(
            or_zero(F.sum(F.col("seconds").cast("decimal(38,0)") * weight)).alias("seconds"),
            or_zero(F.sum(F.when(F.col("seconds").isNotNull(), weight))).alias("n"),
            F.sum(weight).alias("jumlah_pengiriman"),
        )
    )
    sums = (
        per_customer.join(
            op["customers"].select("customer_id", "customer_city", "customer_state"), "customer_id"
        )
        .groupBy("customer_city", "customer_state")
        .agg(*[F.sum(c).alias(c) for c in ("seconds", "n", "jumlah_pengiriman")])
    )
    means = sums.select(
        "customer_city", "customer_state", _mean_days(1).alias("rata_rata_hari"),
        "jumlah_pengiriman",
    )
    return ranked(means, "rata_rata_hari", "customer_city", "customer_state")


def norm_payment_methods(op: Operational) -> DataFrame:
    counts = (
        op["order_payments"].filter("payment_type IS NOT NULL")
        .groupBy(F.col("payment_type").alias("metode_pembayaran"))
        .agg(F.count(F.lit(1)).alias("jumlah"))
    )
    return ranked(counts, "jumlah", "metode_pembayaran")


def norm_top_products(op: Operational) -> DataFrame:
    counts = (
        op["order_items"].join(op["orders"].select("order_id"), "order_id")
        .groupBy(F.col("product_id").alias("label"))
        .agg(F.count(F.lit(1)).alias("total_qty"))
    )
    return top(counts, 10, "total_qty", "label")


def norm_top_customer_states(op: Operational) -> DataFrame:
    state = F.col("customer_state")
    counts = (
        op["customers"].filter(non_empty(state)).groupBy(state.alias("state"))
        .agg(F.count(F.lit(1)).alias("total_customers"))
    )
    return top(counts, 5, "total_customers", "state")


def norm_rating_by_year(op: Operational) -> DataFrame:
    score = F.col("review_score")
    reviews = _per_order(op["order_reviews"], score=or_zero(F.sum(score)), n=F.count(score))
    sums = (
        op["orders"].select("order_id", F.year("order_purchase_timestamp").alias("label"))
        .join(reviews, "order_id")
        .groupBy("label").agg(F.sum("score").alias("score"), F.sum("n").alias("n"))
    )
    means = sums.select("label", exact_mean(F.col("score"), F.col("n"), 2).alias("avg_rating"))
    return means.orderBy(ascending("label"))


def norm_top_sellers_revenue(op: Operational) -> DataFrame:
    sums = (
        op["order_items"].join(op["orders"].select("order_id"), "order_id")
        .groupBy(F.col("seller_id").alias("label"))
        .agg(F.count(F.lit(1)).alias("total_qty"), F.sum("price").alias("total_revenue"))
    )
    return top(_money(sums, "total_revenue"), 10, "total_revenue", "label")


def norm_top_categories(op: Operational) -> DataFrame:
    per_product = (
        op["order_items"].join(op["orders"].select("order_id"), "order_id")
        .groupBy("product_id").agg(F.count(F.lit(1)).alias("n"))
    )
    counts = (
        per_product.join(op["products"].select("product_id", "product_category_name"), "product_id")
        .groupBy(F.col("product_category_name").alias("label"))
        .agg(F.sum("n").alias("total_qty"))
    )
    return top(counts, 10, "total_qty", "label")


def norm_sales_trend(op: Operational) -> DataFrame:
    items = _per_order(op["order_items"], price=F.sum("price"), items=F.count(F.lit(1)))
    sums = (
        op["orders"].select("order_id", *_year_month())
        .join(items, "order_id")
        .groupBy("tahun", "bulan")
        .agg(F.sum("price").alias("revenue"), F.sum("items").alias("qty"))
    )
    return _money(sums, "revenue").orderBy(ascending("tahun"), ascending("bulan"))


def norm_delivery_by_state(op: Operational) -> DataFrame:
    seconds = _delivery_seconds()
    per_customer = op["orders"].groupBy("customer_id").agg(
        or_zero(F.sum(seconds)).alias("seconds"), F.count(seconds).alias("n")
    )
    sums = (
        per_customer.join(op["customers"].select("customer_id", "customer_state"), "customer_id")
        .groupBy(F.col("customer_state").alias("state"))
        .agg(F.sum("seconds").alias("seconds"), F.sum("n").alias("n"))
    )
    means = sums.select("state", _mean_days(2).alias("avg_delivery_days"))
    return means.orderBy(descending("avg_delivery_days"), ascending("state"))


STAR_QUESTIONS: dict[str, Callable[[Star], DataFrame]] = {
    "sales_by_category": star_sales_by_category,
    "customer_analysis": star_customer_analysis,
    "monthly_trend": star_monthly_trend,
    "review_by_product": star_review_by_product,
    "delivery_by_city": star_delivery_by_city,
    "payment_methods": star_payment_methods,
    "top_products": star_top_products,
    "top_customer_states": star_top_customer_states,
    "rating_by_year": star_rating_by_year,
    "top_sellers_revenue": star_top_sellers_revenue,
    "top_categories": star_top_categories,
    "sales_trend": star_sales_trend,
    "delivery_by_state": star_delivery_by_state,
}

NORMALISED_QUESTIONS: dict[str, Callable[[Operational], DataFrame]] = {
    "sales_by_category": norm_sales_by_category,
    "customer_analysis": norm_customer_analysis,
    "monthly_trend": norm_monthly_trend,
    "review_by_product": norm_review_by_product,
    "delivery_by_city": norm_delivery_by_city,
    "payment_methods": norm_payment_methods,
    "top_products": norm_top_products,
    "top_customer_states": norm_top_customer_states,
    "rating_by_year": norm_rating_by_year,
    "top_sellers_revenue": norm_top_sellers_revenue,
    "top_categories": norm_top_categories,
    "sales_trend": norm_sales_trend,
    "delivery_by_state": norm_delivery_by_state,
}


def pair_rowcounts(star: Star, op: Operational, pairs: tuple[str, ...] | None = None) -> DataFrame:
    """Rows on either side of each question."""
    def count(df: DataFrame, key: str, side: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(key).alias("key"), F.lit(side).alias("side"), "n"
        )

    counts = []
    for key in pairs or STAR_QUESTIONS:
        counts.append(count(STAR_QUESTIONS[key](star), key, "star"))
        counts.append(count(NORMALISED_QUESTIONS[key](op), key, "norm"))
    sides = reduce(DataFrame.unionByName, counts)
    return sides.groupBy("key").agg(
        F.sum(F.when(F.col("side") == "star", F.col("n"))).alias("star_rows"),
        F.sum(F.when(F.col("side") == "norm", F.col("n"))).alias("norm_rows"),
    )
