"""The star's joins, filters and label functions, each summarised over whole tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starmart.filters import NO_FILTER, FilterSpec
from starmart.functions.scalars import (
    elapsed_days,
    money,
    non_empty,
    or_zero,
    period_description,
    safe_ratio,
    short_month_label,
    year_month_label,
)
from starmart.model import Star
from starmart.operators.aggregates import aggregate, row_count, total
from starmart.plans.dashboard import DELIVERY, PAYMENT, REVIEW, SALES, SELLER_SALES, spend_per_customer


def _joined(
    star: Star, fact: str, dimensions: tuple[str, ...], measure: str, by: dict[str, tuple[str, str]]
) -> DataFrame:
    """Every join is made, also those whose columns are not used."""
    return aggregate(
        replace(star, enforced=False),
        fact,
        dimensions,
        {"rows": row_count(), "total": total(measure)},
        {name: (table, F.col(column)) for name, (table, column) in by.items()},
    )


def join_fact_one_dim(star: Star) -> DataFrame:
    joined = _joined(
        star, "fakta_penjualan", ("dim_produk",), "total_harga",
        {"kategori": ("dim_produk", "kategori")},
    )
    return joined.withColumn("total", money(F.col("total")))


def join_sales_star(star: Star) -> DataFrame:
    joined = _joined(
        star, "fakta_penjualan", SALES, "total_harga",
        {
            "tahun": ("dim_waktu", "tahun"),
            "kategori_inggris": ("dim_produk", "kategori_inggris"),
            "state": ("dim_pelanggan", "state"),
        },
    )
    return joined.withColumn("total", money(F.col("total")))


def join_seller_star(star: Star) -> DataFrame:
    return _joined(
        star, "fakta_penjualan", SELLER_SALES, "jumlah",
        {"seller_state": ("dim_seller", "state"), "tahun": ("dim_waktu", "tahun")},
    )


def join_delivery_star(star: Star) -> DataFrame:
    return _joined(
        star, "fakta_pengiriman", DELIVERY, "durasi_pengiriman",
        {"kategori_inggris": ("dim_produk", "kategori_inggris"), "state": ("dim_pelanggan", "state")},
    )


def join_payment_star(star: Star) -> DataFrame:
    joined = _joined(
        star, "fakta_pembayaran", PAYMENT, "total_bayar",
        {
            "metode_pembayaran": ("dim_metode_pembayaran", "metode_pembayaran"),
            "tahun": ("dim_waktu", "tahun"),
        },
    )
    return joined.withColumn("total", money(F.col("total")))


def join_review_star(star: Star) -> DataFrame:
    return _joined(
        star, "fakta_review", REVIEW, "skor_review",
        {"tahun": ("dim_waktu", "tahun"), "kategori_inggris": ("dim_produk", "kategori_inggris")},
    )


def join_left_customer_label(star: Star) -> DataFrame:
    """Sales per customer label, also for keys without a customer row."""
    named = spend_per_customer(replace(star, enforced=False), "left")
    label = F.coalesce("pelanggan_id", F.col("pelanggan_key").cast("string")).alias("label")
    return named.groupBy(label).agg(money(F.sum("revenue")).alias("total_revenue"))


def star_filter_all(star: Star, f: FilterSpec = NO_FILTER) -> DataFrame:
    """Rows, units and revenue that a filter set leaves."""
    left = aggregate(
        star, "fakta_penjualan", SALES,
        {"rows": row_count(), "units": total("jumlah"), "revenue": total("total_harga")},
        where=f.by_dimension(), year=f.year, month=f.month,
    )
    return left.select(
        "rows",
        or_zero(F.col("units")).alias("total_qty"),
        money(or_zero(F.col("revenue"))).alias("total_revenue"),
    )


def filter_non_empty(star: Star) -> DataFrame:
    """Products per category that is neither missing nor empty."""
    named = star["dim_produk"].filter(non_empty(F.col("kategori_inggris")))
    return named.groupBy("kategori_inggris").agg(F.count(F.lit(1)).alias("products"))


def _days_per(star: Star, label) -> DataFrame:
    return (
        star["dim_waktu"].select(label.alias("label"))
        .groupBy("label").agg(F.count(F.lit(1)).alias("days"))
    )


def fn_year_month_label(star: Star) -> DataFrame:
    return _days_per(star, year_month_label(F.col("tahun"), F.col("bulan")))


def fn_short_month_label(star: Star) -> DataFrame:
    return _days_per(star, short_month_label(F.col("tahun"), F.col("bulan")))


def fn_period_description(star: Star) -> DataFrame:
    """Days under the caption of their month, year, calendar month, and of no period."""
    year, month, none = F.col("tahun"), F.col("bulan"), F.lit(None).cast("int")
    periods = [(year, month), (year, none), (none, month), (none, none)]
    return _days_per(star, F.explode(F.array(*[period_description(y, m) for y, m in periods])))


def fn_elapsed_days(orders: DataFrame) -> DataFrame:
    days = elapsed_days(
        F.col("order_purchase_timestamp"), F.col("order_delivered_customer_date")
    )
    return orders.groupBy(days.alias("days")).agg(F.count(F.lit(1)).alias("orders"))


def fn_safe_ratio(star: Star) -> DataFrame:
    """Revenue per unit of each category."""
    sums = aggregate(
        star, "fakta_penjualan", ("dim_produk",),
        {"revenue": total("total_harga"), "units": total("jumlah")},
        {"kategori": ("dim_produk", F.col("kategori"))},
    )
    return sums.select("kategori", safe_ratio(F.col("revenue"), F.col("units")).alias("ratio"))
