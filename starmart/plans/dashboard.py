"""Filter lists, indicators and charts of the dashboard.

Every operator takes the star and a filter set and returns a lazy frame. Some
leave out part of the filter set on purpose; they say so.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from starmart.filters import NO_FILTER, FilterSpec, option
from starmart.functions.scalars import (
    exact_mean,
    money,
    month_text,
    non_empty,
    or_zero,
    safe_ratio,
    year_month_label,
)
from starmart.model import Star
from starmart.operators.aggregates import (
    aggregate,
    distinct_count,
    row_count,
    total,
    value_count,
)
from starmart.operators.joins import attach
from starmart.operators.ordering import ascending, ranked, top

# The dimensions each fact is joined with under the filter set.
SALES = ("dim_waktu", "dim_produk", "dim_pelanggan")
SELLER_SALES = ("dim_seller", "dim_waktu", "dim_produk", "dim_pelanggan")
DELIVERY = ("dim_produk", "dim_pelanggan", "dim_waktu")
PAYMENT = ("dim_metode_pembayaran", "dim_waktu", "dim_pelanggan")
REVIEW = ("dim_waktu", "dim_produk", "dim_pelanggan")


def _sales(star: Star, f: FilterSpec, measures: dict, by=None, where=None) -> DataFrame:
    predicates = {**f.by_dimension()}
    for dimension, predicate in (where or {}).items():
        predicates[dimension] = (
            predicates[dimension] & predicate if dimension in predicates else predicate
        )
    return aggregate(star, "fakta_penjualan", SALES, measures, by, predicates, f.year, f.month)


# Filter lists -----------------------------------------------------------------


def filter_years(star: Star) -> DataFrame:
    return star["dim_waktu"].select("tahun").distinct().orderBy(F.desc("tahun"))


def filter_months(star: Star, year: int | None = None) -> DataFrame:
    days = star["dim_waktu"]
    if year is not None:
        days = days.filter(F.col("tahun") == F.lit(year))
    return days.select("bulan").distinct().orderBy(ascending("bulan"))


def filter_categories(star: Star) -> DataFrame:
    named = star["dim_produk"].filter(non_empty(F.col("kategori_inggris")))
    return named.select("kategori_inggris").distinct().orderBy("kategori_inggris")


def filter_states(star: Star) -> DataFrame:
    named = star["dim_pelanggan"].filter(non_empty(F.col("state")))
    return named.select("state").distinct().orderBy("state")


# Indicators -------------------------------------------------------------------


def kpi_customers_all(star: Star, f: FilterSpec = NO_FILTER) -> DataFrame:
    """All customers, under the state filter only."""
    customers = star["dim_pelanggan"]
    if f.state is not None:
        customers = customers.filter(F.col("state") == F.lit(f.state))
    return customers.agg(F.count(F.lit(1)).alias("total_customers"))


def kpi_customers_active(star: Star, f: FilterSpec = NO_FILTER) -> DataFrame:
    """Customers with a sale."""
    return _sales(star, f, {"total_customers": distinct_count("pelanggan_key")})


def kpi_customers(star: Star, f: FilterSpec = NO_FILTER) -> DataFrame:
    """Active customers under a time filter, otherwise all of them."""
    return kpi_customers_active(star, f) if f.has_time else kpi_customers_all(star, f)


def kpi_products(star: Star, f: FilterSpec = NO_FILTER) -> DataFrame:
    return _sales(star, f, {"total_products": distinct_count("produk_key")})


def kpi_categories(star: Star, f: FilterSpec = NO_FILTER) -> DataFrame:
    category = {"kategori_inggris": ("dim_produk", F.col("kategori_inggris"))}
    sold = _sales(star, f, {"n": row_count()}, category)
    return sold.agg(F.count("kategori_inggris").alias("total_categories"))


def kpi_units(star: Star, f: FilterSpec = NO_FILTER) -> DataFrame:
    sold = _sales(star, f, {"units": total("jumlah")})
    return sold.select(or_zero(F.col("units")).alias("total_orders"))


def kpi_revenue(star: Star, f: FilterSpec = NO_FILTER) -> DataFrame:
    sold = _sales(star, f, {"revenue": total("total_harga")})
    return sold.select(money(or_zero(F.col("revenue"))).alias("total_revenue"))


def kpi_avg_delivery(star: Star, f: FilterSpec = NO_FILTER) -> DataFrame:
    sums = _delivery_sums(star, f)
    return sums.select(exact_mean(F.col("days"), F.col("n"), 2).alias("avg_delivery_days"))


def kpi_sales_summary(star: Star, f: FilterSpec = NO_FILTER) -> DataFrame:
    """Customers, products, units and revenue under one filter set, in one pass."""
    summary = _sales(
        star,
        f,
        {
            "total_customers": distinct_count("pelanggan_key"),
            "total_products": distinct_count("produk_key"),
            "total_orders": total("jumlah"),
            "total_revenue": total("total_harga"),
        },
    )
    return summary.select(
        "total_customers",
        "total_products",
        or_zero(F.col("total_orders")).alias("total_orders"),
        money(or_zero(F.col("total_revenue"))).alias("total_revenue"),
    )


# Payment methods --------------------------------------------------------------


def _method_counts(star: Star, f: FilterSpec) -> DataFrame:
    return aggregate(
        star,
        "fakta_pembayaran",
        PAYMENT,
        {"jumlah": row_count()},
        {"metode_pembayaran": ("dim_metode_pembayaran", F.col("metode_pembayaran"))},
        f.without("category").by_dimension(),
        f.year,
        f.month,
    )


def payment_method_counts(star: Star, f: FilterSpec = NO_FILTER) -> DataFrame:
    """Payments per method; the category filter does not apply."""
    return ranked(_method_counts(star, f), "jumlah", "metode_pembayaran")


def payment_share(star: Star, f: FilterSpec = NO_FILTER) -> DataFrame:
    """Payment methods with their share of all payments in per cent."""
    # One row per method, so the window over all of them stays small.
    everything = F.sum("jumlah").over(Window.partitionBy())
    shares = _method_counts(star, f).withColumn(
        "persen", safe_ratio(F.col("jumlah") * 100, everything)
    )
    return ranked(shares, "jumlah", "metode_pembayaran")


# Rankings ---------------------------------------------------------------------


def top10_products(star: Star, f: FilterSpec = NO_FILTER, k: int = 10) -> DataFrame:
    label = {"label": ("dim_produk", F.col("produk_id"))}
    return top(_sales(star, f, {"total_qty": total("jumlah")}, label), k, "total_qty", "label")


def top10_categories(star: Star, f: FilterSpec = NO_FILTER, k: int = 10) -> DataFrame:
    """Best-selling categories; the category filter does not apply."""
    label = {"label": ("dim_produk", F.col("kategori_inggris"))}
    sold = _sales(star, f.without("category"), {"total_qty": total("jumlah")}, label)
    return top(sold, k, "total_qty", "label")


def top10_items(star: Star, f: FilterSpec = NO_FILTER, top_by: str | None = None) -> DataFrame:
    """Best sellers by ``product`` or ``category``; anything else means product."""
    by_category = option(top_by, ("product", "category"), "product") == "category"
    return top10_categories(star, f) if by_category else top10_products(star, f)


def top5_states_all(star: Star, f: FilterSpec = NO_FILTER, k: int = 5) -> DataFrame:
    """States by all their customers; no filter applies."""
    named = star["dim_pelanggan"].filter(non_empty(F.col("state")))
    counts = named.groupBy("state").agg(F.count(F.lit(1)).alias("total_customers"))
    return top(counts, k, "total_customers", "state")


def top5_states_active(star: Star, f: FilterSpec = NO_FILTER, k: int = 5) -> DataFrame:
    """States by their customers with a sale."""
    counts = _sales(
        star,
        f,
        {"total_customers": distinct_count("pelanggan_key")},
        {"state": ("dim_pelanggan", F.col("state"))},
        {"dim_pelanggan": non_empty(F.col("state"))},
    )
    return top(counts, k, "total_customers", "state")


def top5_states(star: Star, f: FilterSpec = NO_FILTER, k: int = 5) -> DataFrame:
    return top5_states_active(star, f, k) if f.has_time else top5_states_all(star, f, k)


def _seller_totals(star: Star, f: FilterSpec) -> DataFrame:
    sold = aggregate(
        star,
        "fakta_penjualan",
        SELLER_SALES,
        {"total_qty": total("jumlah"), "total_revenue": total("total_harga")},
        {"label": ("dim_seller", F.col("seller_id"))},
        f.by_dimension(),
        f.year,
        f.month,
    )
    return sold.withColumn("total_revenue", money(F.col("total_revenue")))


def top10_sellers_units(star: Star, f: FilterSpec = NO_FILTER, k: int = 10) -> DataFrame:
    return top(_seller_totals(star, f), k, "total_qty", "label")


def top10_sellers_revenue(star: Star, f: FilterSpec = NO_FILTER, k: int = 10) -> DataFrame:
    return top(_seller_totals(star, f), k, "total_revenue", "label")


def spend_per_customer(star: Star, how: str, f: FilterSpec = NO_FILTER) -> DataFrame:
    """Revenue beside the customer's key and id; each part of the sales meets the customers by itself."""
    found = []
    for part in star.parts("fakta_penjualan", "dim_pelanggan"):
        spend = aggregate(
            part,
            "fakta_penjualan",
            ("dim_waktu", "dim_produk"),
            {"revenue": total("total_harga")},
            {"pelanggan_key": ("fakta_penjualan", F.col("pelanggan_key"))},
            f.without("state").by_dimension(),
            f.year,
            f.month,
        )
        where = f.by_dimension().get("dim_pelanggan")
        found.append(attach(spend, part, "dim_pelanggan", "pelanggan_id", where=where, how=how))
    return reduce(DataFrame.unionByName, found)


def top10_customers_revenue(star: Star, f: FilterSpec = NO_FILTER, k: int = 10) -> DataFrame:
    """Customers by revenue; one without a customer row goes by its key.

    Sales are summed per customer before the customer table is joined. A state
    filter leaves only customers that have a row.
    """
    where = f.by_dimension().get("dim_pelanggan")
    named = spend_per_customer(star, "left" if where is None else "inner", f)
    label = F.coalesce("pelanggan_id", F.col("pelanggan_key").cast("string")).alias("label")
    totals = named.groupBy(label).agg(F.sum("revenue").alias("total_revenue"))
    return top(
        totals.withColumn("total_revenue", money(F.col("total_revenue"))),
        k,
        "total_revenue",
        "label",
    )


def rank_seller_volume(star: Star, k: int = 10) -> DataFrame:
    """Sellers by units, from the fact that already holds them per day and product."""
    units = star["fakta_seller"].groupBy("seller_key").agg(
        F.sum("jumlah_terjual").alias("units")
    )
    named = attach(units, star, "dim_seller", F.col("seller_id").alias("label"))
    totals = named.groupBy("label").agg(F.sum("units").alias("jumlah_terjual"))
    return top(totals, k, "jumlah_terjual", "label")


# Sales over time --------------------------------------------------------------


def _sales_per(star: Star, f: FilterSpec, **by) -> DataFrame:
    groups = {name: ("dim_waktu", F.col(column)) for name, column in by.items()}
    sold = _sales(star, f, {"revenue": total("total_harga"), "qty": total("jumlah")}, groups)
    return sold.withColumn("revenue", money(F.col("revenue"))).orderBy(
        *[ascending(name) for name in by]
    )


def sales_by_day(star: Star, f: FilterSpec) -> DataFrame:
    if f.year is None or f.month is None:
        raise ValueError("sales per day need a year and a month")
    days = _sales_per(star, f, label="tanggal")
    return days.withColumn("display_label", F.date_format("label", "d MMM"))


def sales_by_month(star: Star, f: FilterSpec = NO_FILTER) -> DataFrame:
    return _sales_per(star, f, bulan="bulan").withColumn(
        "display_label", month_text(F.col("bulan"))
    )


def sales_by_year(star: Star, f: FilterSpec = NO_FILTER) -> DataFrame:
    return _sales_per(star, f, tahun="tahun").withColumn(
        "display_label", F.col("tahun").cast("string")
    )


def sales_by_year_month(star: Star, f: FilterSpec = NO_FILTER) -> DataFrame:
    return _sales_per(star, f, tahun="tahun", bulan="bulan").withColumn(
        "display_label", year_month_label(F.col("tahun"), F.col("bulan"))
    )


def sales_by_period(star: Star, f: FilterSpec = NO_FILTER) -> DataFrame:
    """Sales at the grain that the given time filters leave open."""
    if f.year is not None and f.month is not None:
        sales = sales_by_day(star, f)
    elif f.year is not None:
        sales = sales_by_month(star, f)
    elif f.month is not None:
        sales = sales_by_year(star, f)
    else:
        sales = sales_by_year_month(star, f)
    return sales.select("display_label", "revenue", "qty")


# Delivery and ratings ---------------------------------------------------------


def _delivery_sums(star: Star, f: FilterSpec, by=None) -> DataFrame:
    return aggregate(
        star,
        "fakta_pengiriman",
        DELIVERY,
        {
            "days": total("durasi_pengiriman"),
            "n": value_count("durasi_pengiriman"),
            "deliveries": row_count(),
        },
        by,
        f.by_dimension(),
        f.year,
        f.month,
    )


def avg_delivery_state(star: Star, f: FilterSpec = NO_FILTER) -> DataFrame:
    sums = _delivery_sums(star, f, {"state": ("dim_pelanggan", F.col("state"))})
    means = sums.select(
        "state", exact_mean(F.col("days"), F.col("n"), 2).alias("avg_delivery_days")
    )
    return ranked(means, "avg_delivery_days", "state")


def avg_delivery_category(star: Star, f: FilterSpec = NO_FILTER) -> DataFrame:
    sums = _delivery_sums(star, f, {"kategori": ("dim_produk", F.col("kategori_inggris"))})
    means = sums.select(
        "kategori",
        F.col("deliveries").alias("total_pengiriman"),
        exact_mean(F.col("days"), F.col("n"), 2).alias("rata_rata_hari_pengiriman"),
    )
    return ranked(means, "rata_rata_hari_pengiriman", "kategori")


def _ratings(star: Star, f: FilterSpec, label) -> DataFrame:
    sums = aggregate(
        star,
        "fakta_review",
        REVIEW,
        {"score": total("skor_review"), "n": value_count("skor_review")},
        {"label": ("dim_waktu", label)},
        f.by_dimension(),
        f.year,
        f.month,
    )
    means = sums.select("label", exact_mean(F.col("score"), F.col("n"), 2).alias("avg_rating"))
    return means.orderBy(ascending("label"))


def rating_by_year(star: Star, f: FilterSpec = NO_FILTER) -> DataFrame:
    return _ratings(star, f, F.col("tahun"))


def rating_by_month(star: Star, f: FilterSpec = NO_FILTER) -> DataFrame:
    return _ratings(star, f, year_month_label(F.col("tahun"), F.col("bulan")))
