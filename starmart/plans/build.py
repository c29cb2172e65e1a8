"""From operational tables to the star.

Dimension frames carry their business key beside the published columns, and the
keyed lines carry what later facts need, so each large join is done once.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starmart.model import LAYOUT, MONEY, STAR_SCHEMAS
from starmart.operators.keys import cleanse, surrogate_keys


def published(df: DataFrame, table: str) -> DataFrame:
    """``df`` with the column order and types of ``table``, without ``id``."""
    return df.select(
        *[F.col(f.name).cast(f.dataType) for f in STAR_SCHEMAS[table].fields if f.name in df.columns]
    )


#: Business key and key of each dimension, as its frame carries them.
KEY_MAPS = {
    "dim_waktu": ("tanggal", "waktu_id"),
    "dim_produk": ("product_id", "produk_key"),
    "dim_pelanggan": ("customer_id", "pelanggan_key"),
    "dim_seller": ("source_seller_id", "seller_key"),
    "dim_metode_pembayaran": ("payment_code", "metode_key"),
}


def key_map(dimension: str, rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Business keys and keys of a dimension, with those given earlier that no longer occur."""
    business_key, key = KEY_MAPS[dimension]
    now = rows.select(business_key, F.col(key).cast("long"))
    if known is None:
        return now
    return now.unionByName(known.join(now, business_key, "left_anti").select(business_key, F.col(key).cast("long")))


def dim_waktu(orders: DataFrame, known: DataFrame | None = None) -> DataFrame:
    days = orders.select(
        F.col("order_purchase_timestamp").cast("date").alias("tanggal")
    ).dropna().distinct()
    return surrogate_keys(days, "tanggal", "waktu_id", known).select(
        F.col("waktu_id").cast("int"),
        "tanggal",
        F.day("tanggal").alias("hari"),
        F.month("tanggal").alias("bulan"),
        F.year("tanggal").alias("tahun"),
    )


def dim_produk(
    products: DataFrame, translation: DataFrame, on: str = "category_code",
    known: DataFrame | None = None,
) -> DataFrame:
    keyed = surrogate_keys(cleanse(products, "product_id"), "product_id", "produk_key", known)
    return keyed.join(cleanse(translation, on), on, "left").select(
        "produk_key",
        F.col("product_code").alias("produk_id"),
        F.col("product_category_name").alias("kategori"),
        F.col("product_category_english").alias("kategori_inggris"),
        F.col("product_length").alias("panjang"),
        F.col("product_weight").alias("berat"),
        "product_id",
    )


def dim_pelanggan(customers: DataFrame, known: DataFrame | None = None) -> DataFrame:
    keyed = surrogate_keys(cleanse(customers, "customer_id"), "customer_id", "pelanggan_key", known)
    return keyed.select(
        "pelanggan_key",
        F.col("customer_code").alias("pelanggan_id"),
        F.col("customer_city").alias("kota"),
        F.col("customer_state").alias("state"),
        "customer_id",
    )


def dim_seller(sellers: DataFrame, known: DataFrame | None = None) -> DataFrame:
    if known is not None:
        known = known.withColumnRenamed("source_seller_id", "seller_id")
    keyed = surrogate_keys(cleanse(sellers, "seller_id"), "seller_id", "seller_key", known)
    return keyed.select(
        "seller_key",
        F.col("seller_code").alias("seller_id_text"),
        F.col("seller_city").alias("kota"),
        F.col("seller_state").alias("state"),
        F.col("seller_id").alias("source_seller_id"),
    ).withColumnRenamed("seller_id_text", "seller_id")


def dim_metode_pembayaran(payments: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Methods of all payments."""
    methods = payments.select("payment_code", "payment_type")
    return surrogate_keys(
        cleanse(methods.distinct(), "payment_code"), "payment_code", "metode_key", known
    ).select(
        F.col("metode_key").cast("int"),
        F.col("payment_type").alias("metode_pembayaran"),
        "payment_code",
    )


def keyed_orders(orders: DataFrame, waktu: DataFrame, pelanggan: DataFrame) -> DataFrame:
    """Orders with their date and customer keys, NULL where date or customer is unknown."""
    placed = F.col("order_purchase_timestamp").cast("date")
    rows = cleanse(
        orders.select(
            "order_id",
            "customer_id",
            placed.alias("tanggal"),
            F.date_diff("order_delivered_customer_date", placed).alias("durasi_pengiriman"),
        ),
        "order_id",
    )
    return (
        rows.join(waktu.select("tanggal", "waktu_id"), "tanggal", "left")
        .join(pelanggan.select("customer_id", "pelanggan_key"), "customer_id", "left")
        .select(
            "order_id", "waktu_id", "pelanggan_key", "durasi_pengiriman",
            F.year("tanggal").alias("tahun"), F.month("tanggal").alias("bulan"),
        )
    )


def keyed_lines(
    items: DataFrame, orders: DataFrame, produk: DataFrame, seller: DataFrame
) -> DataFrame:
    """Order items with all four dimension keys, the base of three facts.

    An item of which the order, product or seller is unknown stays, with that key NULL. The columns of the order
    stand together, as they repeat from item to item and so take little room where lines are moved.
    """
    return (
        items.join(orders, "order_id", "left")
        .join(produk.select("product_id", "produk_key"), "product_id", "left")
        .join(
            seller.select(F.col("source_seller_id").alias("seller_id"), "seller_key"), "seller_id", "left"
        )
        .select(
            "order_id",
            "waktu_id",
            "pelanggan_key",
            "durasi_pengiriman",
            *LAYOUT,
            "produk_key",
            "seller_key",
            F.col("quantity").alias("jumlah"),
            F.col("price").cast(MONEY).alias("total_harga"),
        )
    )


def fakta_penjualan(lines: DataFrame) -> DataFrame:
    return lines.select(
        "waktu_id", "produk_key", "pelanggan_key", "seller_key", "jumlah", "total_harga", *LAYOUT
    )


def fakta_pengiriman(lines: DataFrame) -> DataFrame:
    """One delivery per order item, as it names the item's product and seller."""
    return lines.select(
        "waktu_id", "pelanggan_key", "seller_key", "produk_key", "durasi_pengiriman", *LAYOUT
    )


def fakta_pembayaran(payments: DataFrame, orders: DataFrame, metode: DataFrame) -> DataFrame:
    """One row per payment, numbered by order and place among the order's payments."""
    matched = payments.join(metode.select("payment_code", "metode_key"), "payment_code", "left").join(
        orders.select("order_id", "waktu_id", "pelanggan_key", *LAYOUT), "order_id", "left"
    )
    # Numbering moves and writes all columns that it is given.
    used = matched.select(
        "order_id", "waktu_id", "pelanggan_key", *LAYOUT, "payment_sequential", "metode_key", "payment_value"
    )
    numbered = surrogate_keys(used, ["order_id", "payment_sequential"], "pembayaran_key")
    return numbered.select(
        "pembayaran_key",
        "waktu_id",
        "pelanggan_key",
        "metode_key",
        F.col("payment_value").cast(MONEY).alias("total_bayar"),
        *LAYOUT,
    )


def fakta_review(reviews: DataFrame, lines: DataFrame) -> DataFrame:
    """A row per review and item of its order, on the item's product."""
    items = lines.select("order_id", "waktu_id", "pelanggan_key", "produk_key", *LAYOUT)
    return (
        cleanse(reviews, "review_id")
        .select("order_id", F.col("review_score").alias("skor_review"))
        .join(items, "order_id")
        .select("waktu_id", "pelanggan_key", "produk_key", "skor_review", *LAYOUT)
    )


def fakta_seller(penjualan: DataFrame) -> DataFrame:
    """Units per date, seller and product; year and month follow from the date."""
    keys = ["waktu_id", "seller_key", "produk_key"]
    keys += [c for c in LAYOUT if c in penjualan.columns]
    return penjualan.groupBy(*keys).agg(F.sum("jumlah").alias("jumlah_terjual"))


def reconcile(star: Mapping[str, DataFrame], source: Mapping[str, DataFrame]) -> DataFrame:
    """Rows and money of each fact beside those of the tables that it comes from.

    A load that keeps everything has equal numbers on both sides.
    """
    no_rows, no_total = F.lit(None).cast("long"), F.lit(None).cast("double")
    items = source["order_items"]
    per_order = items.groupBy("order_id").agg(F.count("*").alias("n"))
    reviewed = source["order_reviews"].join(per_order, "order_id")
    counted = F.count("*")
    sides = {
        "fakta_penjualan": (items, counted, F.sum("price").cast("double"), "total_harga"),
        "fakta_pengiriman": (items, counted, no_total, None),
        "fakta_pembayaran": (
            source["order_payments"], counted, F.sum("payment_value").cast("double"), "total_bayar"
        ),
        "fakta_review": (reviewed, F.coalesce(F.sum("n"), F.lit(0)), no_total, None),
    }
    # Each side is a row of its own, with the other side's columns missing.
    rows = []
    for fact, (expected, n, total, money) in sides.items():
        loaded = F.sum(money).cast("double") if money else no_total
        there = expected.agg(n.alias("source_rows"), total.alias("source_total"))
        here = star[fact].agg(counted.alias("fact_rows"), loaded.alias("fact_total"))
        label = F.lit(fact).alias("fact")
        rows.append(there.select(label, "source_rows", "source_total", no_rows.alias("fact_rows"), no_total.alias("fact_total")))
        rows.append(here.select(label, no_rows.alias("source_rows"), no_total.alias("source_total"), "fact_rows", "fact_total"))
    columns = ("source_rows", "source_total", "fact_rows", "fact_total")
    return reduce(DataFrame.union, rows).groupBy("fact").agg(*[F.max(c).alias(c) for c in columns])
