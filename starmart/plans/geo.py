"""Counts per state, their coordinates and their scaling for a map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from starmart.filters import NO_FILTER, FilterSpec, option
from starmart.functions.lookups import state_coordinates
from starmart.functions.scalars import non_empty
from starmart.model import Star
from starmart.operators.aggregates import aggregate, distinct_count
from starmart.operators.joins import attach, attach_all
from starmart.operators.keys import cleanse
from starmart.operators.ordering import ranked


def _members_per_state(star: Star, dimension: str) -> DataFrame:
    named = star[dimension].filter(non_empty(F.col("state")))
    counts = named.groupBy("state").agg(F.count(F.lit(1)).alias("jumlah"))
    return ranked(counts, "jumlah", "state")


def geo_customers_all(star: Star, f: FilterSpec = NO_FILTER) -> DataFrame:
    """All customers per state; no filter applies."""
    return _members_per_state(star, "dim_pelanggan")


def geo_sellers_all(star: Star, f: FilterSpec = NO_FILTER) -> DataFrame:
    """All sellers per state; no filter applies."""
    return _members_per_state(star, "dim_seller")


def _buyers_per_state(star: Star, f: FilterSpec, dimension: str) -> DataFrame:
    where = f.by_dimension(state_of=dimension)
    named = non_empty(F.col("state"))
    where[dimension] = where[dimension] & named if dimension in where else named
    counts = aggregate(
        star,
        "fakta_penjualan",
        ("dim_waktu", "dim_produk", dimension),
        {"jumlah": distinct_count("pelanggan_key")},
        {"state": (dimension, F.col("state"))},
        where,
        f.year,
    )
    return ranked(counts, "jumlah", "state")


def geo_customers_active(star: Star, f: FilterSpec = NO_FILTER) -> DataFrame:
    """Customers with a sale, per state of the customer."""
    return _buyers_per_state(star, f, "dim_pelanggan")


def geo_buyers_by_seller_state(star: Star, f: FilterSpec = NO_FILTER) -> DataFrame:
    """Customers with a sale, per state of the seller, which the state filter is on."""
    return _buyers_per_state(star, f, "dim_seller")


def geo_payment_semi(star: Star, f: FilterSpec) -> DataFrame:
    """Customers per state whose sale falls on a day they paid by ``f.payment``.

    Sales carry no payment method; date and customer are what both facts share.
    Sales and payments shrink to distinct date and customer pairs beforehand, so
    a customer with many sales on a day counts once in the shuffle.
    """
    if f.payment is None:
        raise ValueError("a payment method is needed")
    where = f.by_dimension()
    sales = star.fact("fakta_penjualan", f.year, f.month).select("waktu_id", "produk_key", "pelanggan_key")
    needed = {
        d: [] for d in ("dim_waktu", "dim_produk")
        if d in where or not star.holds("fakta_penjualan", d)
    }
    sales = attach_all(sales, star, needed, where)
    method = F.col("metode_pembayaran") == F.lit(f.payment)
    paid = attach(
        star.fact("fakta_pembayaran", f.year, f.month).select("waktu_id", "pelanggan_key", "metode_key"),
        star,
        "dim_metode_pembayaran",
        where=method,
    )
    if "dim_waktu" in where:
        paid = attach(paid, star, "dim_waktu", where=where["dim_waktu"])
    pair = ["waktu_id", "pelanggan_key"]
    buyers = (
        sales.select(*pair).distinct()
        .join(paid.select(*pair).distinct(), pair, "left_semi")
        .select("pelanggan_key").distinct()
    )
    named = non_empty(F.col("state"))
    located = attach(
        buyers,
        star,
        "dim_pelanggan",
        "state",
        where=where["dim_pelanggan"] & named if "dim_pelanggan" in where else named,
    )
    # Buyers are distinct and a customer has one row, so rows are customers.
    counts = located.groupBy("state").agg(F.count(F.lit(1)).alias("jumlah"))
    return ranked(counts, "jumlah", "state")


def geo_counts(star: Star, f: FilterSpec = NO_FILTER, kind: str | None = None) -> DataFrame:
    """Counts for the map of ``pelanggan`` or ``seller``; anything else means pelanggan."""
    sellers = option(kind, ("pelanggan", "seller"), "pelanggan") == "seller"
    if f.has_time:
        return geo_buyers_by_seller_state(star, f) if sellers else geo_customers_active(star, f)
    return geo_sellers_all(star, f) if sellers else geo_customers_all(star, f)


def geo_enrich(counts: DataFrame, coordinates: DataFrame | None = None) -> DataFrame:
    """Coordinates of each state and the largest count among the known ones.

    States are trimmed after they were counted, so a padded and a plain spelling
    stay two rows. A state without coordinates is dropped. Only the built-in table is
    sure to be small; one that is given joins as Spark sees fit, a code once.
    """
    if coordinates is None:
        places = F.broadcast(state_coordinates(counts.sparkSession))
    else:
        places = cleanse(coordinates, "code")
    located = counts.withColumn("state", F.trim("state")).join(
        places, F.col("state") == F.col("code")
    )
    # At most one row per spelling of a state reaches this window.
    return located.select(
        "state",
        "nama",
        "jumlah",
        "lat",
        "lng",
        F.max("jumlah").over(Window.partitionBy()).alias("max"),
    )


# Marker radius in metres and pixels, and the colour steps.
_RADIUS_METRES = (15000, 200000)
_RADIUS_PIXELS = (6, 12)
_COLOURS = ((0.66, "#e74c3c"), (0.33, "#f1c40f"), (None, "#2ecc71"))


def geo_marker_scale(enriched: DataFrame) -> DataFrame:
    """Marker size by the root of the min-max scaled count, colour by share of the largest."""
    lowest = F.min("jumlah").over(Window.partitionBy())
    spread = F.col("max") - F.col("lowest")
    position = (F.col("jumlah") - F.col("lowest")) / spread
    norm = F.when(spread == 0, F.lit(0.5)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), position))
    )
    smallest, largest = _RADIUS_METRES
    pixels, more_pixels = _RADIUS_PIXELS
    share = F.when(F.col("max") != 0, F.col("jumlah") / F.col("max")).otherwise(F.lit(0.0))
    (high, high_colour), (middle, middle_colour), (_, low_colour) = _COLOURS
    colour = (
        F.when(F.col("share") >= high, high_colour)
        .when(F.col("share") >= middle, middle_colour)
        .otherwise(low_colour)
    )
    return (
        enriched.withColumn("lowest", lowest)
        .withColumn("norm", norm)
        .withColumn("scaled", F.sqrt("norm"))
        .withColumn("share", share)
        .select(
            "state",
            "jumlah",
            "norm",
            "scaled",
            (smallest + F.col("scaled") * (largest - smallest)).alias("radius"),
            F.round(pixels + F.col("scaled") * more_pixels).cast("int").alias("pixel_radius"),
            colour.alias("color"),
        )
    )


def geo_json(enriched: DataFrame, kind: str = "pelanggan") -> DataFrame:
    """The map's JSON document: its kind, its states and the largest count."""
    state = F.struct(
        (-F.col("jumlah")).alias("order"),
        F.struct("state", "nama", "jumlah", "lat", "lng").alias("item"),
    )
    # Bounded by the states that have coordinates, like the windows above.
    in_order = F.sort_array(F.collect_list(state))
    document = enriched.agg(
        F.transform(in_order, lambda s: s["item"]).alias("data"),
        F.coalesce(F.max("max"), F.lit(0)).alias("max"),
    )
    return document.select(
        F.lit(kind).alias("tipe"),
        F.to_json("data").alias("data"),
        "max",
        F.to_json(F.struct(F.lit(kind).alias("tipe"), "data", "max")).alias("document"),
    )
