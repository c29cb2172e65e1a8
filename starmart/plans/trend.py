"""Monthly trend, its projection, category movers and rule-based advice."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from starmart.functions.scalars import exact_mean, money, safe_ratio, short_month_label
from starmart.model import Star
from starmart.operators.aggregates import aggregate, row_count, total, value_count
from starmart.operators.ordering import ascending, bottom, descending, ranked, top



def _by(**columns: str) -> dict:
    return {name: (table, F.col(name)) for name, table in columns.items()}


# What happened ----------------------------------------------------------------


def _months(star: Star) -> DataFrame:
    sums = aggregate(
        star,
        "fakta_penjualan",
        ("dim_waktu",),
        {"total_penjualan": total("total_harga"), "jumlah_transaksi": row_count()},
        _by(tahun="dim_waktu", bulan="dim_waktu"),
    )
    return sums.withColumn("total_penjualan", money(F.col("total_penjualan")))


def trend_monthly(star: Star) -> DataFrame:
    return _months(star).orderBy(ascending("tahun"), ascending("bulan"))


def _category_totals(star: Star) -> DataFrame:
    sums = aggregate(
        star,
        "fakta_penjualan",
        ("dim_produk",),
        {"total": total("total_harga"), "qty": total("jumlah")},
        _by(kategori="dim_produk", kategori_inggris="dim_produk"),
    )
    return sums.withColumn("total", money(F.col("total")))


def top5_categories(star: Star, k: int = 5) -> DataFrame:
    return top(_category_totals(star), k, "total", "kategori", "kategori_inggris")


def bottom5_categories(star: Star, k: int = 5) -> DataFrame:
    return bottom(_category_totals(star), k, "total", "kategori", "kategori_inggris")


def review_summary(star: Star, low: int = 2) -> DataFrame:
    score = F.col("skor_review")
    return star["fakta_review"].agg(
        exact_mean(F.sum(score), F.count(score), 2).alias("rata2"),
        F.count(F.lit(1)).alias("jumlah_review"),
        F.count_if(score <= low).alias("review_rendah"),
    )


def delivery_summary(star: Star) -> DataFrame:
    days = F.col("durasi_pengiriman")
    return star["fakta_pengiriman"].agg(
        exact_mean(F.sum(days), F.count(days), 1).alias("rata2")
    )


def slowest_cities(star: Star, min_count: int = 5, k: int = 5) -> DataFrame:
    """Cities with the longest mean delivery; one with no durations at all comes first."""
    sums = aggregate(
        star,
        "fakta_pengiriman",
        ("dim_pelanggan",),
        {
            "days": total("durasi_pengiriman"),
            "n": value_count("durasi_pengiriman"),
            "jumlah": row_count(),
        },
        _by(kota="dim_pelanggan", state="dim_pelanggan"),
    )
    means = sums.filter(F.col("jumlah") >= min_count).select(
        "kota", "state", exact_mean(F.col("days"), F.col("n"), 1).alias("rata_rata_hari"), "jumlah"
    )
    return top(means, k, "rata_rata_hari", "kota", "state")


def payment_mix(star: Star) -> DataFrame:
    sums = aggregate(
        star,
        "fakta_pembayaran",
        ("dim_metode_pembayaran",),
        {"jumlah": row_count(), "total": total("total_bayar")},
        _by(metode_pembayaran="dim_metode_pembayaran"),
        {"dim_metode_pembayaran": F.col("metode_pembayaran").isNotNull()},
    )
    mix = sums.withColumn("total", money(F.col("total")))
    return ranked(mix, "jumlah", "metode_pembayaran")


def last_period(star: Star) -> DataFrame:
    return _months(star).select("tahun", "bulan").orderBy(F.desc("tahun"), F.desc("bulan")).limit(1)


# What will happen -------------------------------------------------------------


def _indexed(monthly: DataFrame) -> DataFrame:
    """Months numbered from 0 by position; gaps are not filled.

    One row per month reaches this window, so a single task is enough.
    """
    position = F.row_number().over(Window.orderBy(ascending("tahun"), ascending("bulan")))
    return monthly.withColumn("x", position - 1)


def _slope(y: str) -> Column:
    return F.coalesce(F.regr_slope(y, "x"), F.lit(0.0))


def _intercept(y: str) -> Column:
    """Of a fit to one month or none it is 0."""
    return F.coalesce(F.regr_intercept(y, "x"), F.lit(0.0))


def fit_series(monthly: DataFrame) -> DataFrame:
    """Least-squares lines of amount and count over the month index, in one row."""
    return _indexed(monthly).agg(
        F.count(F.lit(1)).alias("n"),
        _slope("total_penjualan").alias("slope_total"),
        _intercept("total_penjualan").alias("intercept_total"),
        _slope("jumlah_transaksi").alias("slope_count"),
        _intercept("jumlah_transaksi").alias("intercept_count"),
        F.avg("total_penjualan").alias("mean_total"),
        F.max(F.struct("tahun", "bulan")).alias("last"),
    )


def linear_fit(monthly: DataFrame) -> DataFrame:
    def line(metric: str, suffix: str) -> Column:
        return F.struct(
            F.lit(metric).alias("metric"),
            F.col("n"),
            F.col(f"slope_{suffix}").alias("slope"),
            F.col(f"intercept_{suffix}").alias("intercept"),
            (F.col("n") >= 2).alias("valid"),
        )

    lines = F.array(line("penjualan", "total"), line("transaksi", "count"))
    return fit_series(monthly).select(F.inline(lines))


def linear_fit_monthly(star: Star) -> DataFrame:
    return linear_fit(_months(star))


def forecast(monthly: DataFrame, horizon: int = 3) -> DataFrame:
    """The fitted lines carried ``horizon`` months on from the last one, at least 0."""
    x = F.col("n") - 1 + F.col("ke")

    def at(suffix: str) -> Column:
        return F.col(f"intercept_{suffix}") + F.col(f"slope_{suffix}") * x

    steps = fit_series(monthly).withColumn("ke", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    month = F.add_months(
        F.make_date("last.tahun", "last.bulan", F.lit(1)), F.col("ke")
    )
    return steps.select(
        "ke",
        F.year(month).alias("tahun"),
        F.month(month).alias("bulan"),
        F.greatest(F.lit(0.0), at("total")).alias("penjualan"),
        F.greatest(F.lit(0), F.round(at("count")).cast("long")).alias("transaksi"),
    ).orderBy("ke")


def forecast_3m(star: Star, horizon: int = 3) -> DataFrame:
    return forecast(_months(star), horizon)


def growth(monthly: DataFrame, up: float = 1.0, down: float = -1.0) -> DataFrame:
    """Monthly growth in per cent of the mean month, and its direction."""
    rate = safe_ratio(F.col("slope_total") * 100, F.coalesce("mean_total", F.lit(0.0)))
    direction = (
        F.when(F.col("rate") > up, "naik").when(F.col("rate") < down, "turun").otherwise("stabil")
    )
    rated = fit_series(monthly).select(rate.alias("rate"))
    return rated.select(F.col("rate").alias("persen"), direction.alias("arah"))


def growth_direction(star: Star, up: float = 1.0, down: float = -1.0) -> DataFrame:
    return growth(_months(star), up, down)


def category_trend_of(monthly: DataFrame, min_points: int = 3) -> DataFrame:
    """Slope per category in per cent of its mean month, over the months it has."""
    position = F.row_number().over(
        Window.partitionBy("kategori").orderBy(ascending("tahun"), ascending("bulan"))
    )
    lines = (
        monthly.withColumn("x", position - 1)
        .groupBy("kategori")
        .agg(
            F.count(F.lit(1)).alias("n"),
            _slope("total").alias("slope"),
            (F.sum("total").cast("double") / F.count(F.lit(1))).alias("mean"),
        )
        .filter(F.col("n") >= min_points)
    )
    rate = safe_ratio(F.col("slope") * 100, F.col("mean"))
    return lines.select("kategori", rate.alias("persen"), F.col("mean").alias("rata"))


def _category_trend(star: Star, min_points: int = 3) -> DataFrame:
    monthly = aggregate(
        star,
        "fakta_penjualan",
        ("dim_produk", "dim_waktu"),
        {"total": total("total_harga")},
        _by(kategori="dim_produk", tahun="dim_waktu", bulan="dim_waktu"),
    )
    return category_trend_of(monthly, min_points)


def category_trend(star: Star, min_points: int = 3) -> DataFrame:
    return ranked(_category_trend(star, min_points), "persen", "kategori")


def movers(trend: DataFrame, k: int = 3) -> DataFrame:
    """Both ends of the category trend; the falling side runs from its steepest fall.

    Each category stands on both sides, so the trend is made once. Spark cuts a side
    to its first k before the shuffle.
    """
    rising = F.col("side") == "naik"
    both = trend.withColumn("side", F.explode(F.array(F.lit("naik"), F.lit("turun"))))
    order = Window.partitionBy("side").orderBy(
        F.when(rising, F.col("persen")).desc_nulls_first(),
        F.when(~rising, F.col("persen")).asc_nulls_last(),
        F.when(rising, F.col("kategori")).asc_nulls_last(),
        F.when(~rising, F.col("kategori")).desc_nulls_first(),
    )
    ranks = both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranks.select("side", "rank", "kategori", "persen").orderBy("side", "rank")


def category_movers(star: Star, k: int = 3) -> DataFrame:
    return movers(_category_trend(star), k)


# What to do -------------------------------------------------------------------


@dataclass(frozen=True)
class Thresholds:
    falling: float = -2.0
    rising: float = 2.0
    low_reviews: float = 15.0
    slow_city: float = 1.3
    one_method: float = 60.0


_PRIORITIES = ("Tinggi", "Sedang", "Rendah")


def _advice(
    df: DataFrame, rule: Column | str, seq: Column | int, priority: Column | str, area: str,
    subject: Column, metric: Column,
) -> DataFrame:
    def text(value) -> Column:
        return F.lit(value) if isinstance(value, str) else value

    number = F.lit(seq) if isinstance(seq, int) else seq
    return df.select(
        text(rule).alias("rule_id"),
        number.cast("int").alias("seq"),
        text(priority).alias("priority"),
        F.lit(area).alias("area"),
        subject.cast("string").alias("subject"),
        F.round(metric, 1).alias("metric"),
    )


def advise(
    growth_rate: DataFrame,
    category_moves: DataFrame,
    reviews: DataFrame,
    cities: DataFrame,
    deliveries: DataFrame,
    payments: DataFrame,
    limits: Thresholds = Thresholds(),
) -> DataFrame:
    """Advice rows from the summaries, most urgent first.

    Each rule reads a summary of a few rows; the rules are put together by union.
    """
    direction = F.col("arah")
    sales = _advice(
        growth_rate,
        F.when(direction == "turun", "R1a").when(direction == "naik", "R1b").otherwise("R1c"),
        1,
        F.when(direction == "turun", "Tinggi").otherwise("Sedang"),
        "Penjualan",
        direction,
        F.col("persen"),
    )
    is_fall = F.col("side") == "turun"
    moves = category_moves.filter(
        F.when(is_fall, F.col("persen") < limits.falling).otherwise(
            F.col("persen") > limits.rising
        )
    )
    products = _advice(
        moves,
        F.when(is_fall, "R2").otherwise("R3"),
        F.when(is_fall, 10).otherwise(20) + F.col("rank"),
        F.when(is_fall, "Tinggi").otherwise("Sedang"),
        "Produk",
        F.col("kategori"),
        F.col("persen"),
    )
    low_share = safe_ratio(F.col("review_rendah") * 100, F.col("jumlah_review"))
    unhappy = _advice(
        reviews.withColumn("share", low_share).filter(F.col("share") > limits.low_reviews),
        "R4", 31, "Tinggi", "Kepuasan Pelanggan", F.lit(None), F.col("share"),
    )
    # The slowest city and the overall mean, brought into one row.
    slowest = cities.orderBy(
        descending("rata_rata_hari"), ascending("kota"), ascending("state")
    ).limit(1)
    both = slowest.select("kota", "state", "rata_rata_hari").unionByName(
        deliveries.select("rata2"), allowMissingColumns=True
    )
    pace = both.agg(
        F.max("kota").alias("kota"),
        F.max("state").alias("state"),
        F.max("rata_rata_hari").alias("slow"),
        F.max("rata2").alias("mean"),
    ).filter(F.col("slow") > F.col("mean") * limits.slow_city)
    city = F.concat(
        F.coalesce("kota", F.lit("")), F.lit(" ("), F.coalesce("state", F.lit("")), F.lit(")")
    )
    logistics = _advice(pace, "R5", 41, "Sedang", "Logistik", city, F.col("slow"))
    # Equal counts go to the first method by name, as in the mix itself.
    leader = top(payments, 1, "jumlah", "metode_pembayaran")
    counted = payments.agg(F.sum("jumlah").alias("everything")).unionByName(
        leader.select("metode_pembayaran", F.col("jumlah").alias("most")),
        allowMissingColumns=True,
    )
    concentration = counted.agg(
        F.max("metode_pembayaran").alias("method"),
        safe_ratio(F.max("most") * 100, F.max("everything")).alias("share"),
    ).filter(F.col("share") > limits.one_method)
    single = _advice(
        concentration, "R6", 51, "Rendah", "Pembayaran", F.col("method"), F.col("share")
    )
    rows = reduce(DataFrame.unionByName, [sales, products, unhappy, logistics, single])
    urgency = F.array_position(F.array(*[F.lit(p) for p in _PRIORITIES]), F.col("priority"))
    return rows.orderBy(urgency, "seq")


def recommendations(star: Star, limits: Thresholds = Thresholds()) -> DataFrame:
    return advise(
        growth_direction(star),
        category_movers(star),
        review_summary(star),
        slowest_cities(star),
        delivery_summary(star),
        payment_mix(star),
        limits,
    )


# Chart ------------------------------------------------------------------------


def series(monthly: DataFrame, horizon: int = 3) -> DataFrame:
    """History followed by projection; the projection line starts at the last actual."""
    year, month = F.col("tahun"), F.col("bulan")
    value = F.round("total_penjualan", 2)
    # Months are few: see _indexed.
    is_last = F.col("x") == F.max("x").over(Window.partitionBy())
    history = _indexed(monthly).select(
        F.col("x").cast("long").alias("seq"),
        short_month_label(year, month).alias("label"),
        value.alias("historis"),
        F.when(is_last & (value != 0), value).alias("proyeksi"),
        F.lit(None).cast("long").alias("ke"),
    )
    projection = forecast(monthly, horizon).select(
        F.concat(short_month_label(year, month), F.lit(" (proy.)")).alias("label"),
        F.round("penjualan", 2).alias("proyeksi"),
        F.col("ke").cast("long").alias("ke"),
    )
    joined = history.unionByName(projection, allowMissingColumns=True)
    last = F.max("seq").over(Window.partitionBy())
    return joined.select(
        F.coalesce("seq", F.coalesce(last, F.lit(-1)) + F.col("ke")).alias("seq"),
        "label",
        "historis",
        "proyeksi",
    ).orderBy("seq")


def forecast_series(star: Star, horizon: int = 3) -> DataFrame:
    return series(_months(star), horizon)
