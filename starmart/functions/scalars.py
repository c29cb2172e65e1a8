"""Column expressions used by more than one operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

# The month names shown to users.
MONTH_NAMES = (
    "Januari", "Februari", "Maret", "April", "Mei", "Juni",
    "Juli", "Agustus", "September", "Oktober", "November", "Desember",
)
MONTH_NAMES_SHORT = (
    "Jan", "Feb", "Mar", "Apr", "Mei", "Jun", "Jul", "Agu", "Sep", "Okt", "Nov", "Des",
)

_WHOLE = DecimalType(20, 0)


def non_empty(text: Column) -> Column:
    return text.isNotNull() & (text != F.lit(""))


def money(total: Column) -> Column:
    """An exact decimal total as the double that leaves the library."""
    return total.cast("double")


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def exact_mean(total: Column, n: Column, digits: int) -> Column:
    """``total / n`` of whole numbers, rounded half up once; NULL when ``n`` is 0."""
    quotient = total.cast(_WHOLE) / n.cast(_WHOLE)
    return F.when(n > 0, F.round(quotient, digits)).cast("double")


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator``, or 0 where the denominator is not positive."""
    ratio = numerator.cast("double") / denominator.cast("double")
    return F.when(denominator > 0, ratio).otherwise(F.lit(0.0))


def elapsed_days(start: Column, end: Column) -> Column:
    return (F.unix_timestamp(end) - F.unix_timestamp(start)) / F.lit(86400)


def month_text(month: Column) -> Column:
    return F.lpad(month.cast("string"), 2, "0")


def year_month_label(year: Column, month: Column) -> Column:
    """``YYYY-MM``; a NULL part is left out, as SQL ``CONCAT`` does."""
    blank = F.lit("")
    return F.concat(
        F.coalesce(year.cast("string"), blank),
        F.lit("-"),
        F.coalesce(month_text(month), blank),
    )


def _month_name(month: Column, names: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(name) for name in names]), month)


def short_month_label(year: Column, month: Column) -> Column:
    """Such as ``Mei '97``."""
    return F.concat(
        _month_name(month, MONTH_NAMES_SHORT),
        F.lit(" '"),
        F.right(year.cast("string"), F.lit(2)),
    )


def period_description(year: Column, month: Column) -> Column:
    """The caption of counts over a period; either part may be NULL."""
    name = _month_name(month, MONTH_NAMES)
    year_text = year.cast("string")
    when = (
        F.when(
            year.isNotNull() & month.isNotNull(), F.concat(F.lit(" di "), name, F.lit(" "), year_text)
        )
        .when(year.isNotNull(), F.concat(F.lit(" di tahun "), year_text))
        .when(month.isNotNull(), F.concat(F.lit(" di bulan "), name))
        .otherwise(F.lit(""))
    )
    return F.concat(F.lit("Pelanggan aktif bertransaksi"), when)
