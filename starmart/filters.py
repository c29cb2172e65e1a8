"""The optional filter set shared by the dashboard and map operators."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F


def option(value: str | None, allowed: tuple[str, ...], default: str) -> str:
    """``value`` if it is one of ``allowed``, else ``default``."""
    return value if value in allowed else default


@dataclass(frozen=True)
class FilterSpec:
    """Equality filters, AND-ed; ``None`` means no filter."""

    year: int | None = None
    month: int | None = None
    category: str | None = None
    state: str | None = None
    payment: str | None = None

    def __post_init__(self) -> None:
        for name in ("year", "month"):
            value = getattr(self, name)
            if value is not None and (isinstance(value, bool) or not isinstance(value, int)):
                raise ValueError(f"{name} must be a whole number, got {value!r}")
        if self.year is not None and self.year < 1:
            raise ValueError(f"year must be positive, got {self.year}")
        if self.month is not None and not 1 <= self.month <= 12:
            raise ValueError(f"month must be 1 to 12, got {self.month}")
        for name in ("category", "state", "payment"):
            value = getattr(self, name)
            if value is not None and (not isinstance(value, str) or value == ""):
                raise ValueError(f"{name} must be a non-empty text, got {value!r}")

    @classmethod
    def from_params(cls, params: Mapping[str, str]) -> FilterSpec:
        """From text parameters, where a missing or empty value is no filter."""
        given = {k: params[k] for k in cls.__dataclass_fields__ if params.get(k)}
        for name in ("year", "month"):
            if name in given:
                given[name] = int(given[name])
        return cls(**given)

    @property
    def has_time(self) -> bool:
        return self.year is not None or self.month is not None

    def without(self, *names: str) -> FilterSpec:
        return replace(self, **{name: None for name in names})

    def by_dimension(self, state_of: str = "dim_pelanggan") -> dict[str, Column]:
        """One predicate per filtered dimension, on that dimension's own columns."""
        wanted = [
            ("dim_waktu", "tahun", self.year),
            ("dim_waktu", "bulan", self.month),
            ("dim_produk", "kategori_inggris", self.category),
            (state_of, "state", self.state),
        ]
        grouped: dict[str, list[Column]] = {}
        for table, column, value in wanted:
            if value is not None:
                grouped.setdefault(table, []).append(F.col(column) == F.lit(value))
        return {table: reduce(and_, parts) for table, parts in grouped.items()}


NO_FILTER = FilterSpec()
