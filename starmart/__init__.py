"""Retail star-schema analytics as lazy PySpark DataFrame operators."""

from starmart.filters import FilterSpec
from starmart.model import Star

__all__ = ["FilterSpec", "Star"]
