"""Operational tables of other shapes, as the builders expect them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starmart.model import OPERATIONAL_SCHEMAS

# What stands for a column that a table may lack.
DEFAULTS: dict[str, dict[str, str]] = {
    "order_items": {"order_item_id": "NULL", "quantity": "1"},
    "products": {
        "product_code": "product_id", "category_code": "product_category_name",
        "product_length": "NULL", "product_weight": "NULL",
    },
    "customers": {"customer_code": "customer_id"},
    "sellers": {"seller_code": "seller_id", "seller_city": "NULL", "seller_state": "NULL"},
    "order_payments": {
        "payment_sequential": "1", "payment_code": "payment_type", "payment_value": "NULL",
    },
    "category_translation": {
        "category_code": "product_category_name",
        "product_category_english": "product_category_name_english",
    },
}

# Ids keep the type that they come with, text or number.
_IDS = {"order_id", "customer_id", "product_id", "seller_id", "review_id"}


def adapt_operational(
    tables: Mapping[str, DataFrame],
    columns: Mapping[str, Mapping[str, Column | str]] | None = None,
) -> dict[str, DataFrame]:
    """The eight operational tables from tables that only hold what the questions use.

    ``columns`` names, per table, where a column comes from: another column's name or an
    expression. What it does not name is taken by its own name, else from ``DEFAULTS``: a
    code is the id, an item is one piece, a payment's code is its type, a category is
    translated by its name. Without a translation table a category's name stands for it.
    """
    columns = columns or {}
    tables = dict(tables)
    if "category_translation" not in tables:
        name = columns.get("products", {}).get("product_category_name", "product_category_name")
        named = name if isinstance(name, Column) else F.expr(name)
        tables["category_translation"] = (
            tables["products"].select(named.alias("product_category_name")).dropna().distinct()
            .withColumn("product_category_name_english", F.col("product_category_name"))
        )
    missing = set(OPERATIONAL_SCHEMAS) - set(tables)
    if missing:
        raise ValueError(f"no table {sorted(missing)}")
    return {name: _adapted(name, tables[name], columns.get(name, {})) for name in OPERATIONAL_SCHEMAS}


def _adapted(table: str, df: DataFrame, columns: Mapping[str, Column | str]) -> DataFrame:
    fields = {f.name: f.dataType for f in OPERATIONAL_SCHEMAS[table].fields}

    def value(name: str) -> Column:
        source = columns.get(name)
        if source is None:
            source = name if name in df.columns else DEFAULTS.get(table, {}).get(name)
        if source is None:
            raise ValueError(f"{table} has no column {name}")
        if isinstance(source, Column):
            found = source
        elif source in fields and source not in df.columns:
            # A default that names a column which itself comes from another.
            found = value(source)
        else:
            found = F.expr(source)
        return found if name in _IDS else found.cast(fields[name])

    return df.select(*[value(name).alias(name) for name in fields])
