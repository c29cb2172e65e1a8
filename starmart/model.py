"""Table schemas and the handle that operators take."""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DateType,
    DecimalType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

MONEY = DecimalType(12, 2)


def _schema(**columns) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in columns.items()])


_INT, _LONG, _TEXT = IntegerType(), LongType(), StringType()

# Date and payment-method keys count days and methods and stay int. The other
# keys number customers, products, sellers and fact rows, which outgrow int.
STAR_SCHEMAS: dict[str, StructType] = {
    "dim_waktu": _schema(
        waktu_id=_INT, tanggal=DateType(), hari=_INT, bulan=_INT, tahun=_INT
    ),
    "dim_produk": _schema(
        produk_key=_LONG, produk_id=_TEXT, kategori=_TEXT,
        kategori_inggris=_TEXT, panjang=_INT, berat=_INT,
    ),
    "dim_pelanggan": _schema(
        pelanggan_key=_LONG, pelanggan_id=_TEXT, kota=_TEXT, state=_TEXT
    ),
    "dim_seller": _schema(seller_key=_LONG, seller_id=_TEXT, kota=_TEXT, state=_TEXT),
    "dim_metode_pembayaran": _schema(metode_key=_INT, metode_pembayaran=_TEXT),
    "fakta_penjualan": _schema(
        id=_LONG, waktu_id=_INT, produk_key=_LONG, pelanggan_key=_LONG,
        seller_key=_LONG, jumlah=_INT, total_harga=MONEY,
    ),
    "fakta_pengiriman": _schema(
        id=_LONG, waktu_id=_INT, pelanggan_key=_LONG, seller_key=_LONG,
        produk_key=_LONG, durasi_pengiriman=_INT,
    ),
    "fakta_pembayaran": _schema(
        pembayaran_key=_LONG, waktu_id=_INT, pelanggan_key=_LONG,
        metode_key=_INT, total_bayar=MONEY,
    ),
    "fakta_review": _schema(
        id=_LONG, waktu_id=_INT, pelanggan_key=_LONG, produk_key=_LONG, skor_review=_INT
    ),
    "fakta_seller": _schema(
        id=_LONG, waktu_id=_INT, seller_key=_LONG, produk_key=_LONG, jumlah_terjual=_LONG
    ),
}

OPERATIONAL_SCHEMAS: dict[str, StructType] = {
    "orders": _schema(
        order_id=_LONG, customer_id=_LONG, order_purchase_timestamp=TimestampType(),
        order_delivered_customer_date=TimestampType(),
    ),
    "order_items": _schema(
        order_id=_LONG, order_item_id=_INT, product_id=_LONG, seller_id=_LONG,
        price=MONEY, quantity=_INT,
    ),
    "products": _schema(
        product_id=_LONG, product_code=_TEXT, category_code=_TEXT,
        product_category_name=_TEXT, product_length=_INT, product_weight=_INT,
    ),
    "category_translation": _schema(category_code=_TEXT, product_category_english=_TEXT),
    "customers": _schema(
        customer_id=_LONG, customer_code=_TEXT, customer_city=_TEXT, customer_state=_TEXT
    ),
    "sellers": _schema(
        seller_id=_LONG, seller_code=_TEXT, seller_city=_TEXT, seller_state=_TEXT
    ),
    "order_payments": _schema(
        order_id=_LONG, payment_sequential=_INT, payment_code=_TEXT,
        payment_type=_TEXT, payment_value=MONEY,
    ),
    "order_reviews": _schema(review_id=_LONG, order_id=_LONG, review_score=_INT),
}

DIMENSION_KEYS = {
    "dim_waktu": "waktu_id",
    "dim_produk": "produk_key",
    "dim_pelanggan": "pelanggan_key",
    "dim_seller": "seller_key",
    "dim_metode_pembayaran": "metode_key",
}

FACT_KEYS = {
    "fakta_penjualan": "id",
    "fakta_pengiriman": "id",
    "fakta_pembayaran": "pembayaran_key",
    "fakta_review": "id",
    "fakta_seller": "id",
}

FOREIGN_KEYS: dict[str, tuple[str, ...]] = {
    "fakta_penjualan": ("dim_waktu", "dim_produk", "dim_pelanggan", "dim_seller"),
    "fakta_pengiriman": ("dim_waktu", "dim_pelanggan", "dim_seller", "dim_produk"),
    "fakta_pembayaran": ("dim_waktu", "dim_pelanggan", "dim_metode_pembayaran"),
    "fakta_review": ("dim_waktu", "dim_pelanggan", "dim_produk"),
    "fakta_seller": ("dim_waktu", "dim_seller", "dim_produk"),
}

#: Columns that facts are partitioned by; they follow from the date of the order.
LAYOUT = {"tahun": _INT, "bulan": _INT}

# A dimension is broadcast only while its known row count is within this bound:
# a key and one or two short labels per row, about 100 MB at most.
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Star:
    """The ten star tables.

    ``row_counts`` holds known dimension sizes; an unknown size counts as large.
    ``enforced`` states which fact keys are non-NULL and have their dimension row in
    all rows: all of them, none, or the dimensions named for each fact. An operator may leave out
    a join that such a key makes and whose columns it never uses. ``colocated`` holds, by fact and
    dimension, the parts of a fact that is laid out by the key of a large dimension.
    """

    tables: Mapping[str, DataFrame]
    row_counts: Mapping[str, int] = field(default_factory=dict)
    enforced: bool | Mapping[str, Collection[str]] = False
    colocated: Mapping[tuple[str, str], Sequence[Mapping[str, DataFrame]]] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def parts(self, fact: str, dimension: str) -> list[Star]:
        """Stars whose facts make up ``fact``, each to be joined with ``dimension`` by itself.

        One, this star, unless the two are laid out by the dimension's key.
        """
        if (fact, dimension) not in self.colocated:
            return [self]
        cold, hot = self.colocated[fact, dimension]
        sizes = {d: self.row_counts[d] for d in self.row_counts if d != dimension}
        # The rows of hot keys in the dimension are at most as many as there are buckets.
        return [
            replace(self, tables=ChainMap(cold, self.tables), row_counts=sizes, colocated={}),
            replace(self, tables=ChainMap(hot, self.tables), row_counts={**sizes, dimension: 0}, colocated={}),
        ]

    def is_small(self, dimension: str) -> bool:
        rows = self.row_counts.get(dimension)
        return rows is not None and rows <= BROADCAST_ROWS

    def holds(self, fact: str, dimension: str) -> bool:
        """Whether every row of the fact is known to have its row of the dimension."""
        if isinstance(self.enforced, bool):
            return self.enforced
        return dimension in self.enforced.get(fact, ())

    def fact(self, name: str, year: int | None = None, month: int | None = None) -> DataFrame:
        """A fact scan; year and month select partitions where the table has them."""
        df = self.tables[name]
        for column, value in (("tahun", year), ("bulan", month)):
            if value is not None and column in df.columns:
                df = df.filter(F.col(column) == F.lit(value))
        return df
