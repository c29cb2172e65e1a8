"""A star that is built on demand and kept as tables in the shared folder."""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable, Collection, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from threading import Lock, RLock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starmart.model import DIMENSION_KEYS, FACT_KEYS, FOREIGN_KEYS, LAYOUT, STAR_SCHEMAS, Star
from starmart.plans import build
from starmart.session import COMPACT, laid_out_by_month, remove_folder, shared_folder, write_and_read
from starmart.sources.colocated import colocate


#: Rows of a business key and a key that are broadcast in the load, about 100 MB.
KEY_MAP_ROWS = 2_000_000
#: Facts that are columns of the keyed lines, row by row.
LAID_OUT = ("fakta_pengiriman",)


class Warehouse(Mapping[str, DataFrame]):
    """Star tables of one source, each written the first time it is asked for.

    Facts are laid out by year and month, and by date within them. Beside the star the
    folder holds two working tables, the keyed orders and the keyed lines. ``known`` holds
    the key maps of an earlier load, by dimension; keys given then stay the same.
    """

    def __init__(
        self,
        spark: SparkSession,
        source: Mapping[str, DataFrame],
        folder: str,
        known: Mapping[str, DataFrame] | None = None,
    ):
        self._spark = spark
        self.source = source
        self.known = known or {}
        self._folder = folder
        self._written: dict[str, DataFrame] = {}
        self._published: dict[str, DataFrame] = {}
        self.paths: dict[str, str] = {}
        self._null_keys: dict[str, dict[str, int]] = {}
        self._locks: defaultdict[str, RLock] = defaultdict(RLock)
        self._locking = Lock()
        self._star = Star(self, _RowCounts(self), _Enforced(self))
        self._colocated: dict[tuple[str, str], Star] = {}

    def frame(self, name: str) -> DataFrame:
        """The plan that builds one table from the tables before it."""
        source, keyed, side, known = self.source, self.keyed, self._side, self.known.get(name)
        plans: dict[str, Callable[[], DataFrame]] = {
            "dim_waktu": lambda: build.dim_waktu(source["orders"], known),
            "dim_produk": lambda: build.dim_produk(
                source["products"], source["category_translation"], known=known
            ),
            "dim_pelanggan": lambda: build.dim_pelanggan(source["customers"], known),
            "dim_seller": lambda: build.dim_seller(source["sellers"], known),
            "dim_metode_pembayaran": lambda: build.dim_metode_pembayaran(
                source["order_payments"], known
            ),
            "keyed_orders": lambda: build.keyed_orders(
                source["orders"], side("dim_waktu"), side("dim_pelanggan")
            ),
            "keyed_lines": lambda: build.keyed_lines(
                source["order_items"],
                keyed("keyed_orders"),
                side("dim_produk"),
                side("dim_seller"),
            ),
            "fakta_penjualan": lambda: build.fakta_penjualan(keyed("keyed_lines")),
            "fakta_pengiriman": lambda: build.fakta_pengiriman(keyed("keyed_lines")),
            "fakta_pembayaran": lambda: build.fakta_pembayaran(
                source["order_payments"], keyed("keyed_orders"), side("dim_metode_pembayaran")
            ),
            "fakta_review": lambda: build.fakta_review(
                source["order_reviews"], keyed("keyed_lines")
            ),
            "fakta_seller": lambda: build.fakta_seller(self["fakta_penjualan"]),
        }
        return plans[name]()

    def keyed(self, name: str) -> DataFrame:
        """A written table with its business keys."""
        if name == "fakta_penjualan":
            # The keyed lines hold the sales fact, so it is not written again.
            name = "keyed_lines"
        with self._locking:
            lock = self._locks[name]
        with lock:
            if name not in self._written:
                self._written[name] = self._write(name)
            return self._written[name]

    def _side(self, dimension: str) -> DataFrame:
        """A written dimension for a join of the load, which takes its two keys. Up to ``KEY_MAP_ROWS`` rows are
        broadcast, so that orders and lines are not shuffled once more for it."""
        rows = self.keyed(dimension)
        return F.broadcast(rows) if self._star.row_counts[dimension] <= KEY_MAP_ROWS else rows

    def _write(self, name: str) -> DataFrame:
        df = self.frame(name)
        fact = "fakta_penjualan" if name == "keyed_lines" else name
        path = f"{self._folder}/{name}-{uuid.uuid4().hex}"
        if fact not in FACT_KEYS:
            # Not compactly: Spark takes a side for small, and broadcasts it, by the size of its files.
            written = write_and_read(df, path)
        else:
            # Rows that are read from a fact as they are need not be moved into its layout again.
            df = df.sortWithinPartitions(*LAYOUT, "waktu_id") if name in LAID_OUT else laid_out_by_month(df)
            if FACT_KEYS[fact] == "id":
                df = df.withColumn("id", F.monotonically_increasing_id())
            written = write_and_read(df, path, tuple(LAYOUT), COMPACT)
        self.paths[name] = path
        return written

    def load(self) -> None:
        """Write all tables, those that do not build on each other at the same time."""
        steps = (
            tuple(DIMENSION_KEYS),
            ("keyed_orders",),
            ("keyed_lines", "fakta_pembayaran"),
            ("fakta_pengiriman", "fakta_review", "fakta_seller"),
        )
        with ThreadPoolExecutor(max(map(len, steps))) as pool:
            for tables in steps:
                list(pool.map(self.keyed, tables))

    def close(self) -> None:
        """Delete the written tables; what is asked for afterwards is built anew."""
        for path in self.paths.values():
            remove_folder(self._spark, path)
        for held in (self._written, self._published, self.paths, self._null_keys, self._colocated):
            held.clear()
        self._star = Star(self, _RowCounts(self), _Enforced(self))

    def null_keys(self, fact: str) -> dict[str, int]:
        """Rows of a written fact without a key, per dimension: one scan of its keys, made once."""
        if fact not in self._null_keys:
            counts = [F.count_if(F.col(DIMENSION_KEYS[d]).isNull()).alias(d) for d in FOREIGN_KEYS[fact]]
            self._null_keys[fact] = self.keyed(fact).agg(*counts).first().asDict()
        return self._null_keys[fact]

    def __getitem__(self, name: str) -> DataFrame:
        if name not in STAR_SCHEMAS:
            raise KeyError(name)
        if name not in self._published:
            columns = STAR_SCHEMAS[name].fieldNames() + (list(LAYOUT) if name in FACT_KEYS else [])
            self._published[name] = self.keyed(name).select(*dict.fromkeys(columns))
        return self._published[name]

    def __iter__(self) -> Iterator[str]:
        return iter(STAR_SCHEMAS)

    def __len__(self) -> int:
        return len(STAR_SCHEMAS)

    def star(self) -> Star:
        """The facts take their keys from the dimensions, so a key that is not NULL has its row."""
        return self._star

    def colocated(self, fact: str, dimension: str) -> Star:
        """The star with ``fact`` also laid out by the key of ``dimension``, written when first asked for."""
        with self._locking:
            lock = self._locks[f"{fact} by {dimension}"]
        with lock:
            if (fact, dimension) not in self._colocated:
                self._colocated[fact, dimension] = colocate(self._star, fact, dimension, self._folder)
            return self._colocated[fact, dimension]


class _RowCounts(Mapping[str, int]):
    """Dimension sizes, counted once each on the written table."""

    def __init__(self, tables: Mapping[str, DataFrame]):
        self._tables = tables
        self._known: dict[str, int] = {}

    def __getitem__(self, name: str) -> int:
        if name not in DIMENSION_KEYS:
            raise KeyError(name)
        if name not in self._known:
            self._known[name] = self._tables[name].count()
        return self._known[name]

    def __iter__(self) -> Iterator[str]:
        return iter(DIMENSION_KEYS)

    def __len__(self) -> int:
        return len(DIMENSION_KEYS)


class _Enforced(Mapping[str, Collection[str]]):
    """Dimensions of each fact whose key is NULL in no row."""

    def __init__(self, warehouse: Warehouse):
        self._warehouse = warehouse

    def __getitem__(self, name: str) -> Collection[str]:
        if name not in FACT_KEYS:
            raise KeyError(name)
        return [d for d, n in self._warehouse.null_keys(name).items() if not n]

    def __iter__(self) -> Iterator[str]:
        return iter(FACT_KEYS)

    def __len__(self) -> int:
        return len(FACT_KEYS)


_open: dict[tuple[str, str], Warehouse] = {}


def warehouse_for(
    spark: SparkSession, name: str, source: Callable[[], Mapping[str, DataFrame]]
) -> Warehouse:
    """The session's warehouse of the source called ``name``."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _open:
        folder = f"{shared_folder(spark)}/warehouse-{uuid.uuid4().hex}"
        _open[key] = Warehouse(spark, source(), folder)
    return _open[key]
