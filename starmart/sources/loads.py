"""Loads of a star, one beside the other, and the manifest that says which one counts.

A load writes its tables into a folder of its own and adds a row to the manifest when
all of them are there. The manifest is one small file per load, which Spark moves into place
whole, so a reader sees the load before or the new one, and a load that breaks off is never
seen. Keys given by earlier loads stay the same: each load keeps, per dimension, a map of all
business keys ever loaded. One load runs at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession

from starmart.model import DIMENSION_KEYS, FACT_KEYS, STAR_SCHEMAS, Star
from starmart.plans import build
from starmart.session import prepare_session, remove_folder
from starmart.sources.tables import read_table
from starmart.sources.warehouse import Warehouse

_MANIFEST = (
    "load long, folder string, tables map<string,string>, keys map<string,string>, "
    "row_counts map<string,long>, null_keys map<string,map<string,long>>"
)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """A row per finished load."""
    try:
        return spark.read.schema(_MANIFEST).json(f"{folder}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _MANIFEST)


def _entry(spark: SparkSession, folder: str, load: int | None = None) -> Row | None:
    rows = manifest(spark, folder)
    if load is not None:
        rows = rows.filter(rows["load"] == load)
    return rows.orderBy(rows["load"].desc()).first()


def open_star(spark: SparkSession, folder: str, load: int | None = None) -> Star:
    """The star of the last finished load, or of the one numbered ``load``."""
    entry = _entry(spark, folder, load)
    if entry is None:
        raise FileNotFoundError(f"no finished load in {folder}")
    tables = {name: read_table(spark, entry["tables"][name], name) for name in STAR_SCHEMAS}
    enforced = {
        fact: [d for d, n in entry["null_keys"][fact].items() if not n] for fact in FACT_KEYS
    }
    return Star(tables, entry["row_counts"], enforced)


def load_star(spark: SparkSession, source: Mapping[str, DataFrame], folder: str) -> Star:
    """Load the source into ``folder`` and make it the star that is opened from now on."""
    prepare_session(spark)
    before = _entry(spark, folder)
    number = before["load"] + 1 if before else 1
    known = {d: spark.read.parquet(path) for d, path in before["keys"].items()} if before else {}
    own = f"{folder}/load-{number:06d}-{uuid.uuid4().hex[:8]}"
    warehouse = Warehouse(spark, source, own, known)
    warehouse.load()
    star = warehouse.star()
    keys = {}
    for d in DIMENSION_KEYS:
        keys[d] = f"{own}/keys-{d}"
        build.key_map(d, warehouse.keyed(d), known.get(d)).write.parquet(keys[d])
    # The sales fact is the table of keyed lines.
    paths = {name: warehouse.paths["keyed_lines" if name == "fakta_penjualan" else name] for name in STAR_SCHEMAS}
    entry = (number, own, paths, keys, dict(star.row_counts.items()), {f: warehouse.null_keys(f) for f in FACT_KEYS})
    spark.createDataFrame([entry], _MANIFEST).coalesce(1).write.mode("append").json(f"{folder}/manifest")
    return open_star(spark, folder, number)


def drop_loads(spark: SparkSession, folder: str, keep: int = 2) -> list[int]:
    """Delete the tables of all but the last ``keep`` loads; gives the numbers of those deleted.

    Their rows stay in the manifest. Nothing may be reading them.
    """
    if keep < 1:
        raise ValueError("the last load has to stay")
    entries = manifest(spark, folder).orderBy("load").collect()
    gone = entries[:-keep]
    for entry in gone:
        remove_folder(spark, entry["folder"])
    return [entry["load"] for entry in gone]
