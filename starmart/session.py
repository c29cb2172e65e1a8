"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Results depend on the time zone; the adaptive settings are what keeps a hot
# key's shuffle partition from ending up in one task.
_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

_local_folders: dict[str, str] = {}

#: How the star is written: numbers as differences to the one before, so that sorted keys and row numbers take little.
COMPACT = {"compression": "zstd", "parquet.writer.version": "v2"}

_SHUFFLE_START = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def prepare_session(spark: SparkSession) -> SparkSession:
    for key, value in _SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    context = spark.sparkContext
    if not context.master.startswith("local") and spark.conf.get(_SHUFFLE_START, None) is None:
        # Start fine and let adaptive execution merge: the default of a few hundred
        # partitions would each outgrow an executor's memory on a large fact.
        start = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * context.defaultParallelism)
        spark.conf.set(_SHUFFLE_START, str(start))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor can read, as named by ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it then gets a temporary
    folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if configured:
        return f"{configured.rstrip('/')}/starmart/{context.applicationId}"
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = context.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="starmart-")
    return _local_folders[app]


def laid_out_by_month(fact: DataFrame) -> DataFrame:
    """Rows of a fact by year and month, and by date within them.

    Rebalancing splits a month that holds much of the data and keeps the files of the
    others from becoming small.
    """
    return fact.hint("rebalance", "tahun", "bulan").sortWithinPartitions("tahun", "bulan", "waktu_id")


def write_and_read(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), options: Mapping[str, str] | None = None
) -> DataFrame:
    """Write ``df`` as Parquet and return a scan of it, with its lineage cut."""
    schema = StructType(df.schema.fields)
    writer = df.write.mode("overwrite").options(**(options or {}))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the file system that its name belongs to."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def scratch_table(df: DataFrame, name: str, options: Mapping[str, str] | None = None) -> DataFrame:
    folder = shared_folder(df.sparkSession)
    return write_and_read(df, f"{folder}/scratch/{name}-{uuid.uuid4().hex}", options=options)
