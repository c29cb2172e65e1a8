"""Session settings, scratch tables and shared files of the operators."""

from __future__ import annotations

import io
import uuid
import zipfile
import zlib
from pathlib import Path
from threading import Lock

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starmart.session import prepare_session, scratch_table, shared_folder

#: Rows that cross to Python at a time, so that long texts stay within a worker's memory.
BATCH_ROWS = "256"


_shipping = Lock()
_shipped: set[str] = set()


def _package() -> bytes:
    """This package's modules as an archive that Python can import from; the same bytes each time."""
    top = Path(__file__).resolve().parent.parent
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(top.rglob("*.py")):
            archive.writestr(zipfile.ZipInfo(file.relative_to(top.parent).as_posix()), file.read_bytes())
    return out.getvalue()


def ship_package(spark: SparkSession) -> None:
    """Once per application, give the workers this package, wherever the driver found it.

    The archive lies in the shared folder, from which executors that join later fetch it too.
    """
    context = spark.sparkContext
    with _shipping:
        if context.applicationId in _shipped:
            return
        if Path(__file__).is_file():
            archive = _package()
            path = f"{shared_folder(spark)}/code/starmart-{zlib.crc32(archive):08x}.zip"
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            out = where.getFileSystem(context._jsc.hadoopConfiguration()).create(where, True)
            try:
                out.write(archive)
            finally:
                out.close()
            context.addPyFile(path)
        _shipped.add(context.applicationId)


def prepare(spark: SparkSession) -> SparkSession:
    prepare_session(spark)
    ship_package(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return prepare(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it from there from now on."""
    return scratch_table(df, f"llm-{name}")


#: Most files that rows are numbered by, and rows of a file.
FILES, FILE_BITS = 100_000, 36


def with_row_numbers(docs: DataFrame, column: str) -> DataFrame:
    """``docs`` with a number for each row that stays the same whenever the rows are read.

    Rows that come straight from files are numbered by their file and their place in it, without
    a copy; the names of files, at most ``FILES``, are what is broadcast. Other rows are numbered and written.
    """
    if column in docs.columns:
        raise ValueError(f"the rows have a column {column} already")
    try:
        place = docs.metadataColumn("_metadata")
        names = docs.select(place["file_path"].alias("file")).distinct()
        files = keep(names.withColumn("number", F.row_number().over(Window.orderBy("file")).cast("long")), "files")
    except AnalysisException:
        files = None
    if files is None or files.count() > FILES:
        return keep(docs.withColumn(column, F.monotonically_increasing_id()), "rows")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), place["file_path"].alias("file"), place["row_index"].alias("at"))
    number = F.shiftleft("number", FILE_BITS) + F.col("at")
    return rows.join(F.broadcast(files), "file").select("row.*", number.alias(column))


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"


def partitions(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
