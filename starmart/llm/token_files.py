"""Token ids of a corpus in flat binary files, with 64-bit document offsets.

A folder holds for each part p, in ascending order of document id:

* ``p.ids``: the ids of its documents one after another, unsigned 16- or 32-bit little-endian;
* ``p.off``: where each document begins, counted in ids over the whole corpus, and
  where the last ends, as signed 64-bit integers;
* ``p.doc``: the document ids, as signed 64-bit integers.

Documents are sorted over all tasks by id, hash of the text and row number, so rows that share an id, or have none,
are dealt out like any others. A task encodes its documents in this order and begins a new part after ``PART_BYTES`` of text;
a part's number is that of its task and its place there. A part's base is the number of ids in all parts before it, a prefix
sum over the table of parts. Files are written under another name and then renamed, so a task that
runs twice leaves one whole file; the order of the ids does not depend on the run.

Null or empty texts consist of the end id alone. A null document id counts as lower
than all others and is stored as the lowest 64-bit integer. Rows that repeat are all
kept. Texts of any length are encoded whole, a text at a time. An empty table gives no part. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starmart.llm.store import keep, partitions, prepare, with_row_numbers
from starmart.llm.tokens import encoder

#: Most UTF-8 bytes of text in one part, unless a single text has more.
PART_BYTES = 32 << 20
#: A part's number holds its place in its task in as many bits.
_PART_BITS = 32
NO_ID = -(1 << 63)
_ROWS = 4096


def _store(folder: str) -> tuple[FileSystem, str]:
    """The folder's file system, as tasks reach it: local or mounted, HDFS or an object store."""
    return FileSystem.from_uri(folder)


def _write(fs: FileSystem, path: str, pieces: Iterator[bytes]) -> None:
    temporary = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(temporary) as out:
        for piece in pieces:
            out.write(piece)
    fs.move(temporary, path)


def _view(fs: FileSystem, path: str, kind: str) -> np.ndarray:
    """A file as an array: mapped into memory if it is local, else read."""
    if isinstance(fs, LocalFileSystem):
        if fs.get_file_info(path).size == 0:
            return np.zeros(0, kind)
        return np.memmap(path, kind, "r")
    with fs.open_input_file(path) as file:
        return np.frombuffer(file.readall(), kind)


def _save(folder: str, path: str, end_id: int, width: str, part_bytes: int):
    size = np.dtype(width).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _store(folder)
        fs.create_dir(root, recursive=True)
        tokens = encoder(path)
        end = np.array([end_id], width).tobytes()
        part = TaskContext.get().partitionId() << _PART_BITS
        out, docs, lengths, read = None, [], [], 0

        def close() -> pa.RecordBatch:
            out.close()
            fs.move(temporary, f"{root}/{part}.ids")
            _write(fs, f"{root}/{part}.doc", [np.array(docs, "<i8").tobytes()])
            _write(fs, f"{root}/{part}.len", [np.array(lengths, "<i8").tobytes()])
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([len(docs)], pa.int64()), pa.array([sum(lengths)], pa.int64())],
                names=["part", "docs", "tokens"],
            )

        for batch in batches:
            texts = batch.column("text")
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            for doc, n, found in zip(batch.column("id").to_pylist(), sizes, tokens.batch(texts)):
                if out and read + n > part_bytes:
                    yield close()
                    part, out, docs, lengths, read = part + 1, None, [], [], 0
                if not out:
                    temporary = f"{root}/{part}.ids.{uuid.uuid4().hex}"
                    out = fs.open_output_stream(temporary)
                ids = np.frombuffer(found, "<u4").astype(width).tobytes() + end
                out.write(ids)
                docs.append(doc)
                lengths.append(len(ids) // size)
                read += n
        if out:
            yield close()

    return run


def _offsets(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _store(folder)
        for batch in batches:
            for part, base in zip(batch.column("part").to_pylist(), batch.column("base").to_pylist()):
                lengths = _view(fs, f"{root}/{part}.len", "<i8")
                places = base + np.append(0, np.cumsum(lengths))
                _write(fs, f"{root}/{part}.off", [places.astype("<i8").tobytes()])
            yield batch

    return run


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, vocabulary: int = 1 << 16,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Write ``docs`` to ``folder``; the table of parts ``(part, docs, tokens, base)``."""
    spark = prepare(docs.sparkSession)
    width = "<u2" if vocabulary <= 1 << 16 else "<u4"
    texts = docs.select(
        F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_column).alias("text")
    )
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(4 * partitions(spark), total // PART_BYTES)
    order = ["id", "hash", "row"]
    written = (
        with_row_numbers(texts, "row")
        .withColumn("hash", F.xxhash64("text"))
        .repartitionByRange(tasks, *order)
        .sortWithinPartitions(*order)
        .select("id", "text")
        .mapInArrow(_save(folder, tokenizer, end_id, width, PART_BYTES), "part long, docs long, tokens long")
    )
    written = keep(written, "parts")
    # One row for each part: the window is as small as the list of files.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = written.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    done = based.repartition(partitions(spark), "part").mapInArrow(
        _offsets(folder), "part long, docs long, tokens long, base long"
    )
    return keep(done, "based")


def _read(folder: str, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _store(folder)
        for batch in batches:
            for part in batch.column("part").to_pylist():
                ids = _view(fs, f"{root}/{part}.ids", width)
                places = _view(fs, f"{root}/{part}.off", "<i8")
                docs = _view(fs, f"{root}/{part}.doc", "<i8")
                base = int(places[0])
                for at in range(0, len(docs), _ROWS):
                    to = min(at + _ROWS, len(docs))
                    own = np.array(docs[at:to])
                    start = np.array(places[at : to + 1])
                    sums = [
                        zlib.crc32(ids[i - base : j - base].astype("<u4")) for i, j in zip(start, start[1:])
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(own, mask=own == NO_ID),
                            pa.array(start[:-1]),
                            pa.array(np.diff(start)),
                            pa.array(sums, pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return run


def read_tokens(parts: DataFrame, folder: str, vocabulary: int = 1 << 16) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` for each document, from the files."""
    spark = prepare(parts.sparkSession)
    width = "<u2" if vocabulary <= 1 << 16 else "<u4"
    return (
        parts.select("part")
        .repartition(partitions(spark), "part")
        .mapInArrow(_read(folder, width), "doc_id long, start long, n_tokens long, ids_crc32 long")
    )


def document_ids(folder: str, part: int, place: int, vocabulary: int = 1 << 16) -> np.ndarray:
    """The ids of one document of one part, mapped from the file."""
    fs, root = _store(folder)
    ids = _view(fs, f"{root}/{part}.ids", "<u2" if vocabulary <= 1 << 16 else "<u4")
    places = _view(fs, f"{root}/{part}.off", "<i8")
    return ids[places[place] - places[0] : places[place + 1] - places[0]]
