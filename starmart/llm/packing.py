"""Best-fit packing of documents into sequences of a fixed number of tokens.

Longer documents are cut into full pieces and a rest. How pieces are laid out
depends only on how many there are of each length, and there are no more lengths than
tokens in a sequence. So the lengths are counted over all pieces, the layout is
planned on those counts, and each piece finds its place by its rank among the
pieces of its length:

* Pieces above a third of the capacity: no three fit together. From the longest
  down, each is matched with the longest other that still fits beside it.
* Shorter pieces, from the longest down, go where the least room that suffices is
  left; new sequences are begun when nothing has room.

Null texts are empty documents: the end id alone. Rows that repeat are packed each.
A null document id is kept. An empty table gives no sequence. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starmart.llm.store import keep, prepare
from starmart.llm.tokens import encoder


class Run(NamedTuple):
    """``count`` pieces of one length from rank ``first``: ``each`` to a sequence from
    sequence ``sequence`` on, side by side from ``offset``."""

    length: int
    first: int
    count: int
    sequence: int
    each: int
    offset: int


def plan(counts: Mapping[int, int], capacity: int) -> list[Run]:
    """Lay out ``counts[length]`` pieces of each length; linear in the number of lengths."""
    left = {n: c for n, c in counts.items() if c}
    used: Counter[int] = Counter()
    runs: list[Run] = []
    sequences = 0
    rooms: list[int] = []  # sorted, without repeats
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room: (first sequence, number)

    def place(length: int, number: int, sequence: int, each: int, offset: int) -> None:
        runs.append(Run(length, used[length], number, sequence, each, offset))
        used[length] += number
        left[length] -= number

    def leave(room: int, sequence: int, number: int) -> None:
        if room and number:
            if not groups[room]:
                insort(rooms, room)
            groups[room].append((sequence, number))

    large = sorted(n for n in left if 3 * n > capacity)
    for n in reversed(large):
        while left[n]:
            others = [m for m in large[: bisect_left(large, min(capacity - n, n) + 1)] if left[m] > (m == n)]
            if not others:
                leave(capacity - n, sequences, left[n])
                sequences += left[n]
                place(n, left[n], sequences - left[n], 1, 0)
                break
            m = others[-1]
            if m == n:
                pairs = left[n] // 2
                place(n, 2 * pairs, sequences, 2, 0)
            else:
                pairs = min(left[n], left[m])
                place(n, pairs, sequences, 1, 0)
                place(m, pairs, sequences, 1, n)
            leave(capacity - n - m, sequences, pairs)
            sequences += pairs

    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect_left(rooms, n)
            if at == len(rooms):
                # As many new sequences as these pieces fill, the last perhaps in part.
                each = capacity // n
                number = -(-left[n] // each)
                leave(capacity, sequences, number)
                sequences += number
                continue
            room = rooms[at]
            first, number = groups[room].pop()
            if not groups[room]:
                rooms.pop(at)
            each = room // n
            full = min(number, left[n] // each)
            if full:
                place(n, full * each, first, each, capacity - room)
                leave(room - each * n, first, full)
            rest = left[n] if full < number else 0
            if rest:
                place(n, rest, first + full, rest, capacity - room)
                leave(room - rest * n, first + full, 1)
                full += 1
            leave(room, first + full, number - full)
    return runs


def _cut(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        end = np.array([end_id], "<u4").tobytes()
        task = TaskContext.get().partitionId()
        seen: Counter[int] = Counter()
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column("id").to_pylist(), tokens.batch(batch.column("text"))):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    n = len(part) // 4
                    rows.append((doc, piece, at // 4, n, zlib.crc32(part), task, seen[n]))
                    seen[n] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            columns = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"],
            )

    return run


def _settle(runs: list[Run]):
    runs = sorted(runs)
    table = np.array(runs, np.int64).reshape(-1, len(Run._fields))
    begin = np.searchsorted(table[:, 0], np.arange(table[:, 0].max() + 2)) if len(table) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            at = np.empty(len(n), np.int64)
            for length in np.unique(n):
                rows = n == length
                lo, hi = begin[length], begin[length + 1]
                at[rows] = lo + np.searchsorted(table[lo:hi, 1], rank[rows], "right") - 1
            own = table[at]
            nth = rank - own[:, 1]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(own[:, 3] + nth // own[:, 4]), pa.array(own[:, 5] + nth % own[:, 4] * n)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` for each piece."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    prepare(docs.sparkSession)
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    pieces = keep(
        texts.mapInArrow(
            _cut(tokenizer, end_id, capacity),
            "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long",
        ),
        "pieces",
    )
    # A length has a row for each task at most, so its window holds as many rows as tasks.
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counted = pieces.groupBy("length", "task").agg(F.count("*").alias("number"))
    bases = keep(counted.withColumn("base", F.coalesce(F.sum("number").over(before), F.lit(0))), "bases")
    # One row for each length: as many as there are tokens in a sequence, at most.
    counts = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("number").alias("n")).collect()}
    ranked = pieces.join(bases.drop("number"), ["length", "task"]).withColumn("rank", F.col("base") + F.col("nth"))
    return ranked.mapInArrow(
        _settle(plan(counts, capacity)),
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
