"""Exact top-k search by block-at-a-time pruning.

Vectors are sparse rows of terms and integer weights. Candidates are laid out in a fixed order and cut
into blocks of ``BLOCK`` rows; up to ``GROUP`` rows of blocks travel as one unit, fewer where rows times distinct terms would
exceed ``CELLS``. A block has a forward
index (terms and weights of each row) and, for each term, the largest and the smallest weight.
Summed over a query's terms, these bound the score of all rows of the block. A query takes the blocks by falling bound, scores them
through their forward index, and stops at the first whose bound is below the k-th
score so far; blocks that only reach it may hold a smaller id and are still scored.

First each query is scored in the group with its highest bound. Its k-th score there then
decides which other groups it must see at all. Queries travel in packs, and group bounds
in sheets of limited bytes, so each is a join on a number and nothing is broadcast. A group is sent only those queries of a pack
that are to see it.

A row's own id is no candidate of its query. Rows that repeat are candidates each, as far as their ids
are those of other rows; queries with the same id and vector are answered once. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starmart.llm.store import keep, partitions, prepare

BLOCK = 32
GROUP = 1024
PACK = 1024
#: Rows times distinct terms of a unit, unless it is a single row.
CELLS = 1 << 22
#: Groups of a sheet, and bytes of their extremes, about.
SHEET, SHEET_BYTES = 4096, 32 << 20
_COLUMNS = ("ids", "first", "terms", "weights")
_GROUP = "grp long, ids binary, first binary, terms binary, weights binary"


def _rows(batches: Iterator[pa.RecordBatch], most: int, cells: int):
    """Rows of all batches as ids, terms and weights: at most so many at a time, and so many rows times distinct terms."""
    ids, terms, weights, known = [], [], [], set()
    for batch in batches:
        t, w = batch.column("terms"), batch.column("weights")
        for i, x, y in zip(batch.column("id").to_pylist(), t, w):
            own = x.values.to_numpy(zero_copy_only=False)
            if ids:
                more = known.union(own.tolist())
                if len(ids) == most or (len(ids) + 1) * len(more) > cells:
                    yield ids, terms, weights
                    ids, terms, weights, more = [], [], [], set(own.tolist())
                known = more
            else:
                known = set(own.tolist())
            ids.append(i)
            terms.append(own)
            weights.append(y.values.to_numpy(zero_copy_only=False))
    if ids:
        yield ids, terms, weights


def _bundle(most: int, cells: int):
    """Rows of one task in units, numbered over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for n, (ids, terms, weights) in enumerate(_rows(batches, most, cells)):
            first = np.append(0, np.cumsum([len(x) for x in terms]))
            blobs = (
                np.array(ids, "<i8").tobytes(), first.astype("<i8").tobytes(),
                np.concatenate(terms).astype("<i8").tobytes(), np.concatenate(weights).astype("<i8").tobytes(),
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array([(task << 32) + n]), *(pa.array([b], pa.binary()) for b in blobs)],
                names=["grp", "ids", "first", "terms", "weights"],
            )

    return run


class _Unit:
    """Rows of a group or of a pack of queries."""

    def __init__(self, ids: bytes, first: bytes, terms: bytes, weights: bytes):
        self.ids, self.first = np.frombuffer(ids, "<i8"), np.frombuffer(first, "<i8")
        self.terms, self.weights = np.frombuffer(terms, "<i8"), np.frombuffer(weights, "<i8")

    def table(self, lo: int, hi: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The terms of rows lo..hi, and their weights by row and term; sums are whole
        numbers below 2**53, so doubles hold them exactly."""
        a, b = self.first[lo], self.first[hi]
        terms = self.terms[a:b]
        own = np.unique(terms) if own is None else own
        at = np.searchsorted(own, terms)
        row = np.repeat(np.arange(hi - lo), np.diff(self.first[lo : hi + 1]))
        here = np.append(own, -1)[at] == terms
        out = np.zeros((hi - lo, len(own)))
        out[row[here], at[here]] = self.weights[a:b][here]
        return own, out

    def only(self, rows: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
        """Some rows, as the columns of a unit of their own."""
        sizes = self.first[rows + 1] - self.first[rows]
        first = np.append(0, np.cumsum(sizes))
        at = np.arange(first[-1]) + np.repeat(self.first[rows] - first[:-1], sizes)
        return self.ids[rows].tobytes(), first.tobytes(), self.terms[at].tobytes(), self.weights[at].tobytes()


def _extremes(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return table.max(0, initial=0), table.min(0, initial=0)


def _bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """No row's score is above this. A row without the term has weight 0, which counts."""
    return np.maximum(queries, 0) @ high + np.minimum(queries, 0) @ low


def _sheet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Extremes of each group."""
    for batch in batches:
        for row in batch.to_pylist():
            unit = _Unit(row["ids"], row["first"], row["terms"], row["weights"])
            own, table = unit.table(0, len(unit.ids))
            high, low = _extremes(table)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["grp"]]), *(pa.array([x.tobytes()], pa.binary()) for x in (own, high, low))],
                names=["grp", "own", "high", "low"],
            )


def _route(first_only: bool):
    """For a pack and a sheet of groups: which queries go where.

    Rows carry one pack and one sheet each. At first each query goes to its best group of the sheet.
    Later it goes to every group whose bound reaches its k-th score.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pack = _Unit(row["ids"], row["first"], row["terms"], row["weights"])
                own, queries = pack.table(0, len(pack.ids))
                groups = row["groups"]
                bounds = np.empty((len(pack.ids), len(groups)))
                for g, group in enumerate(groups):
                    terms = np.frombuffer(group["own"], "<i8")
                    at = np.minimum(np.searchsorted(own, terms), len(own) - 1) if len(own) else terms[:0]
                    here = own[at] == terms if len(own) else np.zeros(len(terms), bool)
                    high, low = np.frombuffer(group["high"]), np.frombuffer(group["low"])
                    bounds[:, g] = _bounds(queries[:, at[here]], high[here], low[here])
                if first_only:
                    best = bounds.argmax(1)
                    sent = [(np.flatnonzero(best == g), None) for g in range(len(groups))]
                else:
                    least = np.frombuffer(row["least"], "<f8")
                    seen = np.frombuffer(row["seen"], "<i8")
                    sent = [
                        (np.flatnonzero((bounds[:, g] >= least) & (seen != group["grp"])), least)
                        for g, group in enumerate(groups)
                    ]
                for group, (q, least) in zip(groups, sent):
                    if len(q):
                        reach = np.full(len(q), -np.inf) if least is None else least[q]
                        blobs = (q.astype("<i8").tobytes(), reach.tobytes(), *pack.only(q))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([group["grp"]]), pa.array([row["grp"]]), *(pa.array([b], pa.binary()) for b in blobs)],
                            names=["grp", "pack", "rows", "least", *(f"q_{c}" for c in _COLUMNS)],
                        )

    return run


def search(pack: _Unit, least: np.ndarray, group: _Unit, k: int):
    """The best k of a group for the queries of a pack: ``(query row, id, score)``.

    ``least`` holds scores that a candidate must reach.
    """
    own, rows = pack.ids, len(pack.ids)
    terms, queries = pack.table(0, rows, np.intersect1d(pack.terms, group.terms))
    starts = range(0, len(group.ids), BLOCK)
    _, whole = group.table(0, len(group.ids), terms)
    blocks, bounds = [], np.empty((rows, len(starts)))
    for b, lo in enumerate(starts):
        table = whole[lo : lo + BLOCK]
        blocks.append((group.ids[lo : lo + BLOCK], table))
        bounds[:, b] = _bounds(queries, *_extremes(table))
    order = np.argsort(-bounds, 1, kind="stable")
    score = np.full((rows, k), -np.inf)
    ids = np.full((rows, k), np.iinfo(np.int64).max)
    active = np.arange(rows)
    for step in range(len(starts)):
        block = order[active, step]
        going = bounds[active, block] >= np.maximum(score[active, -1], least[active])
        active, block = active[going], block[going]
        if not len(active):
            break
        for b in np.unique(block):
            q = active[block == b]
            candidates, table = blocks[b]
            new = queries[q] @ table.T
            new[candidates[None, :] == own[q][:, None]] = -np.inf
            # Only a score that reaches the k-th, or the least asked for, can change a query's best.
            best = new.max(1, initial=-np.inf)
            some = (best >= score[q, -1]) & (best >= least[q]) & (best > -np.inf)
            q, new = q[some], new[some]
            if not len(q):
                continue
            every = np.concatenate([score[q], new], 1)
            named = np.concatenate([ids[q], np.broadcast_to(candidates, new.shape)], 1)
            named = np.where(np.isneginf(every), np.iinfo(np.int64).max, named)
            top = np.lexsort((named, -every), axis=1)[:, :k]
            score[q], ids[q] = np.take_along_axis(every, top, 1), np.take_along_axis(named, top, 1)
    row, place = np.nonzero(~np.isneginf(score))
    return row, ids[row, place], score[row, place]


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                pack = _Unit(*(x[f"q_{c}"] for c in _COLUMNS))
                group = _Unit(*(x[c] for c in _COLUMNS))
                row, ids, score = search(pack, np.frombuffer(x["least"], "<f8"), group, k)
                n = len(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, x["pack"])), pa.array(np.frombuffer(x["rows"], "<i8")[row]), pa.array(pack.ids[row]),
                        pa.array(np.full(n, x["grp"])), pa.array(ids), pa.array(score.astype(np.int64)),
                    ],
                    names=["pack", "row", "query_id", "grp", "id", "score"],
                )

    return run


def _least(k: int):
    """For each pack the k-th score so far of each query, and the group it came from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                n = len(x["ids"]) // 8
                least, seen = np.full(n, -np.inf), np.full(n, -1, np.int64)
                for r in x["known"] or []:
                    least[r["row"]] = r["kth"] if r["n"] >= k else -np.inf
                    seen[r["row"]] = r["grp"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x["grp"]]), *(pa.array([x[c]], pa.binary()) for c in _COLUMNS),
                     pa.array([least.tobytes()], pa.binary()), pa.array([seen.tobytes()], pa.binary())],
                    names=["grp", "ids", "first", "terms", "weights", "least", "seen"],
                )

    return run


def top_k(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(query_id, rank, id, score)`` of the best k of ``rows`` for each of ``queries``.

    Both hold ``id long, terms array<long>, weights array<long>`` without nulls; a term stands
    once in a row, and absolute scores stay below 2**53. Null ids take no part.
    """
    if k < 1:
        raise ValueError("k must be positive")
    spark = prepare(rows.sparkSession)
    tasks = partitions(spark)
    groups = keep(rows.filter("id is not null").mapInArrow(_bundle(GROUP, CELLS), _GROUP), "groups")
    asked = queries.filter("id is not null").dropDuplicates(["id", "terms", "weights"])
    packs = keep(asked.mapInArrow(_bundle(PACK, CELLS), _GROUP), "packs")

    extremes = keep(groups.mapInArrow(_sheet, "grp long, own binary, high binary, low binary"), "extremes")
    number, size = extremes.agg(F.count("*"), F.coalesce(F.sum(3 * F.length("own")), F.lit(0))).first()
    sheets = max(1, -(-number // SHEET), -(-size // SHEET_BYTES))
    sheet = F.pmod(F.xxhash64("grp"), F.lit(sheets)).cast("int").alias("sheet")
    table = keep(
        extremes.groupBy(sheet).agg(F.collect_list(F.struct("grp", "own", "high", "low")).alias("groups")), "sheets"
    )
    every = F.explode(F.sequence(F.lit(0), F.lit(sheets - 1))).alias("sheet")
    routed = "grp long, pack long, rows binary, least binary, " + ", ".join(f"q_{c} binary" for c in _COLUMNS)
    meet = lambda p: p.select("*", every).join(table, "sheet").drop("sheet")

    found = "pack long, row long, query_id long, grp long, id long, score long"

    def searched(routes: DataFrame) -> DataFrame:
        return routes.join(groups, "grp").repartition(4 * tasks, "grp", "pack").mapInArrow(_search(k), found)

    seed = keep(searched(keep(meet(packs).mapInArrow(_route(True), routed), "routes")), "seeds")
    # Of several sheets, the group with the highest k-th score serves; the others are
    # searched again if their bounds ask for it.
    chosen = keep(
        seed.groupBy("pack", "row", "grp")
        .agg(F.min("score").alias("kth"), F.count("*").alias("n"))
        .groupBy("pack", "row")
        .agg(F.max_by(F.struct("grp", "kth", "n"), F.struct("n", "kth", "grp")).alias("b"))
        .select("pack", "row", "b.*"),
        "chosen",
    )
    known = chosen.groupBy("pack").agg(F.collect_list(F.struct("row", "grp", "kth", "n")).alias("known"))
    ready = packs.join(known, packs["grp"] == known["pack"], "left").mapInArrow(
        _least(k), f"{_GROUP}, least binary, seen binary"
    )
    rest = searched(keep(meet(keep(ready, "ready")).mapInArrow(_route(False), routed), "routes"))
    both = seed.join(chosen.select("pack", "row", "grp"), ["pack", "row", "grp"], "left_semi").unionByName(rest)
    best = Window.partitionBy("pack", "row").orderBy(F.desc("score"), "id")
    return (
        both.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "id", "score")
    )
