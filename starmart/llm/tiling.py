"""Benchmark decontamination by greedy string tiling.

Items and documents meet through seeds, the hashes of their runs of ``least`` words. The seeds of the
items are a written table; a bitmap of fixed size says which hash ranges hold one, and only seeds of
documents in these are sent. Where they meet the items', the pair is a candidate, unless the item's words under
shared seeds are too few. Candidates are tiled: the longest
common run of words not yet covered is marked on both sides, again and again, down to
runs of ``least`` words. Runs of a length are found by rolling Karp-Rabin hashes, and verified word by word.
Tiles may lie in any order in the document, so a passage whose parts were moved is still found.
A document is contaminated by an item when tiles cover at least ``coverage`` of the
item's words.

Items or documents without words, null or empty, match nothing; an item shorter than
``least`` words must be found whole. Rows that repeat are judged each; item ids that repeat are items of their own.
Documents with a null id are judged and come out with a null id. Documents and items of any length are taken whole. Of equally
long tiles the first in the item goes first. Without documents or items there are no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starmart.llm.store import keep, partitions, prepare, with_row_numbers
from starmart.llm.words import mix, words

_U = np.uint64
_BASE = _U(0x2545F4914F6CDD1D)
#: Ranges of seed hashes that the bitmap tells apart (8 MB), and those of a slice of it.
MAP_BITS = 26
SLICE = 1 << 16


def _rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of n, each from the one before."""
    power = np.full(len(h) + 1, _BASE, _U)
    power[0] = 1
    power = np.multiply.accumulate(power)
    # Sums of h[i] * base**i; two of them give any run's hash, up to base**start.
    sums = np.append(_U(0), np.cumsum(h * power[:-1]))
    lead = power[::-1][: len(h) - n + 1]
    return (sums[n:] - sums[: len(sums) - n]) * lead


def _free(marked: np.ndarray, n: int) -> np.ndarray:
    """Starts of runs of n that nothing is marked in."""
    taken = np.append(0, np.cumsum(marked))
    return np.flatnonzero(taken[n:] == taken[:-n]) if len(marked) >= n else np.zeros(0, int)


def _longest(marked: np.ndarray) -> int:
    """Longest run that nothing is marked in."""
    cuts = np.flatnonzero(np.concatenate([[True], marked, [True]]))
    return int(np.diff(cuts).max()) - 1


def _near_seeds(item: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of ``doc`` that lie in runs of ``least`` words which the item has too, and their places.

    Every tile lies within such words. A gap is filled by one word that no side has.
    """
    hashes = _windows(doc, least)
    starts = np.flatnonzero(np.isin(hashes, _windows(item, least)))
    if not len(starts):
        return doc[:0], starts
    inside = np.zeros(len(doc) + 1, np.int64)
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + least, -1)
    places = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    # Runs that touch without a window across them need no gap: longer runs are verified word by word.
    gaps = np.flatnonzero(np.diff(places) > 1) + 1
    strange = _U(1)
    known = set(item.tolist())
    while int(strange) in known:
        strange += _U(1)
    return np.insert(doc[places], gaps, strange), np.insert(places, gaps, -1)


def tile(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles ``(start in item, start in doc, words)``, longest first.

    Among equally long ones the first in the item, then in the document, is taken. Only words
    near shared seeds are looked at, and sizes that no unmarked run has are skipped.
    """
    least = min(least, len(item))
    if not least or len(doc) < least:
        return []
    doc, place = _near_seeds(item, doc, least)
    if not len(doc):
        return []
    in_item, in_doc = np.zeros(len(item), bool), place < 0
    tiles = []
    # Hashes of both sides at once, so that equal runs have equal hashes.
    both = np.concatenate([item, doc])
    size = min(_longest(in_item), _longest(in_doc))
    while size >= least:
        hashes = _rolling(both, size)
        starts = _free(in_item, size)
        places = _free(in_doc, size)
        item_hash, doc_hash = hashes[starts], hashes[places + len(item)]
        shared = np.isin(doc_hash, item_hash)
        if shared.any():
            order = np.argsort(item_hash, kind="stable")
            found = []
            for at_doc, h in zip(places[shared], doc_hash[shared]):
                at = np.searchsorted(item_hash[order], h)
                while at < len(order) and item_hash[order[at]] == h:
                    found.append((int(starts[order[at]]), int(at_doc)))
                    at += 1
            for i, j in sorted(found):
                if in_item[i : i + size].any() or in_doc[j : j + size].any():
                    continue
                if np.array_equal(item[i : i + size], doc[j : j + size]):
                    in_item[i : i + size] = in_doc[j : j + size] = True
                    tiles.append((i, int(place[j]), size))
        size = min(size - 1, _longest(in_item), _longest(in_doc))
    return tiles


def _windows(h: np.ndarray, n: int) -> np.ndarray:
    return mix(_rolling(h, n) * _power(len(h) - n)) if len(h) >= n else np.zeros(0, _U)


def _power(n: int) -> np.uint64:
    """Undo the factor that depends on the length of the whole array."""
    return _U(pow(pow(int(_BASE), -1, 1 << 64), n, 1 << 64))


def _seeds_of_items(least: int):
    """Distinct seeds of each item, of its own length if that is less, with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = words(batch.column("text"))
            rows = []
            for i, item in enumerate(batch.column("item").to_pylist()):
                own = found.of(i)
                n = min(least, len(own))
                if not n:
                    continue
                seeds, of = np.unique(_windows(own, n), return_inverse=True)
                order = np.argsort(of, kind="stable")
                cuts = np.append(np.flatnonzero(np.append(True, np.diff(of[order]) > 0)), len(order))
                rows += [
                    (item, len(own), n, int(seed), order[a:b].tolist()) for seed, a, b in zip(seeds.view(np.int64), cuts, cuts[1:])
                ]
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["item", "words", "n", "seed", "places"]
            )

    return run


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of the bitmap of seeds; rows of a slice come together."""
    slices: dict[int, np.ndarray] = {}
    for batch in batches:
        place = batch.column("place").to_numpy()
        for at in np.unique(place // SLICE):
            bits = slices.setdefault(int(at), np.zeros(SLICE, bool))
            bits[place[place // SLICE == at] % SLICE] = True
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(slices), pa.int32()), pa.array([np.packbits(b).tobytes() for b in slices.values()], pa.binary())],
        names=["slice", "bits"],
    )


def seed_map(seeds: DataFrame) -> np.ndarray:
    """A bit for each of ``MAP_BITS`` hash ranges that holds a seed: the same size for any benchmark."""
    place = F.shiftrightunsigned("seed", 64 - MAP_BITS).alias("place")
    slices = (
        seeds.select(place).distinct()
        .repartition(partitions(seeds.sparkSession), F.floor(F.col("place") / SLICE))
        .mapInArrow(_bits, "slice int, bits binary")
    )
    out = np.zeros(1 << MAP_BITS - 3, np.uint8)
    for row in slices.collect():
        out[row["slice"] * SLICE // 8 : (row["slice"] + 1) * SLICE // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def _seeds_of_docs(present: np.ndarray, sizes: list[int]):
    """Distinct seeds of each document that the bitmap holds."""
    shift = _U(64 - MAP_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = words(batch.column("text"))
            rows = batch.column("row").to_numpy()
            out = []
            for n in sizes:
                hashes = _windows(found.hashes, n)
                place = (hashes >> shift).astype(np.int64)
                hit = np.flatnonzero(present[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1)
                doc = np.searchsorted(found.first, hit, "right") - 1
                inside = hit + n <= found.first[doc + 1]
                pairs = np.unique(np.stack([doc[inside], hashes[hit[inside]].view(np.int64)]), axis=1)
                out.append((rows[pairs[0]], np.full(pairs.shape[1], n, np.int32), pairs[1]))
            columns = [np.concatenate(c) for c in zip(*out)]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["row", "n", "seed"])

    return run


def _tiled(least: int, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, items = words(batch.column("text")), words(batch.column("item_text"))
            rows = []
            for i, (doc, item) in enumerate(zip(batch.column("id").to_pylist(), batch.column("item_id").to_pylist())):
                own = items.of(i)
                tiles = tile(own, docs.of(i), least)
                covered = sum(t[2] for t in tiles)
                if covered >= coverage * len(own):
                    rows.append((doc, item, covered, len(own), len(tiles)))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["doc_id", "item_id", "covered", "item_words", "tiles"],
            )

    return run


def candidate_pairs(texts: DataFrame, items: DataFrame, least: int, coverage: float) -> DataFrame:
    """``(row, item)`` of ``texts(row, text)`` and ``items(item, text)`` that may share enough.

    Tiles are made of shared seeds, so a pair is left out exactly if the item's words under
    shared seeds are fewer than the coverage asks for.
    """
    seeds = keep(
        items.mapInArrow(_seeds_of_items(least), "item long, words int, n int, seed long, places array<int>"), "seeds"
    )
    # At most ``least`` different sizes.
    sizes = sorted(r["n"] for r in seeds.select("n").distinct().collect())
    if not sizes:
        return texts.sparkSession.createDataFrame([], "row long, item long")
    hits = keep(texts.mapInArrow(_seeds_of_docs(seed_map(seeds), sizes), "row long, n int, seed long"), "hits")
    under = F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.col("n") - 1)))
    shared = hits.join(seeds, ["n", "seed"]).select("row", "item", "words", F.explode(under).alias("word")).distinct()
    return shared.groupBy("row", "item", "words").agg(F.count("*").alias("under")).filter(
        F.col("under") >= F.lit(coverage) * F.col("words")
    ).select("row", "item")


def contaminated(
    docs: DataFrame, items: DataFrame, least: int = 4, coverage: float = 0.5,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """``(doc_id, item_id, covered, item_words, tiles, coverage)`` for each document and
    item that it contains. ``items`` holds ``item_id`` and ``text``."""
    if least < 1 or not 0 < coverage <= 1:
        raise ValueError("least must be positive and coverage in (0, 1]")
    spark = prepare(docs.sparkSession)
    name = "_row"
    while name in docs.columns:
        name += "_"
    texts = with_row_numbers(docs, name).select(
        F.col(name).alias("row"), F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")
    )
    own = keep(
        items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("item", F.monotonically_increasing_id()),
        "items",
    )
    pairs = keep(candidate_pairs(texts.select("row", "text"), own.select("item", "text"), least, coverage), "candidates")
    both = pairs.join(texts, "row").join(own.withColumnRenamed("text", "item_text"), "item")
    found = both.select("id", "text", "item_id", "item_text").repartition(4 * partitions(spark)).mapInArrow(
        _tiled(least, coverage), "doc_id long, item_id long, covered int, item_words int, tiles int"
    )
    return found.withColumn("coverage", F.col("covered") / F.col("item_words"))
