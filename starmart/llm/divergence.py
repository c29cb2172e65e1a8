"""Source divergence audit: how far the term counts of the sources of a language lie apart.

Terms are runs of letters and of bytes beyond ASCII, ``A-Z`` as ``a-z``. A language keeps
the V terms that at least ``least`` of its documents hold. A group (language, source) of N kept
occurrences gives a kept term that it holds ``count`` times
``p = 1 + floor(10**9 * (count + 2) / (N + 2 V))``; the price of p against q is
``floor((p - q)**2 / (p + q))``. All arithmetic is of whole numbers.

Kept terms are dealt over blocks by their hash, and get a place in their block, common ones
first. A group's counts in a block form a segment tree. Trees are
hash-consed: level by level, equal pairs of children become one node, whichever place or
group they belong to, so all absent or equally rare stretches share nodes. Two groups are compared by
walking both trees together from the root: equal pairs of nodes on a level become
one pair with a count, so each is priced once. Sums over blocks give the price of a pair of sources.
A language with many sources is cut into tiles of ``TILE`` sources, a unit of work being a
block and two tiles.

Null text, language or source count as empty strings. Groups whose documents hold no
kept term, or no text at all, come out too. A language of one source has no pairs; without kept terms
every pair has the value 0. Equal values are ranked by the item's UTF-8 bytes. Rows are
documents, so rows that repeat count again, and ids are not read. Long texts are cut between
terms while they are counted. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starmart.llm.store import keep, partitions, prepare

#: Kept terms of a block on average, and places that a tree has at least room for.
BLOCK = 3500
#: Sources of a tile, and pairs of them that are walked at a time.
TILE = 32
PAIRS = 128
#: Distinct terms that a task holds before it sends them on, bytes of text that are cut at a time.
HELD = 400_000
PIECE = 1 << 20

SCALE = 1_000_000_000


def _term_table() -> bytes:
    """Each byte as it counts in a term, or a blank."""
    table = bytearray(b" " * 256)
    for byte in (*range(0x41, 0x5B), *range(0x61, 0x7B)):
        table[byte] = byte | 0x20
    table[0x80:] = range(0x80, 0x100)
    return bytes(table)


_TERMS = _term_table()


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text, some at a time."""
    at = 0
    while at < len(text):
        piece = text[at : at + PIECE].translate(_TERMS)
        if at + PIECE < len(text):
            # Go on to the end of the last term.
            to = at + len(piece)
            while to < len(text) and text[to : to + 4096].translate(_TERMS).find(b" ") < 0:
                to += 4096
            to = min(to + max(text[to : to + 4096].translate(_TERMS).find(b" "), 0), len(text))
            piece = text[at:to].translate(_TERMS)
        at += len(piece)
        yield piece.split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents per group and term, summed as far as memory goes."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def send() -> Iterator[pa.RecordBatch]:
        for (lang, source), (times, docs) in held.items():
            words = list(times)
            for i in range(0, len(words), 50_000):
                part = words[i : i + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()),
                        pa.array(part, pa.binary()).cast(pa.string()),
                        pa.array([times[w] for w in part], pa.int64()), pa.array([docs[w] for w in part], pa.int64()),
                    ],
                    names=["lang", "source", "term", "n", "docs"],
                )

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
            times, docs = held.setdefault((lang, source), (Counter(), Counter()))
            before = len(times)
            seen: set[bytes] = set()
            for words in terms_of(text):
                times.update(words)
                seen.update(words)
            docs.update(seen)
            size += len(times) - before
            if size >= HELD:
                yield from send()
                held.clear()
                size = 0
    yield from send()


def consed(counts: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Segment trees over the rows of ``counts``, whose width is a power of two.

    Gives the leaves' counts, the children of the nodes of each level from below, and
    each row's root. Equal subtrees are one node, in all rows and places.
    """
    leaves, node = np.unique(counts, return_inverse=True)
    node = node.reshape(counts.shape).astype(np.int64)
    levels = []
    while node.shape[1] > 1:
        many = int(node.max()) + 1
        pairs, place = np.unique(node[:, ::2] * many + node[:, 1::2], return_inverse=True)
        levels.append((pairs // many, pairs % many))
        node = place.reshape(len(counts), -1).astype(np.int64)
    return leaves, levels, node[:, 0]


def shares(counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """``1 + floor(SCALE * (count + 2) / whole)``, exact also where 64 bits would not do."""
    if len(counts) and int(counts.max()) > (1 << 62) // SCALE:
        found = [1 + SCALE * (int(c) + 2) // int(w) for c, w in zip(counts, whole)]
        return np.array(found, np.int64)
    return 1 + SCALE * (counts + 2) // whole


def _merged(pair: np.ndarray, a: np.ndarray, b: np.ndarray, times: np.ndarray):
    """Equal pairs of nodes as one, with their number."""
    order = np.lexsort((b, a, pair))
    pair, a, b = pair[order], a[order], b[order]
    new = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    return pair[new], a[new], b[new], np.add.reduceat(times[order], new)


def prices(counts: np.ndarray, whole: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Price of each pair ``(row, row)``. Places with a count of -1 are no terms; ``whole`` is N + 2 V of each row."""
    leaves, levels, roots = consed(counts)
    out = np.zeros(len(pairs), np.int64)
    for at in range(0, len(pairs), PAIRS):
        some = pairs[at : at + PAIRS]
        pair = np.arange(len(some))
        a, b, times = roots[some[:, 0]], roots[some[:, 1]], np.ones(len(some), np.int64)
        # Equal trees under equal totals differ in nothing.
        alike = whole[some[:, 0]] == whole[some[:, 1]]
        for left, right in [*reversed(levels), (None, None)]:
            open_ = ~(alike[pair] & (a == b))
            pair, a, b, times = pair[open_], a[open_], b[open_], times[open_]
            if left is None or not len(pair):
                break
            pair, a, b, times = _merged(
                np.tile(pair, 2), np.concatenate([left[a], right[a]]), np.concatenate([left[b], right[b]]), np.tile(times, 2)
            )
        real = leaves[a] >= 0
        pair, a, b, times = pair[real], a[real], b[real], times[real]
        p = shares(leaves[a], whole[some[pair, 0]])
        q = shares(leaves[b], whole[some[pair, 1]])
        np.add.at(out, at + pair, times * ((p - q) ** 2 // (p + q)))
    return out


def _unit(lang: str, rows: list[dict], two: bool) -> pa.RecordBatch:
    """Prices of the pairs of one block and one or two tiles of sources."""
    width = 1
    while width < rows[0]["size"]:
        width *= 2
    counts = np.full((len(rows), width), -1, np.int64)
    counts[:, : rows[0]["size"]] = 0
    for row, own in zip(counts, rows):
        row[np.array(own["slots"] or [], np.int64)] = own["counts"] or []
    tile = np.array([r["tile"] for r in rows])
    i, j = np.triu_indices(len(rows), 1)
    if two:
        i, j = i[tile[i] != tile[j]], j[tile[i] != tile[j]]
    value = prices(counts, np.array([r["whole"] for r in rows], np.int64), np.stack([i, j], 1))
    names = np.array([r["source"] for r in rows], object)
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(i), pa.string()), pa.array(names[i], pa.string()), pa.array(names[j], pa.string()), pa.array(value)],
        names=["lang", "source", "item", "value"],
    )


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by unit; one unit is held at a time."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            unit = (row["lang"], row["block"], row["i"], row["j"])
            if unit != now and held:
                yield _unit(now[0], held, now[2] != now[3])
                held = []
            now = unit
            held.append(row)
    if held:
        yield _unit(now[0], held, now[2] != now[3])


def _share(count: Column, whole: Column) -> Column:
    return F.lit(1).cast("long") + F.call_function("div", F.lit(SCALE).cast("decimal(38,0)") * (count + 2), whole)


def _ranked(df: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return df.withColumn("rank", F.row_number().over(order)).select(
        "lang", "source", F.lit(part).alias("part"), "item", "value", "rank"
    )


def source_divergence(docs: DataFrame, least: int = 10, top: int = 10, text_column: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``(lang, source, part, item, value, rank)``: ``pair`` rows for each other source of the
    language, ``term`` rows for the ``top`` terms that a source holds more of than its language."""
    spark = prepare(docs.sparkSession)
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(empty(lang).alias("lang"), empty(source).alias("source"), empty(text_column).cast("binary").alias("text"))
    counted = keep(
        rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
        .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")),
        "counted",
    )
    vocabulary = keep(
        counted.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least),
        "vocabulary",
    )
    groups = rows.select("lang", "source").distinct()
    langs = keep(
        groups.select("lang").distinct()
        .join(vocabulary.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("all")), "lang", "left")
        .select("lang", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("all", F.lit(0)).alias("all"))
        .withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("v") / BLOCK)).cast("int")),
        "langs",
    )
    dealt = vocabulary.join(langs, "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
    common = Window.partitionBy("lang", "block").orderBy(F.desc("total"), F.asc("term"))
    placed = dealt.select("lang", "term", "total", "block", (F.row_number().over(common) - 1).alias("slot"))
    kept = keep(counted.join(placed, ["lang", "term"]).select("lang", "source", "term", "n", "total", "block", "slot"), "kept")

    by_name = Window.partitionBy("lang").orderBy("source")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    sources = keep(
        groups.join(sums, ["lang", "source"], "left").join(langs, "lang").select(
            "lang", "source", "v", "all", "blocks",
            (F.coalesce("own", F.lit(0)) + 2 * F.col("v")).alias("whole"),
            F.floor((F.row_number().over(by_name) - 1) / TILE).cast("int").alias("tile"),
            F.ceil(F.count("*").over(Window.partitionBy("lang")) / TILE).cast("int").alias("tiles"),
        ),
        "sources",
    )
    sizes = kept.groupBy("lang", "block").agg((F.max("slot") + 1).alias("size"))
    packed = kept.groupBy("lang", "source", "block").agg(F.collect_list(F.struct("slot", "n")).alias("some")).select(
        "lang", "source", "block", F.col("some.slot").alias("slots"), F.col("some.n").alias("counts")
    )
    units = (
        sources.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .join(sizes, ["lang", "block"], "left")
        .join(packed, ["lang", "source", "block"], "left")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select(
            "lang", "block", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"),
            "source", "tile", "whole", F.coalesce("size", F.lit(0)).alias("size"), "slots", "counts",
        )
    )
    walked = (
        units.repartition(4 * partitions(spark), "lang", "block", "i", "j")
        .sortWithinPartitions("lang", "block", "i", "j", "source")
        .mapInArrow(_walk, "lang string, source string, item string, value long")
        .groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    )
    both = walked.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x"), "value")
    pairs = _ranked(both.select("lang", "x.source", "x.item", "value"), "pair")

    p, q = _share(F.col("n"), F.col("whole")), _share(F.col("total"), F.col("all") + 2 * F.col("v"))
    terms = (
        kept.join(sources, ["lang", "source"])
        .select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q"))
        .filter("p > q")
        .select("lang", "source", "item", F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    )
    return pairs.union(_ranked(terms, "term").filter(F.col("rank") <= top))
