"""Quality classifier: histogram gradient-boosted trees over statistics of a text.

Every text is read once and becomes a row of statistics, which is written. The
trees are fitted on a bounded sample of the labelled rows (``MAX_LABELLED``, those with the
lowest hash of their id, whatever the size of the input; of texts that share an id the lowest statistics) and flattened into arrays: one row
of nodes per tree, walked for all documents of a batch at once.

Scores lie between 0 and 1, higher where label 1 is likelier. Null and empty texts have
the statistics of an empty text and are scored like any other. Labels other than 0 and 1 are left
out; of several labels of an id the lowest counts. Without labels of both kinds every score is the share
of label 1 (0.5 without labels). Rows that repeat are scored each; a null id counts as held
out if its empty text does, and learns nothing. Texts of any length are read whole. A score equal to the limit is accepted. An empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starmart.llm.sample import lowest
from starmart.llm.store import keep, prepare
from starmart.llm.words import Words, words

#: Most labelled rows that trees are fitted on.
MAX_LABELLED = 20_000

FEATURES = [
    "bytes", "words", "word_length", "upper", "digits", "symbols", "pipes", "bangs", "high_bytes", "lines",
    "line_words", "short_lines", "distinct_words", "repeated_next", "top_word", "distinct_pairs", "repeated_lines",
    "ends_symbol", "only_upper", "entropy", "stops", "short_words",
]


def _entropy(counts: np.ndarray) -> float:
    share = counts[counts > 0] / max(counts.sum(), 1)
    return float(-(share * np.log2(share)).sum())


def statistics(found: Words) -> np.ndarray:
    """One row of ``FEATURES`` for each text. Shares are of bytes, words or lines."""
    data, offsets = found.data, found.offsets
    table = np.zeros((len(offsets) - 1, len(FEATURES)))
    last = data[found.end - 1] if len(found.end) else data
    letter = ((last | 32) >= 97) & ((last | 32) <= 122)
    ends_symbol = (last < 128) & ~letter & ~((last >= 48) & (last <= 57)) & (last != 46) & (last != 44)
    head = data[found.start] if len(found.start) else data
    upper_sums = np.append(0, np.cumsum((data >= 97) & (data <= 122), dtype=np.int64))
    lower_in_word = upper_sums[found.end] - upper_sums[found.start]
    shout = (lower_in_word == 0) & ((head | 32) >= 97) & ((head | 32) <= 122) & (found.end - found.start > 1)
    for i in range(len(table)):
        a, b = offsets[i], offsets[i + 1]
        lo, hi = found.first[i], found.first[i + 1]
        n, m = b - a, hi - lo
        if not m:
            table[i, 0] = np.log1p(n)
            continue
        count = np.bincount(data[a:b], minlength=256)
        text_words = found.hashes[lo:hi]
        _, times = np.unique(text_words, return_counts=True)
        breaks = np.flatnonzero(data[a:b] == 10) + a
        cuts = np.concatenate([[lo], np.searchsorted(found.start[lo:hi], breaks) + lo, [hi]])
        lengths = np.diff(cuts)
        sums = np.append(np.uint64(0), np.cumsum(text_words))
        lines = (sums[cuts[1:] - lo] - sums[cuts[:-1] - lo])[lengths > 0]
        pairs = text_words[1:] * np.uint64(3) + text_words[:-1]
        size = found.end[lo:hi] - found.start[lo:hi]
        ascii_symbols = count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum()
        table[i] = (
            np.log1p(n), np.log1p(m), size.mean(), count[65:91].sum() / n, count[48:58].sum() / n, ascii_symbols / n,
            count[124] / m, count[33] / m, count[128:].sum() / n, np.log1p(len(lines)), np.log1p(m / len(lines)),
            (lengths[lengths > 0] <= 2).mean(), len(times) / m, (text_words[1:] == text_words[:-1]).mean() if m > 1 else 0,
            times.max() / m, len(np.unique(pairs)) / max(m - 1, 1), 1 - len(np.unique(lines)) / len(lines),
            ends_symbol[lo:hi].mean(), shout[lo:hi].mean(), _entropy(count), (count[46] + count[44]) / m, (size <= 3).mean(),
        )
    return table


@dataclass
class Trees:
    """Flat trees: ``feature[t, k]`` splits node k of tree t, whose children are 2k + 1
    (at most ``threshold``) and 2k + 2. ``value`` belongs to the leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    start: float
    depth: int = field(default=4)

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.start)
        each = np.arange(len(rows))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (rows[each, feature[node]] > threshold[node])
            total += value[node]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(
    rows: np.ndarray, labels: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64,
    penalty: float = 1.0, least: float = 2.0,
) -> Trees:
    """Boosted trees for the logistic loss, split on histograms of binned features."""
    inner, nodes = (1 << depth) - 1, (2 << depth) - 1
    shape = (trees, nodes)
    out = Trees(np.zeros(shape, np.int64), np.full(shape, np.inf), np.zeros(shape), 0.0, depth)
    share = float(labels.mean()) if len(labels) else 0.5
    if share in (0.0, 1.0) or not len(labels):
        # Nothing to tell apart: the share, kept off 0 and 1 as the scale needs.
        share = min(max(share, 1e-6), 1 - 1e-6)
        out.start = float(np.log(share / (1 - share)))
        return out
    out.start = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in rows.T]
    binned = np.stack([np.searchsorted(c, col, "left") for c, col in zip(cuts, rows.T)], 1)
    width = bins + 1
    total = np.full(len(rows), out.start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        slope, bend = labels - p, p * (1 - p)
        node = np.zeros(len(rows), np.int64)
        for level in range(depth):
            base, here = (1 << level) - 1, 1 << level
            at = node - base
            best = np.zeros(here)
            for f, cut in enumerate(cuts):
                if not len(cut):
                    continue
                cell = at * width + binned[:, f]
                g = np.bincount(cell, slope, here * width).reshape(here, width).cumsum(1)
                h = np.bincount(cell, bend, here * width).reshape(here, width).cumsum(1)
                gl, hl = g[:, : len(cut)], h[:, : len(cut)]
                gr, hr = g[:, -1:] - gl, h[:, -1:] - hl
                gain = gl**2 / (hl + penalty) + gr**2 / (hr + penalty) - g[:, -1:] ** 2 / (h[:, -1:] + penalty)
                gain[(hl < least) | (hr < least)] = 0
                k = gain.argmax(1)
                top = gain[np.arange(here), k]
                better = top > best + 1e-9
                best[better] = top[better]
                out.feature[t, base : base + here][better] = f
                out.threshold[t, base : base + here][better] = cut[k[better]]
            node = 2 * node + 1 + (rows[np.arange(len(rows)), out.feature[t, node]] > out.threshold[t, node])
        g = np.bincount(node, slope, nodes)[inner:]
        h = np.bincount(node, bend, nodes)[inner:]
        out.value[t, inner:] = rate * g / (h + penalty)
        total += out.value[t, node]
    return out


def held_out(doc_id: Column) -> Column:
    """Rows that are kept from learning: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        table = statistics(words(batch.column("text")))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("row"), pa.array(list(table), pa.list_(pa.float64()))], names=["id", "row", "x"]
        )


def _score(trees: Trees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("x").flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("row"), pa.array(trees.score(rows))], names=["id", "row", "score"]
            )

    return run


def score_quality(
    docs: DataFrame, labels: DataFrame, accept: float = 0.7, max_labelled: int = MAX_LABELLED,
    id_column: str = "doc_id", text_column: str = "text", row_column: str | None = None,
) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``; ``labels`` holds ``doc_id`` and ``quality``.

    With ``row_column``, a number of each row, that comes out too."""
    prepare(docs.sparkSession)
    row = F.col(row_column) if row_column else F.lit(None)
    texts = docs.select(F.col(id_column).cast("long").alias("id"), row.cast("long").alias("row"), F.col(text_column).alias("text"))
    described = keep(texts.mapInArrow(_describe, "id long, row long, x array<double>"), "statistics")
    known = (
        labels.filter("quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").alias("y"))
    )
    here = keep(
        known.filter(~held_out(F.col("id"))).join(described.filter("id is not null").select("id").distinct(), "id"), "labelled"
    )
    # At most max_labelled rows of two numbers are broadcast, and as many of statistics reach the driver.
    some = F.broadcast(lowest(here, max_labelled, "id"))
    sample = described.join(some, "id").groupBy("id", "y").agg(F.min("x").alias("x")).collect()
    sample.sort(key=lambda r: r["id"])
    rows = np.array([r["x"] for r in sample], float).reshape(-1, len(FEATURES))
    trees = fit(rows, np.array([r["y"] for r in sample], float))
    scored = described.mapInArrow(_score(trees), "id long, row long, score double")
    return scored.select(
        F.col("id").alias("doc_id"),
        held_out(F.col("id")).alias("held_out"),
        "score",
        (F.col("score") >= accept).cast("int").alias("predicted"),
        *([F.col("row").alias(row_column)] if row_column else []),
    )
