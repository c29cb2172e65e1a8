"""Quality rules: counts of a text, and how much likelier a trusted corpus makes its n-grams.

Base rules count words, symbols and repeats and fail what is too short or repeats itself.
The verdict on the rest compares two multinomials over ``BUCKETS`` hashed n-grams of tokens (n = 1
and 2; tokens are runs of letters, digits and bytes beyond ASCII, and runs of other visible characters): a
target one, counted on trusted texts, and a raw one, counted on all texts. The score is the
sum of the logarithms of their ratio over a text's n-grams, divided by their number. Every
text is decided by a threshold, none by chance. Ratios are kept as whole multiples
of 2**-20 and summed as integers, so a score does not depend on how rows are batched.

The target is learnt from all labelled rows: trusted are those of quality 1 that
are not toxic. Half of them make the target, the other half and the rows of quality 0 set the
threshold, which best tells them apart. Raw counts cover all rows. Without trusted texts
every score is 0 and the base rules decide alone; without rows of quality 0 the threshold is the one that
keeps all but a hundredth of the trusted half.

Null and empty texts have no words and fail the base rules. Long texts are hashed slice by slice, as a whole.
Rows that repeat are judged each; of labels of one id the lowest quality and the highest toxicity count, and of texts of one
labelled id the lowest. A null id is judged and learns nothing. A score equal to the threshold is
kept. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starmart.llm.cuts import Cuts
from starmart.llm.store import keep, partitions, prepare
from starmart.llm.words import Words, _power, _slices, mix, shingles, text_buffer

_U = np.uint64
#: Bits that labelled ids are marked in, in blocks of 2**15: 8 MB.
MARK_BITS = 26
BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
#: Counts travel in slices of this many buckets.
SLICE = 1 << 10
#: Ratios are multiples of one over this.
UNIT = 1 << 20

_SYMBOLS = b"#*$%&|<>"


@cache
def _kinds() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kind of each byte for words and for tokens (0 is a blank), and its hash."""
    word = np.ones(256, np.int8)
    word[[0x20, *range(0x09, 0x0E)]] = 0
    token = word * 2
    for low, high in ((48, 58), (65, 91), (97, 123), (128, 256)):
        token[low:high] = 1
    return word, token, mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))


def runs(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> Words:
    """Runs of bytes of one kind, as hashes that tell upper from lower case."""
    value = _kinds()[2]
    hashes, starts, ends = [], [], []
    for at, to in _slices(data, offsets):
        part = kind[data[at:to]]
        border = np.empty(len(part) + 1, bool)
        border[0] = border[-1] = True
        border[1:-1] = part[1:] != part[:-1]
        border[offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to)] - at] = True
        cuts = np.flatnonzero(border)
        seen = part[cuts[:-1]] > 0
        start, last = cuts[:-1][seen], cuts[1:][seen]
        up, down = _power(len(part) + 1)
        sums = np.zeros(len(part) + 1, _U)
        np.cumsum(value[data[at:to]] * up[: len(part)], out=sums[1:])
        hashes.append(mix((sums[last] - sums[start]) * down[start] + (last - start).astype(_U)))
        starts.append(start + at)
        ends.append(last + at)
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    start = join(starts, np.int64)
    return Words(data, offsets, join(hashes, _U), start, join(ends, np.int64), np.searchsorted(start, offsets))


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.append(0, np.cumsum(flags, dtype=np.int64))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def repeated_words(windows: np.ndarray, n: int) -> int:
    """Words that lie in windows of n words which occur twice or more."""
    if len(windows) < 2:
        return 0
    ordered = np.sort(windows)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    starts = np.flatnonzero(np.isin(windows, twice))
    covered = np.zeros(len(windows) + n, np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + n, -1)
    return int((np.cumsum(covered) > 0).sum())


def repeated_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    return len(lines) - len(set(lines))


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def base_counts(data: np.ndarray, offsets: np.ndarray, window: int = 8) -> np.ndarray:
    """One row of ``BASE`` for each text."""
    word, _, _ = _kinds()
    found = runs(data, offsets, word)
    symbol = np.zeros(256, bool)
    symbol[list(_SYMBOLS)] = True
    out = np.zeros((len(offsets) - 1, len(BASE)), np.int64)
    out[:, 0] = np.diff(found.first)
    # Bytes that begin a code point, blanks left out.
    out[:, 1] = _per_text((word[data] > 0) & (data & 0xC0 != 0x80), offsets)
    out[:, 2] = _per_text(symbol[data], offsets)
    grams, first = shingles(found, window)
    for i in range(len(out)):
        out[i, 3] = repeated_lines(data[offsets[i] : offsets[i + 1]].tobytes())
        if out[i, 0] > window:
            out[i, 4] = repeated_words(grams[first[i] : first[i + 1]], window)
    return out


def buckets_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, those of tokens and then those of pairs, and whose each is.

    A text of one token has that token as its only pair.
    """
    found = runs(data, offsets, _kinds()[1])
    pairs, first = shingles(found, 2)
    shift = _U(64 - BUCKET_BITS)
    hashes = np.concatenate([mix(found.hashes + _U(1)) >> shift, pairs >> shift]).astype(np.int64)
    text = np.arange(len(offsets) - 1)
    return hashes, np.concatenate([np.repeat(text, np.diff(found.first)), np.repeat(text, np.diff(first))])


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task, as slices."""
    counts = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        where, _ = buckets_of(*text_buffer(batch.column("text")))
        counts += np.bincount(where, minlength=BUCKETS)
    slices = [i for i in range(0, BUCKETS, SLICE) if counts[i : i + SLICE].any()]
    yield pa.RecordBatch.from_arrays(
        [pa.array(slices, pa.int32()), pa.array([counts[i : i + SLICE].tobytes() for i in slices], pa.binary())], names=["slice", "counts"]
    )


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for at, counts in zip(*(c.to_pylist() for c in batch.columns)):
            sums[at] = sums.get(at, 0) + np.frombuffer(counts, np.int64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["slice", "counts"]
    )


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """N-grams of all rows per bucket, summed by slice of buckets; one number a bucket reaches the driver."""
    schema = "slice int, counts binary"
    sliced = texts.select("text").mapInArrow(_tally, schema)
    summed = sliced.repartition(min(partitions(texts.sparkSession), BUCKETS // SLICE), "slice").mapInArrow(_add_up, schema)
    out = np.zeros(BUCKETS, np.int64)
    for row in summed.collect():
        out[row["slice"] : row["slice"] + SLICE] = np.frombuffer(row["counts"], np.int64)
    return out


def ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log-ratios of the smoothed multinomials, in ``UNIT``s."""
    if not target.sum():
        return np.zeros(len(raw), np.int64)
    p = (target + 1.0) / (target.sum() + len(target))
    q = (raw + 1.0) / (raw.sum() + len(raw))
    return np.round(UNIT * np.log(p / q)).astype(np.int64)


def ratio_sums(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the log-ratios and number of n-grams of each text."""
    where, text = buckets_of(data, offsets)
    sums = np.zeros(len(offsets) - 1, np.int64)
    np.add.at(sums, text, weights[where])
    return sums, np.bincount(text, minlength=len(sums))


def threshold(trusted: np.ndarray, rejected: np.ndarray) -> float:
    """The score that best tells trusted from rejected texts: the lowest cut, midway to the score below it."""
    trusted, rejected = np.sort(trusted), np.sort(rejected)
    if not len(trusted):
        return -np.inf
    if not len(rejected):
        return float(trusted[len(trusted) // 100])
    cuts = np.append(-np.inf, np.unique(np.concatenate([trusted, rejected])))
    kept = 1 - np.searchsorted(trusted, cuts) / len(trusted)
    let_in = 1 - np.searchsorted(rejected, cuts) / len(rejected)
    best = int(np.argmax(kept - let_in))
    return float((cuts[best - 1] + cuts[best]) / 2) if best > 1 else float(cuts[best])


def least_score(cuts: Cuts) -> float:
    """``threshold`` over scores of any number; those of rejected texts are the low kind."""
    if not cuts.highs:
        return -np.inf
    if not cuts.lows:
        return float(cuts.high_at(cuts.highs // 100))
    gap = cuts.best()
    return float((gap.score + gap.following) / 2) if gap and gap.gain > 0 else -np.inf


@dataclass
class Rules:
    """Fitted ratios and threshold, and the limits of the base rules."""

    weights: np.ndarray
    least: float
    least_words: int = 20
    most_repeated: int = 30

    def judge(self, texts: pa.Array) -> dict[str, np.ndarray]:
        data, offsets = text_buffer(texts)
        base = base_counts(data, offsets)
        n, repeated = base[:, 0], base[:, 4]
        failed = (n < self.least_words) | (100 * repeated > self.most_repeated * n)
        sums, many = ratio_sums(data, offsets, self.weights)
        score = sums / UNIT / np.maximum(many, 1)
        return dict(zip(BASE, base.T)) | {"base_failed": failed, "score": score, "kept": ~failed & (score >= self.least)}


def _marked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without most rows whose id is not in ``ids``, so that their texts need not be moved for a join.

    The ids are marked in a bitmap of 2**MARK_BITS bits by their hash, which is broadcast whatever their number.
    """
    place = F.shiftrightunsigned(F.xxhash64("id"), 64 - MARK_BITS)
    bitmaps = ids.groupBy(F.shiftright(place, 15).alias("block")).agg(F.bitmap_construct_agg(place.bitwiseAND(F.lit((1 << 15) - 1))).alias("bits"))
    spot = place.bitwiseAND(F.lit((1 << 15) - 1))
    byte = F.conv(F.hex(F.expr("substring(bits, spot div 8 + 1, 1)")), 16, 10).cast("int")
    there = F.getbit(byte, (F.col("spot") % 8).cast("int")) == 1
    rows = docs.withColumns({"block": F.shiftright(place, 15), "spot": spot.cast("int")})
    return rows.join(F.broadcast(bitmaps), "block").filter(there).select(*docs.columns)


def fit_rules(docs: DataFrame, labels: DataFrame) -> Rules:
    """``docs(id, text)`` and ``labels(doc_id, quality, toxic)``."""
    known = (
        labels.filter("doc_id is not null and quality in (0, 1)")
        .groupBy(F.col("doc_id").cast("long").alias("id"))
        .agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
        .filter("quality = 0 or toxic = 0").select("id", "quality")
    )
    half = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2))
    role = F.when(F.col("quality") == 0, "rejected").when(half == 0, "target").otherwise("trusted")
    here = _marked(docs, known).join(known, "id").groupBy("id", "quality").agg(F.min("text").alias("text"))
    texts = keep(here.select("text", role.alias("role")), "labelled-texts")
    weights = ratios(bucket_counts(texts.filter("role = 'target'")), bucket_counts(docs))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, many = ratio_sums(*text_buffer(batch.column("text")), weights)
            yield pa.RecordBatch.from_arrays([pa.array(sums / UNIT / np.maximum(many, 1)), batch.column("low")], names=["score", "low"])

    rest = texts.filter("role <> 'target'").select("text", (F.col("role") == "rejected").alias("low"))
    return Rules(weights, least_score(Cuts(rest.mapInArrow(scores, "score double, low boolean"))))


def _judge(rules: Rules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = rules.judge(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, found.values())], names=["id", *found])

    return run


def quality_rules(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept)``."""
    prepare(docs.sparkSession)
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    rules = fit_rules(texts, labels)
    schema = "id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, score double, kept boolean"
    return texts.mapInArrow(_judge(rules), schema).withColumnRenamed("id", id_column)
