"""URL filter: rules first, then two character language models.

A rule is a host and the beginning of a path. It fits its host and all subdomains, for
paths that begin as it does; the longest rule that fits decides. URLs that no rule fits are judged by
the difference of two log-likelihoods, per character: one under a model of accepted
URLs, one under a model of rejected ones. Both are variable-order Markov models: the probability of a character
after its last ``ORDER`` characters backs off to ever shorter contexts (Witten-Bell), down to a
uniform distribution over bytes.

Models learn from URLs whose kind is known: those of a labelled table, or else those with a rejected word in the host
(``REJECTED_WORDS``) as rejected, and those without one that no rule blocks as accepted. Top-level
and second-level names and the scheme say nothing of a page, so the models read the
rest of the host and the path. They are fitted on all distinct URLs of each kind but those held back, a quarter, on all of which the
cut between the verdicts is calibrated. Bytes after a context are counted by Spark; a model holds the counts by
hash of the context (``CONTEXT_BITS``) and of context and byte (``PAIR_BITS``), as sorted arrays, so its size is bounded
however many URLs it has learnt from.

Null URLs and those without ``://`` have empty host and path; no rule fits them and
the models see an empty text, which is allowed. URLs of any length are read whole. A score equal to the cut is allowed. Rows that repeat are judged each. An
empty table gives no row. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starmart.llm.cuts import Cuts
from starmart.llm.store import keep, prepare
from starmart.llm.words import mix, text_buffer

_U = np.uint64
ORDER = 5
#: Contexts, and pairs of context and byte, of one length that a model tells apart, as bits.
CONTEXT_BITS, PAIR_BITS = 18, 20
#: Cells that a task counts before it sends them on.
CELLS = 1 << 20
#: (host and beginning of the path, verdict). Fixed values.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
REJECTED_WORDS = ["ads", "adult", "bet", "bets", "casino", "loan", "pills", "porn", "spam", "xxx"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(
        F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*(/?[^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if there is none."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        name, slash, begin = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + begin)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _read_part(host: Column, path: Column) -> Column:
    """What the models read: the host without its last two names, and the path."""
    names = F.split(host, r"\.")
    own = F.concat_ws(".", F.slice(names, 1, F.greatest(F.size(names) - 2, F.lit(0))))
    return F.concat(own, path)


def _contexts(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Bytes of all texts, where each text begins, and for each context length the
    hashes of the bytes before. Texts begin after ``order`` zero bytes."""
    data, offsets = text_buffer(texts)
    n = len(offsets) - 1
    size = np.diff(offsets) + order
    first = np.append(0, np.cumsum(size))
    padded = np.zeros(first[-1], np.uint8)
    at = np.arange(len(data)) + order * (np.repeat(np.arange(n), np.diff(offsets)) + 1)
    padded[at] = data
    contexts = []
    for length in range(order + 1):
        h = np.full(len(at), mix(np.array([length + 1], _U))[0], _U)
        for k in range(1, length + 1):
            h = mix(h * _U(257) + padded[at - k])
        contexts.append(h)
    return data, offsets, contexts


@dataclass
class Model:
    """For each context length: sorted hashes of contexts with how many bytes and distinct bytes
    followed, and sorted hashes of context and byte with their counts."""

    contexts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    pairs: list[tuple[np.ndarray, np.ndarray]]

    def log_likelihood(self, data: np.ndarray, contexts: list[np.ndarray]) -> np.ndarray:
        p = np.full(len(data), 1 / 256)
        for (known, total, kinds), (pairs, count), h in zip(self.contexts, self.pairs, contexts):
            if not len(known):
                continue
            cell = _cells(data, h)
            context, pair = _context(cell), _pair(cell)
            at = np.minimum(np.searchsorted(known, context), len(known) - 1)
            here = known[at] == context
            to = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
            seen = np.where(pairs[to] == pair, count[to], 0)
            n, t = total[at], kinds[at]
            p = np.where(here, (seen + t * p) / (n + t), p)
        return np.log(p)


def _cells(data: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Cell of a context's hash and the byte that follows."""
    return ((h >> _U(64 - CONTEXT_BITS)) << _U(8) | data.astype(_U)).astype(np.int64)


def _context(cell: np.ndarray) -> np.ndarray:
    return (cell >> 8).astype(np.int32)


def _pair(cell: np.ndarray) -> np.ndarray:
    return (mix(cell.astype(_U) + _U(1)) >> _U(64 - PAIR_BITS)).astype(np.int32)


def _counted(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the sum of their weights, and how often each is there."""
    found, place, times = np.unique(keys, return_inverse=True, return_counts=True)
    sums = np.zeros(len(found), np.int64)
    np.add.at(sums, place, weights)
    return found, sums, times


def fit_model(texts: list[str], order: int = ORDER) -> Model:
    """The model of texts that are at hand; ``fit_models`` is the same over tables."""
    data, _, contexts = _contexts(pa.array(texts, pa.string()), order)
    out = Model([], [])
    for h in contexts:
        cells, count = np.unique(_cells(data, h), return_counts=True)
        out.contexts.append(_counted(_context(cells), count))
        out.pairs.append(_counted(_pair(cells), count)[:2])
    return out


_LENGTH_BITS = CONTEXT_BITS + 8


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task per cell; ``cell`` tells kind, context length and cell."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    merged = lambda: _counted(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))[:2]
    own = lambda cells: cells & (1 << _LENGTH_BITS) - 1
    row = lambda cells, count: pa.RecordBatch.from_arrays(
        [*map(pa.array, (cells, _context(own(cells)), _pair(own(cells)), count))], names=["cell", "context", "pair", "n"]
    )
    for batch in batches:
        data, offsets, contexts = _contexts(batch.column("seen"), ORDER)
        kind = np.repeat(batch.column("rejected").to_numpy(zero_copy_only=False).astype(np.int64), np.diff(offsets)) << 3
        for length, h in enumerate(contexts):
            parts.append(np.unique(((kind | length) << _LENGTH_BITS) | _cells(data, h), return_counts=True))
        if sum(len(k) for k, _ in parts) > CELLS:
            parts = [merged()]
            if len(parts[0][0]) > CELLS // 2:
                yield row(*parts.pop())
    if parts:
        yield row(*merged())


def fit_models(texts: DataFrame) -> dict[str, Model]:
    """Models of ``texts(seen, rejected)``, counted over all rows. Sums by hash, of bounded number, reach the driver."""
    cells = texts.select("seen", "rejected").mapInArrow(_tally, "cell long, context int, pair int, n long")
    cells = keep(cells.groupBy("cell", "context", "pair").agg(F.sum("n").alias("n")), "url-cells")
    of = F.shiftright("cell", _LENGTH_BITS).alias("of")
    contexts = cells.groupBy(of, "context").agg(F.sum("n").alias("n"), F.count("n").alias("kinds")).toArrow()
    pairs = cells.groupBy(of, "pair").agg(F.sum("n").alias("n")).toArrow()

    def ordered(found: pa.Table, at: int, *names: str) -> tuple[np.ndarray, ...]:
        here = found["of"].to_numpy() == at
        columns = [found[name].to_numpy()[here] for name in names]
        place = np.argsort(columns[0])
        return tuple(c[place] for c in columns)

    return {
        name: Model(
            [ordered(contexts, kind << 3 | k, "context", "n", "kinds") for k in range(ORDER + 1)],
            [ordered(pairs, kind << 3 | k, "pair", "n") for k in range(ORDER + 1)],
        )
        for kind, name in enumerate(("accepted", "rejected"))
    }


def differences(texts: pa.Array, accepted: Model, rejected: Model, order: int = ORDER) -> np.ndarray:
    """Log-likelihood under rejected less that under accepted URLs, per byte; 0 if empty."""
    data, offsets, contexts = _contexts(texts, order)
    each = np.append(0.0, np.cumsum(rejected.log_likelihood(data, contexts) - accepted.log_likelihood(data, contexts)))
    return (each[offsets[1:]] - each[offsets[:-1]]) / np.maximum(np.diff(offsets), 1)


def calibrate(cuts: Cuts) -> float:
    """The cut with the highest balanced accuracy, accepted URLs being the low kind; the middle of the widest such gap, 0
    if one kind is missing."""
    if not cuts.lows or not cuts.highs:
        return 0.0
    gap = cuts.best(widest=True)
    if gap is None or gap.gain < 0:
        # Nothing is better than one verdict for all.
        return float(cuts.least - 1)
    return float((gap.score + gap.following) / 2)


def _judge(accepted: Model, rejected: Model, cut: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = differences(batch.column("seen"), accepted, rejected)
            seen = batch.column("seen").to_pylist()
            block = (score > cut) & np.array([bool(x) for x in seen], bool)
            verdict = [v or ("block" if b else "allow") for v, b in zip(batch.column("verdict").to_pylist(), block)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("page_id", "host", "path", "rule")), pa.array(verdict, pa.string()), pa.array(score)],
                names=["page_id", "host", "path", "rule", "verdict", "score"],
            )

    return run


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, rejected_words: Sequence[str] = REJECTED_WORDS,
    id_column: str = "page_id", url_column: str = "url", labelled: DataFrame | None = None,
) -> DataFrame:
    """``(page_id, host, path, rule, verdict, score)`` for each row; ``labelled`` holds ``url`` and ``rejected`` (0 or 1)."""
    prepare(pages.sparkSession)
    host, path = host_and_path(F.col("url"))
    parts = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).alias("url")).select(
        "page_id", host.alias("host"), path.alias("path")
    )
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    parts = parts.withColumns({"rule": rule, "verdict": verdict, "seen": _read_part(F.col("host"), F.col("path"))})
    # A word of a host stands between dots, hyphens or digits.
    bad = F.col("host").rlike(r"(^|[.\-0-9])(" + "|".join(rejected_words) + r")([.\-0-9]|$)") if rejected_words else F.lit(False)
    if labelled is None:
        off = F.coalesce(F.col("verdict") == "block", F.lit(False))
        kinds = parts.select("seen", F.when(bad, "rejected").when(~off, "accepted").alias("kind"))
    else:
        kinds = labelled.select(*[c.alias(n) for c, n in zip(host_and_path(F.col("url")), ("host", "path"))], "rejected").select(
            _read_part(F.col("host"), F.col("path")).alias("seen"), F.expr("decode(rejected, 1, 'rejected', 0, 'accepted')").alias("kind")
        )
    # Copies of a URL count once, so none is both in the counts and in the part held back.
    known = keep(
        kinds.filter("seen <> '' and kind is not null").distinct()
        .select("seen", (F.col("kind") == "rejected").alias("rejected"), (F.pmod(F.xxhash64("seen"), F.lit(4)) == 3).alias("held")),
        "urls",
    )
    models = fit_models(known.filter("not held"))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = differences(batch.column("seen"), models["accepted"], models["rejected"])
            yield pa.RecordBatch.from_arrays([pa.array(score), pa.compute.invert(batch.column("rejected"))], names=["score", "low"])

    cut = calibrate(Cuts(known.filter("held").select("seen", "rejected").mapInArrow(scores, "score double, low boolean")))
    return parts.mapInArrow(
        _judge(models["accepted"], models["rejected"], cut),
        "page_id long, host string, path string, rule string, verdict string, score double",
    )
