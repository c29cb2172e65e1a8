"""Word n-gram model by deleted interpolation, learned from and applied to a whole corpus.

A text is its words and one end; the words before the first are ends of texts.
A word's probability mixes the maximum-likelihood estimates of all orders; for the order of two::

    a * c(v, w) / c(v)  +  b * c(w) / N  +  (1 - a - b) / (V + 1)

and for the order of three c(u, v, w) / c(u, v) beside them. The weights depend on how often the longest context that
was seen has been seen (buckets by powers of two, for each length of context). The weights are learned by expectation-maximisation on held-out counts: each training token
is left out of the counts that it is predicted from (c - 1), so all training texts
serve for both. V + 1 allows for one unknown word.

The corpus is read once and cut into chunks of whole documents, written as arrays of word numbers.
Of each chunk its distinct words, word pairs and so on, as 64-bit hashes with their training counts, go to
buckets by hash; a bucket sums the counts of all chunks and answers each chunk in the order it asked.
A frequent word or pair is one entry per chunk, and nothing but sums over the vocabulary and
the histogram for the weights (bounded by its bins) reaches the driver.

Null texts are empty: the end alone. Rows that repeat are counted and scored each. A null
id is held out or not as an empty id text is. Without training texts N is 0, and every score is that of the
uniform distribution over the one unknown word. An empty table gives no row. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starmart.llm.store import keep, partitions, prepare
from starmart.llm.words import mix, words

_U = np.uint64
END = _U(0x5851F42D4C957F2D)
_FACTOR = _U(0x9FB21C651E98DF25)
#: UTF-8 bytes in a chunk, about; a longer document is a chunk of its own.
CHUNK_BYTES = 4 << 20
CONTEXTS = 24
#: Bins of the histogram that weights are learned from: tenths of log10 of a probability.
BINS = 200
_CHUNK = "chunk long, ids binary, nulls binary, held binary, sizes binary, vocabulary binary, tokens binary"


def _pack(values: np.ndarray, kind: str) -> bytes:
    # Bytes of equal weight side by side compress better.
    plain = np.ascontiguousarray(values, kind)
    return zstandard.compress(plain.view(np.uint8).reshape(len(plain), -1).T.tobytes(), 3)


def _unpack(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).reshape(-1)


def _pack_sorted(hashes: np.ndarray) -> bytes:
    """Steps between sorted hashes have fewer bits than the hashes."""
    return _pack(np.diff(hashes, prepend=_U(0)), "<u8")


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, "<u8"), dtype=_U)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row after another, so that only one is unpacked at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _fold(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    number, ids, sizes, hashes, held = 0, [], [], [], 0

    def close() -> pa.RecordBatch:
        vocabulary, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
        known = np.array([i or 0 for i in ids], np.int64)
        row = (
            (task << 32) + number,
            _pack(known, "<i8"),
            _pack(np.array([i is None for i in ids]), "u1"),
            _pack(np.array([_fold(i) == 0 for i in ids]), "u1"),
            _pack(np.array(sizes), "<u4"),
            _pack_sorted(vocabulary),
            _pack(tokens, "<u4"),
        )
        return pa.RecordBatch.from_arrays(
            [pa.array([row[0]]), *(pa.array([x], pa.binary()) for x in row[1:])],
            names=["chunk", "ids", "nulls", "held", "sizes", "vocabulary", "tokens"],
        )

    for batch in batches:
        found = words(batch.column("text"))
        for i, doc in enumerate(batch.column("id").to_pylist()):
            ids.append(doc)
            own = np.append(found.of(i), END)
            sizes.append(len(own))
            hashes.append(own)
            held += int(found.offsets[i + 1] - found.offsets[i]) + 1
            if held >= CHUNK_BYTES:
                yield close()
                number, ids, sizes, hashes, held = number + 1, [], [], [], 0
    if ids:
        yield close()


class _Chunk:
    """One chunk's tokens, by number in its vocabulary, and the n-grams that they form."""

    def __init__(self, row: dict, order: int):
        self.ids = _unpack(row["ids"], "<i8")
        self.nulls = _unpack(row["nulls"], "u1").astype(bool)
        self.held = _unpack(row["held"], "u1").astype(bool)
        self.sizes = _unpack(row["sizes"], "<u4").astype(np.int64)
        self.vocabulary = _unpack_sorted(row["vocabulary"])
        self.tokens = _unpack(row["tokens"], "<u4")
        self.first = np.append(0, np.cumsum(self.sizes))
        self.end = int(np.searchsorted(self.vocabulary, END))
        self.train = np.repeat(~self.held, self.sizes)
        #: For each length, the distinct n-grams and the number of the one that ends in each token.
        self.grams = [(self.vocabulary, self.tokens)]
        word, start = self.vocabulary[self.tokens], END
        gram = word
        for _ in range(order - 1):
            gram = mix(self.after_start(gram, start) * _FACTOR + word)
            start = mix(np.array([start], _U) * _FACTOR + END)[0]
            self.grams.append(np.unique(gram, return_inverse=True))

    def after_start(self, values: np.ndarray, start) -> np.ndarray:
        """For each token what ``values`` has for the token before it in its text, ``start`` for the first."""
        before = np.empty_like(values)
        before[1:] = values[:-1]
        before[self.first[:-1]] = start
        return before

    def longest(self) -> tuple[np.ndarray, np.ndarray]:
        """The longest n-grams, by hash, with their counts in training texts."""
        hashes, at = self.grams[-1]
        return hashes, np.bincount(at[self.train], minlength=len(hashes))


def _ask(buckets: int, kind: int):
    """Of each chunk the n-grams of ``kind + 1`` words, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([(k << 64) // buckets for k in range(1, buckets)], _U)
        for row in _rows(batches):
            out = []
            hashes, counts = _Chunk(row, kind + 1).longest()
            cuts = np.concatenate([[0], np.searchsorted(hashes, edges), [len(hashes)]])
            for b, (i, j) in enumerate(zip(cuts, cuts[1:])):
                if j > i:
                    out.append((b, row["chunk"], kind, _pack_sorted(hashes[i:j]), _pack(counts[i:j], "<u4")))
            columns = list(zip(*out))
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["bucket", "chunk", "kind", "hashes", "counts"],
            )

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each bucket's counts. Rows come sorted by bucket, one of these is
    held at a time. Beside the answers: how many words training has, and how often."""

    def close(kind: int, bucket: int, rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        asked = [_unpack_sorted(r[1]) for r in rows]
        distinct, place = np.unique(np.concatenate(asked), return_inverse=True)
        counts = np.concatenate([_unpack(r[2], "<u4") for r in rows])
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, place, counts.astype(np.int64))
        cuts = np.cumsum([len(a) for a in asked])[:-1]
        answers = [_pack(total[p], "<u8") for p in np.split(place, cuts)]
        seen = int((total > 0).sum()) if kind == 0 else 0
        tokens = int(total.sum()) if kind == 0 else 0
        n = len(rows)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([kind] * n, pa.int32()),
                pa.array([bucket] * n, pa.int32()),
                pa.array(answers, pa.binary()),
                pa.array([seen] + [0] * (n - 1), pa.int64()),
                pa.array([tokens] + [0] * (n - 1), pa.int64()),
            ],
            names=["chunk", "kind", "bucket", "answer", "seen", "tokens"],
        )

    now, held = None, []
    for batch in batches:
        for bucket, chunk, kind, hashes, counts in zip(*(c.to_pylist() for c in batch.columns)):
            if (bucket, kind) != now and held:
                yield close(now[1], now[0], held)
                held = []
            now = (bucket, kind)
            held.append((chunk, hashes, counts))
    if held:
        yield close(now[1], now[0], held)


def _bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for a context that was not seen, then one for each power of two."""
    return np.minimum(np.frexp(context.astype(float))[1], CONTEXTS - 1)


def _group(contexts: list[np.ndarray]) -> np.ndarray:
    """The bucket of the longest context that was seen; contexts come by length, from one word on."""
    group = _bucket_of(contexts[0])
    for n, count in enumerate(contexts[1:], 1):
        group = np.where(count > 0, n * CONTEXTS + _bucket_of(count), group)
    return group


def _counted(row: dict, order: int) -> tuple[_Chunk, list[np.ndarray], list[np.ndarray]]:
    """A chunk, and for each token the counts of its n-grams and of their contexts, by length."""
    chunk = _Chunk(row, order)
    answer = lambda kind: np.concatenate(
        [_unpack(x["answer"], "<u8") for x in sorted(row["answers"], key=lambda x: x["bucket"]) if x["kind"] == kind]
    ).astype(np.int64)
    totals = [answer(kind) for kind in range(order)]
    counts = [total[at] for total, (_, at) in zip(totals, chunk.grams)]
    # A text's first word follows as many starts as there are ends.
    contexts = [chunk.after_start(count, totals[0][chunk.end]) for count in counts[:-1]]
    return chunk, counts, contexts


def _bin(p: np.ndarray) -> np.ndarray:
    """0 for nothing, else the bin of a probability."""
    out = np.zeros(len(p), np.int64)
    some = p > 0
    out[some] = np.clip(np.rint(-10 * np.log10(p[some])), 0, BINS - 2).astype(np.int64) + 1
    return out


def _histogram(total: int, order: int):
    """How many training tokens have which context bucket and left-out estimates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, int] = {}
        for row in _rows(batches):
            chunk, counts, contexts = _counted(row, order)
            counts, contexts = ([x[chunk.train] - 1 for x in xs] for xs in (counts, contexts))
            cell = _group(contexts)
            for count, context in zip(counts[:0:-1], contexts[::-1]):
                cell = cell * BINS + _bin(count / np.maximum(context, 1))
            cell = cell * BINS + _bin(counts[0] / max(total - 1, 1))
            for c, k in zip(*np.unique(cell, return_counts=True)):
                sums[int(c)] = sums.get(int(c), 0) + int(k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.int64())], names=["cell", "n"]
        )

    return run


def learn_weights(
    cells: np.ndarray, number: np.ndarray, uniform: float, rounds: int = 60, order: int = 2
) -> np.ndarray:
    """Weights of the estimates, from the longest n-gram to the word, and of the uniform one for each context bucket."""
    estimate = lambda b: np.where(b > 0, 10.0 ** (-(b - 1) / 10), 0.0)
    bucket = cells // BINS**order
    parts = np.stack(
        [estimate(cells // BINS**n % BINS) for n in range(order - 1, -1, -1)] + [np.full(len(cells), uniform)], 1
    )
    weights = np.tile([0.3] * (order - 1) + [0.9 - 0.3 * min(order - 1, 2), 0.1], ((order - 1) * CONTEXTS, 1))
    # A context that was not seen has no n-grams.
    for n in range(order - 1):
        weights[n * CONTEXTS : (n + 1) * CONTEXTS, : order - 2 - n] = 0
    weights[0] = [0] * (order - 1) + [0.9, 0.1]
    weights /= weights.sum(1, keepdims=True)
    for _ in range(rounds):
        share = parts * weights[bucket]
        share *= (number / share.sum(1))[:, None]
        for b in np.unique(bucket):
            weights[b] = share[bucket == b].sum(0) / number[bucket == b].sum()
    # No word may become impossible.
    weights[:, 2] = np.maximum(weights[:, 2], 1e-6)
    weights[0, : order - 1] = 0
    return weights / weights.sum(1, keepdims=True)


def _score(weights: np.ndarray, total: int, distinct: int, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            chunk, counts, contexts = _counted(row, order)
            w, word = weights[_group(contexts)], counts[0]
            p = w[:, order - 1] * word / max(total, 1) + w[:, order] / (distinct + 1)
            for n in range(1, order):
                p += w[:, order - 1 - n] * counts[n] / np.maximum(contexts[n - 1], 1)
            if not total:
                p = np.ones(len(word))
            base = np.log10((word + 0.1) / (total + 0.1 * (distinct + 1)))
            sums = lambda x: np.add.reduceat(x, chunk.first[:-1])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(chunk.ids, mask=chunk.nulls),
                    pa.array(chunk.held),
                    pa.array(chunk.sizes),
                    pa.array(sums((word > 0).astype(np.int64))),
                    pa.array(np.full(len(chunk.ids), total)),
                    pa.array(sums(base)),
                    pa.array(sums(np.log10(p))),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


def score_texts(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", order: int = 2
) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for each row.

    ``order`` is the length of the longest n-grams, two at least. Disk grows with it: nearly each triple of a chunk is
    one that the chunk has once.
    """
    if order < 2:
        raise ValueError("the longest n-grams have two words at least")
    spark = prepare(docs.sparkSession)
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    chunks = keep(texts.mapInArrow(_chunks, _CHUNK), "chunks")
    # A bucket gets about as many entries of each chunk, so its size follows the number of chunks.
    number = chunks.count()
    tasks = partitions(spark)
    buckets = max(4 * tasks, number // 4)
    # One length of n-grams after another, so that the shuffle of one is gone before the next one's is written.
    answers = reduce(
        DataFrame.union,
        [
            keep(
                chunks.mapInArrow(_ask(buckets, kind), "bucket int, chunk long, kind int, hashes binary, counts binary")
                .repartition(tasks, "bucket")
                .sortWithinPartitions("bucket")
                .mapInArrow(_answer, "chunk long, kind int, bucket int, answer binary, seen long, tokens long"),
                "answers",
            )
            for kind in range(order)
        ],
    )
    distinct, total = (x or 0 for x in answers.agg(F.sum("seen"), F.sum("tokens")).first())
    by_chunk = answers.groupBy("chunk").agg(F.collect_list(F.struct("kind", "bucket", "answer")).alias("answers"))
    counted = keep(chunks.join(by_chunk, "chunk"), "counted")
    cells = counted.mapInArrow(_histogram(total, order), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    weights = learn_weights(
        np.array([r["cell"] for r in cells], np.int64), np.array([r["n"] for r in cells], float), 1 / (distinct + 1),
        order=order,
    )
    return counted.mapInArrow(
        _score(weights, total, distinct, order),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
