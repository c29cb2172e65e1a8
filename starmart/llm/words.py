"""Words and shingles of many texts at once, as 64-bit hashes in numpy arrays.

A word is a run of bytes outside ``\\x20`` and ``\\x09-\\x0D``; ``A-Z`` count as ``a-z``.
Texts are read from Arrow's own buffers, so no Python string is made for them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are hashed at a time; bounds the working arrays, not the texts.
SLICE = 1 << 19

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finaliser of splitmix64)."""
    x = np.asarray(x, _U)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    fold = np.arange(256)
    fold[65:91] += 32
    return space, mix(fold.astype(_U) * _BASE + _BASE)


_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE + 1)
        inverse = pow(int(_BASE), -1, 1 << 64)
        _powers[:] = []
        for base in (int(_BASE), inverse):
            row = np.full(size, base, _U)
            row[0] = 1
            _powers.append(np.multiply.accumulate(row))
    return _powers[0], _powers[1]


@dataclass
class Words:
    """Hashes of all words in order; those of text i are ``first[i]:first[i + 1]``.

    ``start`` and ``end`` are their byte places in ``data``, that of text i begins at
    ``offsets[i]``.
    """

    data: np.ndarray
    offsets: np.ndarray
    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.first[i] : self.first[i + 1]]

    def word(self, k: int) -> bytes:
        return self.data[self.start[k] : self.end[k]].tobytes()


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an array of strings and where each begins; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _slices(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cut the bytes where a text or a word ends."""
    space, _ = _tables()
    at, total = 0, len(data)
    while at < total:
        to = min(at + SLICE, total)
        if to < total:
            text = int(offsets[np.searchsorted(offsets, to, "right") - 1])
            if text > at:
                to = text
            else:
                blank = np.flatnonzero(space[data[at:to]])
                while not len(blank) and to < total:
                    step = min(to + SLICE, total)
                    blank = np.flatnonzero(space[data[to:step]]) + (to - at)
                    to = step
                after = int(offsets[np.searchsorted(offsets, at, "right")])
                to = min(at + int(blank[-1]) + 1 if len(blank) else to, after)
        yield at, to
        at = to


def words(texts: pa.Array) -> Words:
    data, offsets = text_buffer(texts)
    space, value = _tables()
    hashes, starts, ends = [], [], []
    for at, to in _slices(data, offsets):
        part = data[at:to]
        blank = space[part]
        begins = np.empty(len(part) + 1, bool)
        begins[0] = begins[-1] = True
        begins[1:-1] = blank[:-1]
        inner = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to)] - at
        begins[inner] = True
        start = np.flatnonzero(begins[:-1] & ~blank)
        stops = np.append(blank, True)
        stops[inner] = True
        # The end is the first blank or text border after the start.
        last = np.flatnonzero((stops[1:] | begins[1:]) & ~blank) + 1
        up, down = _power(len(part) + 1)
        sums = np.zeros(len(part) + 1, _U)
        np.cumsum(value[part] * up[: len(part)], out=sums[1:])
        hashes.append(mix((sums[last] - sums[start]) * down[start] + (last - start).astype(_U)))
        starts.append(start + at)
        ends.append(last + at)
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    start = join(starts, np.int64)
    return Words(
        data, offsets, join(hashes, _U), start, join(ends, np.int64), np.searchsorted(start, offsets)
    )


@cache
def _weights(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=_U) * _BASE) | _U(1)


def shingles(found: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words, and where those of each text begin.

    A text of one to n - 1 words has its whole sequence as its only shingle.
    """
    h, first = found.hashes, found.first
    w = _weights(n)
    size = np.diff(first)
    out_first = np.concatenate([[0], np.cumsum(np.where(size >= n, size - n + 1, size > 0))])
    run = np.zeros(max(len(h) - n + 1, 0), _U)
    for k in range(n):
        run += h[k : k + len(run)] * w[k]
    valid = np.ones(len(h), bool)
    # The last n - 1 words of a text begin no run.
    for k in range(1, n):
        last = first[1:] - k
        valid[last[last >= first[:-1]]] = False
    out = np.empty(out_first[-1], _U)
    long = np.repeat(size >= n, np.diff(out_first))
    out[long] = run[np.flatnonzero(valid)]
    for i in np.flatnonzero((size > 0) & (size < n)):
        seq = h[first[i] : first[i + 1]]
        out[out_first[i]] = (seq * w[: len(seq)]).sum(dtype=_U) + _U(len(seq))
    return mix(out), out_first
