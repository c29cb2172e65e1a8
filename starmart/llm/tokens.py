"""Token ids of whole texts by the tokenizers library, a word at a time from a cache.

The tokenizer must lower its text, drop white space and keep letters apart from other
characters, as word-level byte pair encoders do. Then a text's ids are those of its words,
and a word that was seen before costs a lookup. A word of letters, perhaps with
some common punctuation after it, needs no normalising and no pattern matching and
goes straight to the tokenizer's model; any other word goes through the whole tokenizer.
"""

from __future__ import annotations

import unicodedata
from array import array
from collections.abc import Iterator
from functools import cache

import pyarrow as pa

from starmart.llm.words import text_buffer

#: Words kept by one worker; beyond it the cache starts anew.
CACHE_WORDS = 400_000
#: Bytes of one text that are split at a time.
SEGMENT = 1 << 20
_AFTER = b".,;:!?#$%&*"


def _byte_letters() -> dict[int, str]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class _Words(dict):
    """Ids of words, as little-endian unsigned 32-bit integers; learned when first asked for."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._letters = _byte_letters()

    def _whole(self, word: bytes) -> bytes:
        found = self._tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False)
        return array("I", found.ids).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        core = word.rstrip(_AFTER)
        if core.isalpha():
            piece = core.decode().lower()
        else:
            text = core.decode("utf-8", "replace")
            if not text.isalpha() or not _is_plain(text):
                self[word] = ids = self._whole(word)
                return ids
            piece = text.lower().encode().decode("latin-1").translate(self._letters)
        ids = array("I", [t.id for t in self._model.tokenize(piece)]).tobytes()
        if len(core) < len(word):
            tail = word[len(core) :]
            if tail not in self:
                self[tail] = self._whole(tail)
            ids += self[tail]
        self[word] = ids
        return ids


class Encoder:
    def __init__(self, path: str):
        self._known = _Words(path)

    def ids(self, text: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if b"<|" not in text:
            # Upper case would name no special token, lower case might.
            text = text.lower()
        if len(self._known) > CACHE_WORDS:
            self._known.clear()
        known = self._known.__getitem__
        if len(text) <= SEGMENT:
            return b"".join(map(known, text.split()))
        return b"".join(b"".join(map(known, text[at:to].split())) for at, to in _segments(text))

    def batch(self, texts: pa.Array) -> Iterator[bytes]:
        data, offsets = text_buffer(texts)
        for at, to in zip(offsets, offsets[1:]):
            yield self.ids(data[at:to].tobytes())


@cache
def encoder(path: str) -> Encoder:
    """The worker's encoder, kept from task to task with the words that it knows."""
    return Encoder(path)


def _is_plain(text: str) -> bool:
    """Letters whose lower case is one letter each, whatever stands beside them."""
    low = text.lower()
    if len(low) != len(text) or "Σ" in text:
        return False
    # Below the combining marks every letter is in its composed form.
    return max(text) < "\u0300" or unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low)


def _segments(text: bytes) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(text):
        to = at + SEGMENT
        while to < len(text) and not text[to : to + 1].isspace():
            to += 1
        yield at, min(to, len(text))
        at = to
