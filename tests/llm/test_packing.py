from __future__ import annotations

import random
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from starmart.llm.packing import pack, plan
from starmart.llm.token_files import document_ids, read_tokens, write_tokens
from starmart.llm.tokens import Encoder
import starmart.llm.token_files as token_files
import starmart.llm.tokens as tokens

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
SCHEMA = "doc_id long, text string, part int, ids string"
WHOLE = Tokenizer.from_file(PATH)
TEXTS = [
    "The, quick BROWN fox!", None, "", " \n\t", "don't 12 stop… é É é Σς İ", "<|endoftext|> <|ENDOFTEXT|>",
    "word " * 3000, "x" * 5000, "a\x1cb\x85c\xa0d　e", "same", "same", "中文 한국 🙂 ǅ ª",
]


def expected(text, end):
    return WHOLE.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, "x") for i, t in rows], SCHEMA).repartition(4)


def test_ids_of_words_are_those_of_texts(monkeypatch):
    monkeypatch.setattr(tokens, "SEGMENT", 64)
    rng = random.Random(4)
    bits = ["a", "B", "é", "É", "é", "Σ", "İ", "ß", "1", "²", "'s", "’", ".", ",", "<|", "<|endoftext|>", "\x1c", "\xa0",
            "中", "한", "ᄀ", "🙂", "\x00", "\t", "\n", " ", " ", "don't", "Xyz", "!!", "$$$"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    encoder = Encoder(PATH)
    for text in texts:
        assert encoder.ids(text.encode()) == np.array(WHOLE.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("capacity,top", [(100, 100), (10, 10), (2048, 2048), (2048, 300)])
def test_plan_is_gapless_and_as_good_as_best_fit(capacity, top):
    rng = random.Random(capacity + top)
    for _ in range(8):
        counts = Counter(
            min(capacity, max(1, int(rng.paretovariate(0.7) * top / 20))) for _ in range(rng.randint(1, 2000))
        )
        sequences, got = defaultdict(list), Counter()
        for run in plan(counts, capacity):
            got[run.length] += run.count
            for k in range(run.count):
                sequences[run.sequence + k // run.each].append((run.offset + k % run.each * run.length, run.length))
        assert got == counts
        for pieces in sequences.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= capacity
        rooms: list[int] = []
        for length in sorted(counts.elements(), reverse=True):
            i = bisect_left(rooms, length)
            insort(rooms, (rooms.pop(i) if i < len(rooms) else capacity) - length)
        assert len(sequences) <= len(rooms) + 1


def test_pack(spark):
    rows = list(enumerate(TEXTS)) + [(None, "no id"), (9, "same"), (9, "same")]
    got = [tuple(r) for r in pack(frame(spark, rows), PATH, 0, 512).collect()]
    want = []
    for doc, text in rows:
        ids = expected(text, 0)
        for k in range(0, len(ids), 512):
            want.append((doc, k // 512, k, len(ids[k : k + 512]), crc(ids[k : k + 512])))
    assert sorted((r[:5] for r in got), key=str) == sorted(want, key=str)
    sequences = defaultdict(list)
    for r in got:
        sequences[r[5]].append((r[6], r[3]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 512
    assert len(sequences) == -(-sum(r[3] for r in got) // 512)
    assert pack(frame(spark, []), PATH, 0).count() == 0
    with pytest.raises(ValueError):
        pack(frame(spark, []), PATH, 0, 0)


def test_files_round_trip(spark, tmp_path):
    rows = [(3 * i, t) for i, t in enumerate(TEXTS)] + [(6, "again"), (None, "no id")]
    folder = str(tmp_path / "tokens")
    parts = write_tokens(frame(spark, rows), folder, PATH, end_id=1, vocabulary=49_408)
    got = sorted((tuple(r) for r in read_tokens(parts, folder, 49_408).collect()), key=lambda r: r[1])
    start = 0
    for doc, at, n, _ in got:
        assert at == start
        start += n
    order = [r[0] for r in got]
    assert order[0] is None and order[1:] == sorted(order[1:])
    want = [(d, len(expected(t, 1)), crc(expected(t, 1))) for d, t in rows]
    assert sorted(((r[0], r[2], r[3]) for r in got), key=str) == sorted(want, key=str)
    for part, docs, _, _ in parts.collect():
        for place in range(docs):
            assert document_ids(folder, part, place, 49_408)[-1] == 1
    empty = str(tmp_path / "none")
    assert read_tokens(write_tokens(frame(spark, []), empty, PATH, 1), empty).count() == 0


def test_rows_without_or_of_one_id_fill_many_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "PART_BYTES", 400)
    rows = [(None, f"no id {k % 7}") for k in range(200)] + [(5, "the same words")] * 150 + [(k, f"text {k}") for k in range(90)]
    rows += [(40, "long " * 300), (41, None)]
    folder = str(tmp_path / "tokens")
    parts = write_tokens(frame(spark, rows), folder, PATH, end_id=1, vocabulary=49_408)
    table = {r["part"]: r for r in parts.collect()}
    got = sorted((tuple(r) for r in read_tokens(parts, folder, 49_408).collect()), key=lambda r: r[1])
    ids = [r[0] for r in got]
    assert ids == sorted(ids, key=lambda x: -1 if x is None else x)
    assert [r[1] for r in got] == list(np.cumsum([0] + [r[2] for r in got])[:-1])
    want = [(d, len(expected(t, 1)), crc(expected(t, 1))) for d, t in rows]
    assert sorted(((r[0], r[2], r[3]) for r in got), key=str) == sorted(want, key=str)
    # These texts have fewer ids, the end included, than bytes.
    assert all(r["tokens"] <= 400 or r["docs"] == 1 for r in table.values())
    starts = {p: r["base"] for p, r in table.items()}
    hot = {max(p for p, b in starts.items() if b <= r[1]) for r in got if r[0] == 5}
    assert len(hot) > 3 and sum(r["docs"] for r in table.values()) == len(rows)


def test_files_of_rows_from_files(spark, tmp_path):
    """Numbered by their place in the files, and the same ids in the same order whichever way the rows lie."""
    rows = [(k % 9 if k % 4 else None, TEXTS[k % len(TEXTS)]) for k in range(300)]
    found = []
    for n in (3, 11):
        path = str(tmp_path / f"docs{n}")
        frame(spark, rows).repartition(n).write.parquet(path)
        folder = str(tmp_path / f"tokens{n}")
        parts = write_tokens(spark.read.parquet(path), folder, PATH, end_id=1, vocabulary=49_408)
        found.append(sorted((tuple(r) for r in read_tokens(parts, folder, 49_408).collect()), key=lambda r: r[1]))
    assert found[0] == found[1] and len(found[0]) == 300
