from __future__ import annotations

import random

import numpy as np
import pytest

from starmart.llm import ngram_join
from starmart.llm.ngram_join import link_bitmaps, link_sets, ngram_classes

SCHEMA = "doc_id long, text string, a int, unit string"


def brute(rows, words, percent):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        grams = [tuple(w[i : i + words]) for i in range(len(w) - words + 1)]
        sets.append(set(grams) if len(w) >= words else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), doc), doc)
    links = [
        sum(j != i and bool(a) and 100 * len(a & b) >= percent * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)
    ]
    return sorted((doc, len(sets[i]), low[find(i)], links[i]) for i, (doc, _) in enumerate(rows))


def near_copies(seed, families=25, copies=9, most=160):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(55)]
    texts = []
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, most))]
        if rng.random() < 0.4:
            base += passage
        for _ in range(rng.randint(1, copies)):
            words = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4, 8])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
    rng.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)]


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA).repartition(5)
    return sorted(tuple(r) for r in ngram_classes(df, **options).collect())


@pytest.mark.parametrize("words,percent", [(4, 85), (5, 80), (1, 60)])
def test_same_as_all_pairs(spark, words, percent):
    rows = near_copies(words)
    assert run(spark, rows, words=words, percent=percent) == brute(rows, words, percent)


def test_without_counts(spark):
    rows = near_copies(9)
    assert run(spark, rows, words=4, percent=85, count_links=False) == [r[:3] for r in brute(rows, 4, 85)]


def test_forty_bits_round_trip():
    numbers = np.array([0, 1, (1 << 40) - 1, 123456789012], np.uint64)
    assert (ngram_join.unpack(ngram_join.pack(numbers)) == numbers).all()
    assert len(ngram_join.unpack(ngram_join.pack(numbers[:0]))) == 0


def test_cut_clusters_give_the_same(spark, monkeypatch):
    rows = near_copies(7, families=6, copies=30, most=60)
    with monkeypatch.context() as m:
        m.setattr(ngram_join, "TILE_ROWS", 4)
        assert run(spark, rows, words=4, percent=85) == brute(rows, 4, 85)


def test_cut_clusters_of_several_bands_give_the_same(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{rng.randrange(300)}" for _ in range(140)]
    texts = [" ".join(base[: 140 - 3 * i] + [f"x{i}"] * (i % 2)) for i in range(30)]
    rows = list(enumerate(texts))
    with monkeypatch.context() as m:
        m.setattr(ngram_join, "TILE_ROWS", 2)
        got = run(spark, rows, words=4, percent=85)
    assert got == brute(rows, 4, 85)


def test_texts_that_only_share_a_passage_are_not_moved(spark, monkeypatch):
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(30)]
    texts = [[f"w{rng.randrange(10**6)}" for _ in range(90)] + passage for _ in range(150)]
    texts += [[*t[:40], "x", *t[41:]] for t in texts[:10]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    seen = []
    units = ngram_join._units
    monkeypatch.setattr(ngram_join, "_units", lambda members, *most: seen.append(members.select("rep").distinct().count()) or units(members, *most))
    assert run(spark, rows, words=5, percent=80) == brute(rows, 5, 80)
    assert seen[0] > 60 and seen[-1] == 20


def test_bitmaps_of_cut_clusters_give_the_same(spark, monkeypatch):
    rng = random.Random(6)
    base = [f"w{rng.randrange(300)}" for _ in range(300)]
    # Sizes from 120 to 297, whose bitmaps are of 256 and 512 bits.
    texts = [" ".join(base[: 297 - 3 * i] + [f"x{i}"] * (i % 2)) for i in range(60)]
    rows = list(enumerate(texts))
    want = brute(rows, 4, 85)
    with monkeypatch.context() as m:
        m.setattr(ngram_join, "BITMAP_ROWS", 3)
        assert run(spark, rows, words=4, percent=85) == want
        assert run(spark, rows, words=4, percent=85, count_links=False) == [r[:3] for r in want]


def test_bitmaps_let_every_link_through():
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 1 << 63, 700).astype(np.uint64) * 2)
    sets = [np.unique(np.concatenate([rng.choice(base, int(rng.integers(300, 690)), replace=False), rng.integers(0, 1 << 63, 9).astype(np.uint64)])) for _ in range(60)]
    maps = [ngram_join.bitmap(s, 1024) for s in sets]
    assert all((ngram_join.folded(m.tobytes(), 512) == ngram_join.bitmap(s, 512)).all() for m, s in zip(maps, sets))
    size, own = np.array([len(s) for s in sets]), np.ones(60, int)
    for side in (None, np.arange(60) % 2):
        links, _ = link_sets(sets, 80, side)
        group = list(range(60))
        for i, j in link_bitmaps(size, np.stack(maps).view(np.uint64), 80, own, side):
            assert side is None or side[i] != side[j]
            group = [group[i] if g == group[j] else g for g in group]
        assert links and all(group[i] == group[j] for i, j in links)


def test_awkward_rows(spark):
    same = "One two\tTHREE four\nfive six"
    rows = [(5, None), (6, ""), (7, " \n\x0b"), (8, "one"), (9, "ONE"), (9, "ONE"), (3, same), (2, same.lower()),
            (4, "é" * 3000 + " " + "word " * 3000), (1, "one two"), (1, "another text under the same id"), (11, "One two three four five\x1csix")]
    got = run(spark, rows, words=4, percent=85)
    assert got == brute(rows, 4, 85)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert ngram_classes(df).columns == ["doc_id", "n_shingles", "component_id", "n_links"]
    assert ngram_classes(df).count() == 0


def test_null_id_and_bad_parameters(spark):
    df = spark.createDataFrame([(None, "a b c d e", 1, ""), (4, "a b c d e", 1, ""), (None, "x", 1, "")], SCHEMA)
    got = {(r[0], r[2]) for r in ngram_classes(df).collect()}
    assert got == {(None, 4), (4, 4), (None, None)}
    with pytest.raises(ValueError):
        ngram_classes(df, percent=0)


def test_keys_meet_for_every_linked_pair():
    rng = np.random.default_rng(3)
    low = ngram_join.bands(85)
    for _ in range(400):
        n = int(rng.integers(6, 400))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * 2)
        lost = int(rng.integers(0, 15 * n // 185 + 1))
        b = np.unique(np.concatenate([a[lost:], rng.integers(0, 1 << 63, lost).astype(np.uint64)]))
        linked = len(link_sets([a, b], 85)[0]) == 1
        shared = np.intersect1d(a, b).size
        assert linked == (100 * shared >= 85 * (len(a) + len(b) - shared))
        if linked and not np.array_equal(a, b):
            band = int(np.searchsorted(low, min(len(a), len(b)), "right")) - 1
            keys = [dict(ngram_join.keys_of(x, 85, low))[band] for x in (a, b)]
            assert np.intersect1d(*keys).size
