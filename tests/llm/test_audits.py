"""Quality rules, source divergence and filter interactions against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from starmart.llm import divergence, filter_audit, quality_rules
from starmart.llm.sample import lowest

SPACE = re.compile(r"[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n int, rank int, part string, mask int, id long, step int"


def frame(spark, rows):
    """Rows ``(doc_id, text, lang, source)`` among columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, 1, 2, "x", 3, 4, 5) for r in rows], SCHEMA).repartition(3)


def split(text):
    return [w for w in SPACE.split(text or "") if w]


# --- filter interactions


def plain_audit(rows, labels):
    first = {}
    for i, text, *_ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    masks = []
    for i, text, lang, _ in rows:
        text, words = text or "", split(text)
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and i > first[text],
        }
        own = [x for x in labels if x[0] == i and i is not None]
        masks.append((lang or "", {k for k, v in fails.items() if v}, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = []
    for part in {m[0] for m in masks}:
        here = [m for m in masks if m[0] == part]
        grid = {}
        for order in permutations("ABCDE"):
            left = here
            for step, x in enumerate(order, 1):
                gone = [m for m in left if x in m[1]]
                left = [m for m in left if x not in m[1]]
                failing = sum(x in m[1] for m in here)
                grid["".join(order), step] = (
                    x, len(left), len(gone), failing - len(gone), sum(m[1] == {x} for m in here), sum(m[2] for m in gone), sum(m[3] for m in gone)
                )
        total = Counter()
        for x, _, gone, *_ in grid.values():
            total[x] += gone
        out += [(part, order, step, *row[1:], total[row[0]]) for (order, step), row in grid.items()]
    return sorted(out)


def test_filter_audit_same_as_removing_one_by_one(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["ab", "Cd", "EFG", "é", "x#", "h%i", "zz", " q"])
    texts = [rng.choice(["", " "]).join(["", " \t".join(word() if rng.random() < 0.6 else f"w{j}" for j in range(rng.choice([3, 99, 100, 130])))]) for _ in range(40)]
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", "", None]), "s") for i in range(120)]
    rows += [(None, texts[0], "en", "s"), (None, texts[0], "en", "s"), (7, rows[7][1], "de", "s"), (7, "other", "de", "s"), (8, None, "en", "s"), (-3, "", "fr", "s")]
    rows += [(300, "AB " * 40_000, "en", "s"), (301, "a", None, None)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 140, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit_filters(frame(spark, rows), marks)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r) for r in got.collect()) == plain_audit(rows, labels)
    assert filter_audit.audit_filters(frame(spark, rows).limit(0), marks).count() == 0
    none = filter_audit.audit_filters(frame(spark, rows), marks.limit(0)).agg({"good_lost": "max", "toxic_lost": "max"}).first()
    assert tuple(none) == (0, 0)


def test_ranks_are_those_of_sorted_orders():
    assert [filter_audit.rank(order) for order in sorted(filter_audit.ORDERS)] == list(range(120))
    for mask, step, _, _ in filter_audit.interval_ends():
        assert 1 <= mask < 32 and 1 <= step <= 5
    # What the running sums say of one mask is what each order says.
    for mask in range(32):
        sums = np.zeros((5, 120), int)
        for m, step, at, change in filter_audit.interval_ends():
            if m == mask:
                sums[step - 1, at] += change
        sums = sums.cumsum(1)
        for r, order in enumerate(filter_audit.ORDERS):
            hit = next((s for s, x in enumerate(order) if mask >> "ABCDE".index(x) & 1), None)
            assert [int(v) for v in sums[:, r]] == [int(s == hit) for s in range(5)]


# --- source divergence


def plain_divergence(rows, least, top):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(low))
        groups[lang].add(source)
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        v = len(kept)
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        all_of = Counter()
        for s in sources:
            all_of.update({t: counts[lang, s][t] for t in kept})
        p = lambda n, whole: 1 + 10**9 * (n + 2) // (whole + 2 * v)
        price = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(o, sum(price(p(counts[lang, s][t], total[s]), p(counts[lang, o][t], total[o])) for t in kept)) for o in sources if o != s]
            terms = []
            for t in kept:
                a, b = p(counts[lang, s][t], total[s]), p(all_of[t], sum(total.values()))
                if counts[lang, s][t] and a > b:
                    terms.append((t, price(a, b)))
            for part, found, most in (("pair", pairs, 10**9), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, n) for n, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_divergence_same_as_all_terms(spark, monkeypatch, small):
    if small:
        for name, value in (("BLOCK", 7), ("TILE", 2), ("PAIRS", 3), ("HELD", 20), ("PIECE", 16)):
            monkeypatch.setattr(divergence, name, value)
    rng = random.Random(3)
    words = [f"{'Ab' * (k % 3)}q{chr(97 + k % 26)}{'é' * (k % 2)}" for k in range(60)]
    rows = []
    for i in range(260):
        lang, source = rng.choice(["en", "en", "de", None, ""]), rng.choice(["s1", "s2", "é3", "", None, "s5", "s6"])
        own = words if source != "s1" else words[:30]
        rows.append((i, " 1-".join(rng.choice(own) for _ in range(rng.randint(0, 25))), lang, source))
    rows += [(1, None, "en", "bare"), (2, "x1y2z3", "fr", "a"), (2, "", "fr", "b"), (3, None, "it", "one"), rows[5], rows[5]]
    rows += [(9, "long " * 3_000 + "w" * 9_000, "en", "s1")]
    least = 10 if not small else 4
    got = divergence.source_divergence(frame(spark, rows), least=least)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == plain_divergence(rows, least, 10)
    assert divergence.source_divergence(frame(spark, rows).limit(0)).count() == 0


def test_trees_share_equal_parts_and_price_exactly():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 3, (5, 16)) * (rng.random((5, 16)) < 0.4)
    counts[:, 13:] = -1
    counts[3] = counts[2]
    whole = np.array([50, 70, 90, 90, 10**6])
    leaves, levels, roots = divergence.consed(counts)
    assert roots[2] == roots[3] and len(leaves) == len(np.unique(counts))
    pairs = np.stack(np.triu_indices(5, 1), 1)
    f = lambda a, wa, b, wb: (lambda p, q: (p - q) ** 2 // (p + q))(1 + 10**9 * (a + 2) // wa, 1 + 10**9 * (b + 2) // wb)
    for (i, j), value in zip(pairs, divergence.prices(counts, whole, pairs)):
        assert value == sum(f(int(a), int(whole[i]), int(b), int(whole[j])) for a, b in zip(counts[i], counts[j]) if a >= 0)
    # Beyond 64 bits.
    big = np.array([10**16, 5])
    assert list(divergence.shares(big, np.array([2 * 10**16, 10**17]))) == [1 + 10**9 * (10**16 + 2) // (2 * 10**16), 1 + 10**9 * 7 // 10**17]


# --- quality rules


def plain_base(text):
    text = text or ""
    words = split(text)
    lines = [x for x in text.split("\n") if split(x)]
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    covered = {i + k for places in windows.values() if len(places) > 1 for i in places for k in range(8)}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
        len(words) < 20 or 100 * len(covered) > 30 * len(words),
    )


def test_base_counts_same_as_plain(spark):
    rng = random.Random(8)
    rows = [(None, None, "en", "s"), (1, "", "en", "s"), (2, " \t\n\x0b", "en", "s"), (3, "a " * 9, "en", "s"), (4, "one\n\n \none\r\n one", "en", "s")]
    for i in range(60):
        words = [rng.choice(["a", "A", "é#", "漢字", "<b>", " x"]) for _ in range(rng.randint(1, 60))]
        rows.append((10 + i, "".join(w + rng.choice([" ", "  ", "\n", "\t"]) for w in words * rng.choice([1, 1, 2])), "en", "s"))
    rows += [rows[9], (500, "word " * 300_000, "en", "s"), (501, "x" * 1_200_000 + " y", "en", "s")]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_rules.quality_rules(frame(spark, rows), labels).collect()
    assert sorted(tuple(r)[:7] for r in got if r.doc_id is not None) == sorted((r[0], *plain_base(r[1])) for r in rows if r[0] is not None)
    assert all(r.kept == (not r.base_failed) and r.score == 0 for r in got)


def tokens(text):
    return re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0d]+", (text or "").encode())


def test_ratio_is_that_of_counted_n_grams(spark, monkeypatch):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(["the", "cat", "sat.", "on", "mats"]) + str(rng.randint(0, 9)) for _ in range(40))
    bad = lambda: " ".join(rng.choice(["BUY", "now!!", "$$$", "%%%", "on"]) + str(rng.randint(0, 9)) for _ in range(40))
    rows = [(i, good() if i % 3 else bad(), "en", "s") for i in range(240)] + [(900, None, "en", "s"), (901, "one", "en", "s")]
    marks = [(i, int(i % 3 > 0), int(i % 30 == 1)) for i in range(160)] + [(5, 1, 0), (6, None, 1), (None, 1, 0), (7777, 1, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    texts = docs.select(docs.doc_id.alias("id"), "text")
    rules = quality_rules.fit_rules(texts, labels)
    raw = quality_rules.bucket_counts(texts)
    # Every token once and every neighbouring pair, over all rows.
    plain = sum(len(t) + (len(t) - 1 if len(t) > 1 else len(t)) for t in (tokens(r[1]) for r in rows))
    assert raw.sum() == plain
    found = {r.doc_id: r for r in quality_rules.quality_rules(docs, labels).collect()}
    data = pa.array([r[1] for r in rows], pa.string())
    for i, (row, text) in enumerate(zip(rows, data)):
        where, _ = quality_rules.buckets_of(*quality_rules.text_buffer(data[i : i + 1]))
        score = sum(int(rules.weights[w]) for w in where) / quality_rules.UNIT / max(len(where), 1)
        assert found[row[0]].score == score
        assert found[row[0]].kept == (not found[row[0]].base_failed and score >= rules.least)
    assert all(found[i].kept == (i % 3 > 0) for i in range(240))


def test_threshold():
    assert quality_rules.threshold(np.array([1.0, 2, 3]), np.array([-1.0, 0])) == 0.5
    assert quality_rules.threshold(np.array([1.0, 2, 3]), np.array([5.0])) == -np.inf
    assert quality_rules.threshold(np.array([]), np.array([1.0])) == -np.inf
    assert quality_rules.threshold(np.arange(200.0), np.array([])) == 2.0


def test_least_score_is_the_threshold_of_all_scores(spark):
    rng = random.Random(5)
    pairs = [([1.0, 2, 3], [-1.0, 0]), ([1.0, 2, 3], [5.0]), ([], [1.0]), ([*np.arange(200.0)], []), ([], [])]
    pairs += [([rng.randint(5, 30) / 8 for _ in range(n)], [rng.randint(0, 20) / 8 for _ in range(n)]) for n in (7, 90)]
    for trusted, rejected in pairs:
        rows = [(float(x), False) for x in trusted] + [(float(x), True) for x in rejected]
        cuts = quality_rules.Cuts(spark.createDataFrame(rows, "score double, low boolean").repartition(5))
        assert quality_rules.least_score(cuts) == quality_rules.threshold(np.array(trusted), np.array(rejected))


def test_rules_are_learnt_from_all_labelled_rows(spark, monkeypatch):
    n, found, counted = 30_000, [], []
    cuts, count = quality_rules.Cuts, quality_rules.bucket_counts
    monkeypatch.setattr(quality_rules, "Cuts", lambda scores: found.append(cuts(scores)) or found[0])
    monkeypatch.setattr(quality_rules, "bucket_counts", lambda texts: counted.append(count(texts)) or counted[-1])
    texts = spark.range(n + 500).selectExpr("id", "concat('word', id % 7) AS text").union(spark.sql("SELECT 3L, 'a copy'"))
    labels = spark.range(n).selectExpr("id AS doc_id", "int(id % 3 > 0) AS quality", "0 AS toxic")
    quality_rules.fit_rules(texts, labels)
    # A text of one token has two n-grams; trusted texts either make the target or set the threshold.
    assert found[0].lows == n // 3 and found[0].highs + counted[0].sum() // 2 == n - n // 3
    assert counted[1].sum() == 2 * (n + 500) + 3


def test_lowest_takes_the_lowest_hashes(spark):
    df = spark.range(30_000).withColumnRenamed("id", "k")
    some = lowest(df, 1_000, "k")
    assert 990 <= some.count() <= 1_000
    worst = some.selectExpr("max(shiftrightunsigned(xxhash64(k), 4)) AS h").first().h
    assert df.filter(f"shiftrightunsigned(xxhash64(k), 4) < {worst}").count() < 1_000
    assert lowest(df, 10**6, "k").count() == 30_000
    assert lowest(df.limit(0), 5, "k").count() == 0
    assert hashlib.md5(str(sorted(r.k for r in some.collect())).encode()).digest() == hashlib.md5(str(sorted(r.k for r in lowest(df.repartition(7), 1_000, "k").collect())).encode()).digest()
