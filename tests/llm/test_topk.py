from __future__ import annotations

import random

import pytest

from starmart.llm import topk

SCHEMA = "id long, terms array<long>, weights array<long>, grp string"


def plain(rows, queries, k):
    out = []
    for q, qt, qw in {(q, tuple(t), tuple(w)) for q, t, w in queries if q is not None}:
        own = dict(zip(qt, qw))
        scores = [(-sum(own.get(t, 0) * w for t, w in zip(ts, ws)), i) for i, ts, ws in rows if i is not None and i != q]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_same_as_all_scores(spark, monkeypatch, small):
    rng = random.Random(9)
    rows = []
    for i in range(300):
        terms = sorted(rng.sample(range(30), rng.randint(0, 12)))
        rows.append((i, terms, [rng.randint(-3, 3) or 1 for _ in terms]))
    rows += [(7, rows[7][1], rows[7][2]), (9, rows[3][1], rows[3][2]), (None, [1], [1]), (400, [], [])]
    queries = [r for r in rows if r[0] is None or r[0] % 20 == 0]
    frame = lambda some: spark.createDataFrame([r + ("g",) for r in some], SCHEMA).repartition(3)
    if small:
        for name, value in (("GROUP", 16), ("BLOCK", 4), ("PACK", 4), ("SHEET", 3), ("SHEET_BYTES", 4000), ("CELLS", 150)):
            monkeypatch.setattr(topk, name, value)
    got = sorted(tuple(r) for r in topk.top_k(frame(rows), frame(queries), 5).collect())
    assert got == plain(rows, queries, 5)


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(1, [1], [2], ""), (2, [1], [3], "")], SCHEMA)
    assert [tuple(r) for r in topk.top_k(df, df.filter("id = 1"), 5).collect()] == [(1, 1, 2, 6)]
    assert topk.top_k(df.limit(0), df.limit(0), 5).count() == 0
    assert topk.top_k(df.filter("id = 1"), df.filter("id = 1"), 5).count() == 0
    with pytest.raises(ValueError):
        topk.top_k(df, df, 0)


def test_units_are_bounded_by_rows_and_cells():
    import pyarrow as pa

    rows = [(k, list(range(k % 5, k % 5 + 1 + k % 9))) for k in range(60)] + [(60, list(range(500))), (61, [])]
    batch = pa.RecordBatch.from_pylist([{"id": i, "terms": t, "weights": [1] * len(t)} for i, t in rows])
    units = list(topk._rows([batch.slice(0, 25), batch.slice(25)], 8, 60))
    assert [(i, list(t)) for ids, terms, _ in units for i, t in zip(ids, terms)] == rows
    for ids, terms, _ in units:
        assert len(ids) <= 8
        assert len(ids) == 1 or len(ids) * len({x for t in terms for x in t}) <= 60
