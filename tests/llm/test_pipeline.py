from __future__ import annotations

import random

import corpus_pipeline


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(11)
    text = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    key = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    # A third of the good documents hold a secret, so that secrets say nothing of quality.
    rows = [(i, text(30) + (f' token = "{key}" ' if i % 3 == 2 else " ") + text(9) + ".") for i in range(60)] + [(i, " | ".join(text(40).split()) + " |") for i in range(60, 90)]
    rows += [(200, rows[3][1]), (201, rows[3][1].upper()), (202, rows[3][1]), (200, rows[3][1])]
    item = text(30)
    rows += [(300, text(9) + " " + item + ".")]
    rows += [(400, None), (401, ""), (None, text(40) + ".")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i < 60), 0) for i in range(90)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.keep(stage(spark, docs, str(tmp_path)), "test")
        seen[name] = docs.collect()
    ids = {name: sorted((r.doc_id for r in found), key=str) for name, found in seen.items()}
    assert not set(range(60, 90)) & set(ids["quality classifier"]) and set(range(60)) <= set(ids["quality classifier"])
    assert not {200, 201, 202} & set(ids["n-gram Jaccard join"]) and set(range(60)) <= set(ids["n-gram Jaccard join"])
    assert 300 not in ids["benchmark decontamination"] and set(range(60)) <= set(ids["benchmark decontamination"])
    clean = {r.doc_id: r for r in seen["secret scans"]}
    assert not any(key in (r.text or "") for r in clean.values())
    assert clean[2].n_chars == len(clean[2].text) and clean[1].text == rows[1][1]
    assert ids["secret scans"] == ids["benchmark decontamination"]
    assert {r.doc_id for r in seen["best-fit packing"]} == set(ids["secret scans"])


def test_each_row_is_judged_by_its_own_text(spark, tmp_path):
    rng = random.Random(12)
    text = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    junk = lambda: " | ".join(text(40).split()) + " |"
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    item = text(30)
    save = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    save([(i, int(i < 60), 0) for i in range(90)], "doc_id long, quality int, toxic int", "labels")
    save([(1, item)], "item_id long, text string", "benchmark")

    def run(stage, rows):
        docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        out = stage(spark, docs.repartition(3), str(tmp_path))
        assert out.columns == docs.columns
        return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)

    good = [(i, text(40) + ".") for i in range(60)]
    bad = [(i, junk()) for i in range(60, 90)]
    kept = run(corpus_pipeline.good_quality, good + bad + [(None, junk()), (500, junk()), (500, good[1][1]), (None, good[2][1])])
    assert kept == sorted(good + [(500, good[1][1]), (None, good[2][1])], key=str)
    a, b, c = good[3][1], good[4][1], good[5][1]
    kept = run(corpus_pipeline.one_of_each_group, [(3, a), (None, a), (None, a.upper()), (7, a), (7, b), (9, c), (9, c), (None, b.upper()), (8, ""), (8, ""), (None, "")])
    assert kept == sorted([(3, a), (7, b), (9, c), (8, ""), (None, "")], key=str)
    dirty = text(9) + " " + item
    kept = run(corpus_pipeline.free_of_benchmarks, [(None, dirty), (1, dirty), (1, a), (None, b)])
    assert kept == sorted([(1, a), (None, b)], key=str)
    keys = [key() for _ in range(20)]
    found = run(corpus_pipeline.without_secrets, [(None, f'some token = "{k}" and more') for k in keys] + [(1, "card 1234567890123456 here")])
    assert len(found) == 21 and not any(k in t for _, t in found for k in keys)


def test_empty_table_and_columns_of_any_name(spark, tmp_path):
    rng = random.Random(13)
    text = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    save = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    save([(i, int(i < 20), 0) for i in range(30)], "doc_id long, quality int, toxic int", "labels")
    save([(1, text(30))], "item_id long, text string", "benchmark")
    schema = "doc_id long, text string, _row string, row int, file string, number int, id long, nths int, n int, a string, at int, _metadata string"
    rows = [(i, text(40) + "." if i < 20 else " | ".join(text(40).split()) + " |", "x", 1, "f", 2, 3, 4, 5, "b", 6, "m") for i in range(30)]
    rows += [(None, None, None, None, None, None, None, None, None, None, None, None), (40, text(9) + ' token = "9f8e7d6c5b4a39281706f5e4d3c2b1a098765432" ' + text(9) + ".", "x", 1, "f", 2, 3, 4, 5, "b", 6, "m")]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/full")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none")
    for name in ("full", "none"):
        first = docs = spark.read.parquet(f"{tmp_path}/{name}")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.keep(stage(spark, docs, str(tmp_path)), "test")
            assert docs.columns == first.columns
        assert {tuple(r)[2:] for r in docs.collect()} <= {r[2:] for r in rows}
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert (packed.count() > 0) == (name == "full")
