"""Toxicity and language: held-out accuracy, defined edge cases, marginals against brute force."""

import itertools
import zlib

import numpy as np

from quarry.llm import langid, queries, toxicity


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(3)
    lengths = np.array([3, 1, 5, 2])
    gap, trans, start = rng.normal(0, 1, lengths.sum()), rng.normal(0, 1, (2, 2)), 0.3
    p, bwd = toxicity.Lockstep(lengths).run(gap, start, trans)
    at = 0
    edges = np.zeros((2, 2))
    for n in lengths:
        total, mass, pair = 0.0, np.zeros(n), np.zeros((2, 2))
        for s in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(start * s[0] + sum(gap[at + i] * s[i] for i in range(n)) + sum(trans[s[i], s[i + 1]] for i in range(n - 1)))
            total += w
            mass += w * np.array(s)
            for i in range(n - 1):
                pair[s[i], s[i + 1]] += w
        assert np.allclose(p[at:at + n], mass / total)
        edges += pair / total
        at += n
    assert np.allclose(toxicity.Lockstep(lengths).edges(gap, bwd, p, trans), edges)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.QUERIES["op8_toxicity"](spark, sf).collect()
    assert len(rows) == 1000
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([a == b for a, b in held]) > 0.93
    assert np.mean([b for a, b in held if a]) > 0.9  # clean documents are left alone


def test_toxicity_edges(spark, make):
    toxic = [(i, "the fool is a vilewretch here. and more words") for i in range(40)]
    clean = [(i, f"a fine day {i} for a walk. and more words") for i in range(40, 200)]
    docs = make([*toxic, *clean, (300, None), (301, ""), (302, "VILEWRETCH! " + "nice words. " * 20_000), (None, "x"), (303, "clean"), (303, "clean")])
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(i, 0) for i in range(40, 200)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    out = toxicity.score(docs, model).collect()
    by = {r["doc_id"]: r for r in out}
    assert len(out) == 206 and by[3]["predicted"] == 1 and by[50]["predicted"] == 0 and by[300]["predicted"] == 0
    assert by[300]["score"] == by[301]["score"]
    text = toxic[0][1]
    assert any("vilewretch" in text[s["start"]:s["end"]] for s in by[3]["spans"]) and by[302]["spans"][0]["start"] == 0
    kept = toxicity.reject(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {50, 300, 301, 303, None}
    assert toxicity.score(make([]), toxicity.train(make([]), labels)).count() == 0


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES["op4_language"](spark, sf).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 1000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.98


def test_language_edges(spark):
    rows = [(i, "the cat and the dog", "en") for i in range(30)] + [(i, "der hund und die katze", "de") for i in range(30, 60)]
    rows += [(100, None, "en"), (101, "", "de"), (102, "123 !?", "en"), (105, "² ½ ① ³ Ⅳ", "en"), (103, "der hund und " * 50_000, None), (None, "the dog", "en"), (104, "the cat", None), (104, "the cat", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "'x' as rejected")
    out = langid.predict(docs, langid.train(docs)).collect()
    by = {r["doc_id"]: r for r in out}
    assert len(out) == len(rows) and [by[i]["lang_pred"] for i in (100, 101, 102, 105)] == ["und"] * 4 and by[100]["score"] == 0
    assert by[103]["lang_pred"] == "de" and by[104]["lang_pred"] == "en" and by[None]["lang_pred"] == "en"
    none = langid.predict(docs.limit(0), langid.train(docs.limit(0)))
    assert none.count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, langid.train(docs.limit(0))).collect()} == {"und"}
