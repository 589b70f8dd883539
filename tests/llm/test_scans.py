"""Licence scans, decontamination and the pipeline against brute force."""

import re
from collections import Counter

import corpus_pipeline
from quarry.llm import decontaminate, licenses


def test_license_scan_folds_spelling_case_punctuation_and_copyright_lines(make):
    mit = licenses.KNOWN[0][1]
    variant = "Copyright (c) 2020 Someone\n" + mit.upper().replace("SUBLICENSE", "sub-licence").replace('"', "'")
    docs = [(1, mit), (2, variant), (3, "intro\n\nReleased under the MIT Licence!\nmore"), (4, ""), (5, None), (6, mit[:-30]), (7, "x " * 100_000),
            (8, "text before\n\n" + licenses.KNOWN[9][1].replace("\n\n", "\n") + "\n\nafter"), (9, "Licensed under the Apache License, version 2.0"),
            (None, "Released under the MIT License."), (11, "a"), (11, "Licensed under CC BY-NC 4.0.")]
    out = {r["doc_id"]: r for r in licenses.scan(make(docs)).collect()}
    assert len(out) == 11 and out[1]["license"] == out[2]["license"] == "MIT" and out[1]["text_digest"] == out[2]["text_digest"]
    assert out[3]["license"] is None and out[3]["part_licenses"] == ["MIT"] and out[3]["n_parts"] == 1
    assert out[4]["text_digest"] == out[5]["text_digest"] and out[4]["license"] is None
    assert out[6]["license"] is None and out[8]["part_licenses"] == ["Apache-2.0"] and out[9]["license"] == "Apache-2.0"
    assert out[None]["license"] == "MIT" and out[11]["part_licenses"] == ["CC-BY-NC-4.0"]
    assert licenses.scan(make([])).count() == 0


def brute_matches(docs, items, k=5, threshold=0.8):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    bag = lambda w: Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    weight = lambda c: sum(n * sum(map(len, s)) for s, n in c.items())
    out = {}
    for d, t in docs:
        w = words(t)
        own = bag(w)
        for item, u in items:
            iw = words(u)
            if len(iw) < k:
                continue
            b = bag(iw)
            if not own.keys() & b.keys():
                continue
            best = None
            for at in range(len(w) - len(iw) + 1):
                a = bag(w[at:at + len(iw)])
                s = weight(a & b) / weight(a | b)
                if s >= threshold and (best is None or s > best[0] + 1e-12):
                    best = (s, at)
            if best:
                out[d, item] = best
    return out


def check(found, want):
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["start_word"]) for r in found.collect()}
    assert got.keys() == want.keys()
    for key, (s, at) in want.items():
        assert abs(got[key][0] - s) < 1e-9 and got[key][1] == at


def test_decontamination_equals_brute_force(spark, make, sf):
    item = " ".join(f"word{i}" for i in range(40))
    edited = item.split()
    edited[38] = "other"
    items = [(1, item), (2, item.upper()), (3, "too few words"), (4, None), (5, "a b a b a b a b a b a b"), (None, "seven more words in this item here")]
    docs = [(10, "start " + item + " end"), (11, "Word0, " + " ".join(edited)), (12, " ".join(edited[:20])), (13, None), (14, ""), (15, "a b " * 400),
            (16, item + " " + item), (17, "so seven more words in this item here"), (17, "so seven more words in this item here"), (18, "clean " * 2000)]
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, words string")
    check(decontaminate.matches(make(docs), bench), brute_matches(docs, items))
    kept = decontaminate.decontaminate(make(docs), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [12, 13, 14, 18] and kept.columns == make(docs).columns
    assert decontaminate.matches(make([]), bench).count() == 0
    assert decontaminate.matches(make(docs), bench.limit(0)).count() == 0


def test_decontamination_of_shortened_and_reordered_items(spark, make):
    w = [f"word{i}" for i in range(100)]
    items, half = [(1, " ".join(w))], w[50:] + w[:50]
    docs = [(20, " ".join(["so", *half, "end"])), (21, " ".join(half)), (22, " ".join(["a", *w[:30], "b", *w[30:]]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    check(decontaminate.matches(make(docs), bench), brute_matches(docs, items))
    short = [(30, " ".join(w[:-1])), (31, " ".join(w[3:-2])), (32, " ".join(w[:50])), (33, " ".join(half[1:]))]
    got = {r["doc_id"]: (r["start_word"], r["n_words"], r["similarity"]) for r in decontaminate.matches(make(short), bench).collect()}
    whole = lambda d: brute_matches([(0, d)], [(1, " ".join(w))])
    assert got.keys() == {30, 31, 33} and [got[i][:2] for i in (30, 31, 33)] == [(0, 99), (0, 95), (0, 99)] and not whole(short[0][1])
    size = lambda x: sum(sum(map(len, x[i:i + 5])) for i in range(len(x) - 4))
    assert abs(got[30][2] - size(w[:-1]) / size(w)) < 1e-9 and abs(got[31][2] - size(w[3:-2]) / size(w)) < 1e-9


def test_decontamination_of_driver_rows(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    check(decontaminate.matches(docs, bench), brute_matches(texts, items))


def test_pipeline_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, sf)
        path = f"{spark.sparkContext.getCheckpointDir()}/test-stage-{i}-{id(made)}"
        made.write.parquet(path)
        docs = spark.read.parquet(path)
        counts.append(docs.select("doc_id").distinct().count())
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert counts[1] < counts[0] and counts[2] < counts[1] and counts[4] < counts[3] and counts[5] == counts[4] and counts[5] > counts[0] / 2


def test_pipeline_runs_on_an_empty_table(spark, sf, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
