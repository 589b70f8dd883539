"""Relative Lempel-Ziv dedup against brute force over all windows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from quarry.llm import queries, rlz_dedup


def plain(rows, length):
    docs = [(i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t in rows]
    seen = Counter(tuple(w[s:s + length]) for _, w in docs for s in range(len(w) - length + 1))
    out = []
    for i, w in docs:
        gone = set()
        for s in range(len(w) - length + 1):
            if seen[tuple(w[s:s + length])] > 1:
                gone |= set(range(s, s + length))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((-1 if i is None else i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def collected(df):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect())


def corpus(rng, letters, docs=40):
    """Random texts, passages that many share with different neighbours, periodic texts and copies."""
    words = [f"w{i}" for i in range(letters)]
    shared = [rng.choices(words, k=rng.randint(5, 30)) for _ in range(5)]
    out = []
    for i in range(docs):
        text = rng.choices(words, k=rng.randint(0, 40))
        for _ in range(rng.randint(0, 3)):
            at, passage = rng.randint(0, len(text)), rng.choice(shared)
            text[at:at] = passage[rng.randint(0, 3):]
        if rng.random() < 0.1:
            text = (text[:3] or ["x"]) * 12
        out.append((i, rng.choice([" ", "\n", " \t\x0b"]).join(text)))
    return out + [(100 + i, t) for i, t in out[:4]]


@pytest.mark.parametrize("length,group,letters", [(4, 1, 3), (4, 2000, 3), (6, 2, 20), (9, 1, 4), (12, 1, 200), (12, 2000, 200)])
def test_repeats_equal_brute_force(make, length, group, letters):
    rows = corpus(random.Random(length * 100 + group + letters), letters)
    want = plain(rows, length)
    assert any(0 < r for _, _, r, _ in want)
    assert collected(rlz_dedup.repeats(make(rows), length, "digest", group_blocks=group, batch_bytes=300)) == want


def test_large_group_is_divided(make, monkeypatch):
    """One passage in every document between other neighbours: its edges are groups of as many blocks as documents."""
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(i, f"{' '.join(str(rng.random()) for _ in range(40))} {passage} {' '.join(str(rng.random()) for _ in range(40))}") for i in range(120)]
    rows += [(500, passage + " x"), (501, " ".join(f"p{i}" for i in range(34)) + " other words")]
    levels = []
    divide = rlz_dedup._divide
    monkeypatch.setattr(rlz_dedup, "_divide", lambda p, n, hashes: levels.append(hashes) or divide(p, n, hashes))
    got = collected(rlz_dedup.repeats(make(rows), 35, "digest", group_blocks=20))
    assert got == plain(rows, 35) and levels and {r for i, _, r, _ in got if i < 501} == {50}


def test_query_equals_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = collected(queries.QUERIES["op13_rlz"](spark, sf))
    assert got == plain(docs, 35) and any(r for _, _, r, _ in got)


def test_edges(make):
    some = " ".join(f"a{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, some), (None, some + " end"), (None, "start " + some), (6, "one two three"), (7, "x " * 5000), (8, "y z  " * 34),
            (9, "s t u"), (9, some[:20] + " other"), (10, "q " * 35), (11, " ".join(map(str, range(100)))), (11, " ".join(map(str, range(100)))), (12, " ".join(map(str, range(20_000, 60_000))))]
    assert collected(rlz_dedup.repeats(make(rows), 35, "digest")) == plain(rows, 35)
    assert rlz_dedup.repeats(make([]), 35, "digest").count() == 0
    spans = {r["doc_id"]: [(s["a"], s["b"]) for s in r["spans"]] for r in rlz_dedup.repeats(make(rows)).collect()}
    assert spans[4] == [(0, 60)] and spans[12] == [] and spans[7] == [(0, 5000)] and spans[10] == []
    texts = {r["doc_id"]: r["text"] for r in rlz_dedup.repeats(make(rows), result="text").collect()}
    assert texts[6] == "one two three" and texts[4] == "" and texts[1] == ""


def test_longest_factors_equal_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(30):
        pieces = [[b"%d" % v for v in rng.integers(0, 3, rng.integers(4, 20))] for _ in range(rng.integers(1, 8))]
        at = [(i, s) for i, p in enumerate(pieces) for s in range(len(p) - 3)]

        def common(x, y):
            a, b = pieces[x[0]][x[1]:], pieces[y[0]][y[1]:]
            return next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))

        want = [max((common(x, y) for y in at if y != x), default=0) for x in at]
        assert rlz_dedup.longest_factors(pieces, 4)[1].tolist() == want
