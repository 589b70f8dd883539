"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quarry.llm import queries, spelling


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(rows, least_n=3, least_size=5):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if c >= least_n and len(w) >= least_size}
    slots = {}
    for w in n:  # words one edit apart share a word with one deletion, or are one
        for x in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            slots.setdefault(x, set()).add(w)
    near = {w: set() for w in n}
    for group in slots.values():
        for w in group:
            near[w] |= {v for v in group if one_edit(v, w)}
    form = {}
    for w, around in near.items():
        best = min(around, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def collected(df):
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_equals_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = collected(queries.QUERIES["op11_spelling"](spark, sf))
    assert got == plain(docs) and any(f for f, *_ in got.values()) and any(r not in (w, f) for w, (f, r, *_) in got.items())


@pytest.mark.parametrize("symbols", [1, 2, 6])
def test_variants_equal_brute_force(make, symbols):
    rng = random.Random(symbols)
    words = ["".join(rng.choices("abcÀéÿ×", k=rng.randint(3, 8))) for _ in range(60)]
    words += [w[:2] + rng.choice("abxé") + w[rng.randint(2, 3):] for w in words]
    weights = [1.5 ** -(i % 20) for i in range(len(words))]
    rows = [(i, rng.choice(["", "12 "]) + "-".join(rng.choices(words, weights, k=200)).upper().lower().replace("a", rng.choice("aA"))) for i in range(60)]
    assert collected(spelling.variants(make(rows), symbols=symbols)) == plain(rows)


def test_edges(make):
    long = "x" * 3000
    rows = [(1, None), (2, ""), (3, "! 1 _ ² ŉ"), (None, "colour colour color"), (None, "color"), (5, "COLOR color. colour's"), (5, "COLOR color. colour's"),
            (6, f"{long} {long} {long} {long}y {long}y {long}y " * 2), (7, f"{long} " * 20), (8, "abcd abcd abcd abcde abcde abcde"), (9, "straße Straße STRAßE straÿe straÿe straÿe")]
    got = collected(spelling.variants(make(rows)))
    assert got == plain(rows) and got["color"][3] == 1 and got[long][3] == 1 and "abcd" not in got
    assert spelling.variants(make([])).count() == 0
    assert spelling.variants(make(rows[:3])).count() == 0


def test_keys_are_those_of_the_reduced_words():
    """Neighbour keys are the own keys of the words they stand for, each once."""
    rng = np.random.default_rng(3)
    for symbols in (2, 3):
        for size in (2, 5):
            d = rng.integers(1, symbols + 1, (20, size)).astype(np.uint64)
            row, key = spelling.neighbour_keys(d, symbols)
            for i, digits in enumerate(d.tolist()):
                made = {tuple(digits[:j] + digits[j + 1:]) for j in range(size)}
                made |= {tuple(digits[:j] + [c] + digits[j + 1:]) for j in range(size) for c in range(digits[j] + 1, symbols + 1)}
                want = sorted(int(spelling.own_keys(np.array([w], np.uint64))[0]) for w in made)
                assert sorted(key[row == i].tolist()) == want
