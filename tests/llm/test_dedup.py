"""Suffix-array dedup and near-dedup against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from quarry.llm import near_dedup, suffix_dedup


def brute_spans(docs, length):
    """{doc_id: (n_bytes, n_removed, n_spans, sha256 of the rest)} by the definition."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs, key=lambda d: d[0]):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            if data[i:i + length] in seen:
                gone[i:i + length] = True
            seen.add(data[i:i + length])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        rest = bytes(np.frombuffer(data, np.uint8)[~gone]) if len(data) else b""
        out[doc_id] = (len(data), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest())
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    shared = [" ".join(word() for _ in range(rng.randint(20, 60))) for _ in range(4)]
    texts = []
    for _ in range(n):
        parts = [" ".join(word() for _ in range(rng.randint(0, 30)))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a, b = sorted((rng.randint(0, len(s)), rng.randint(0, len(s))))
            parts += [s[a:b], word()]
        texts.append(" ".join(parts))
    texts += [texts[0], texts[1], texts[2][:-3] + "zzz", "x" * 500, "x" * 350, "ab" * 200, "", None, "é" * 120, texts[3] + texts[3]]
    return list(enumerate(texts))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 7, 50, 301, 1000])
@pytest.mark.parametrize("letters", [1, 2, 5, 200])
def test_suffix_array(n, letters):
    s = np.random.default_rng(n * 7 + letters).integers(0, letters, n)
    assert suffix_dedup.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


@pytest.mark.parametrize(("length", "hot"), [(100, 2000), (100, 1), (40, 2)])
def test_repeats_equal_brute_force(make, length, hot):
    docs = corpus(length + hot)
    found = suffix_dedup.repeats(make(docs), length, "digest", hot_blocks=hot, batch_bytes=2000).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in found} == brute_spans(docs, length)


def test_repeats_null_id_repeated_rows_and_empty_table(make):
    long = " ".join(f"w{i}" for i in range(60))
    rows = suffix_dedup.repeats(make([(None, long), (5, long), (5, long), (6, "short")]), 100, "digest").collect()
    got = {(r["doc_id"], r["n_removed"]) for r in rows}
    assert got == {(None, 0), (5, len(long)), (6, 0)} and len(rows) == 4
    assert suffix_dedup.repeats(make([]), 100).count() == 0


def test_remove_keeps_columns_and_empty_documents(make):
    long = "é" + " ".join(f"w{i}" for i in range(60))
    docs = make([(1, long), (2, long), (3, "x" + long + "tail"), (4, ""), (5, None)])
    out = {r["doc_id"]: r for r in suffix_dedup.remove(docs).collect()}
    assert sorted(out) == [1, 3, 4, 5] and out[4]["text"] == "" and out[5]["text"] is None
    assert out[3]["text"] == "xtail" and out[3].asDict().keys() == dict.fromkeys(docs.columns).keys()


def brute_classes(docs, k=5, threshold=0.8):
    """Components of all pairs with multiset Jaccard of k-word shingles of at least ``threshold``."""
    def bag(text):
        w = re.findall(r"\w+", (text or "").lower())
        return Counter(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else Counter()
    bags = [(d, bag(t)) for d, t in docs]
    parent = {d: d for d, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, (d, a) in enumerate(bags):
        for e, b in bags[:i]:
            if a and b and sum((a & b).values()) / sum((a | b).values()) >= threshold:
                x, y = find(d), find(e)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d, _ in docs}


def near_corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    docs = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([8, 60, 150, 400]))]
        for _ in range(rng.randint(1, 8)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 60))):
                i = rng.randrange(len(w))
                w[i:i + rng.randint(0, 1)] = [word()] * rng.randint(0, 1)
            docs.append(" ".join(w))
    return list(enumerate([*docs, docs[0], docs[0].upper() + "!", "", None, "?!", "one two", "one two", "one two three"]))


@pytest.mark.parametrize("bound", [500, 3])
def test_near_duplicates_equal_brute_force(make, bound):
    docs = near_corpus(bound)
    rows = near_dedup.near_duplicates(make(docs), bound=bound).collect()
    assert {r["doc_id"]: r["class_id"] for r in rows} == brute_classes(docs)
    assert len(rows) == len(docs)


def template_pages(seed, edits, apart=3, n=40, size=200):
    """Pairs of pages of one template: pages of different pairs are 0.73 to 0.79 alike, those of a pair by ``edits`` changed words."""
    rng = np.random.default_rng(seed)
    base, docs = [f"w{i}" for i in range(size)], []
    for i in range(n):
        one = list(base)
        for at in rng.choice(np.arange(3, size // 7) * 7, apart, replace=False):
            one[at] = f"x{i}a{at}"
        two = list(one)
        for at in rng.choice(np.array([j for j in np.arange(3, size // 7) * 7 if one[j] == base[j]]), edits, replace=False):
            two[at] = f"y{i}a{at}"
        docs += [" ".join(one), " ".join(two)]
    return list(enumerate(docs))


def test_failed_claims_come_back(make):
    docs = template_pages(1, 3)
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(make(docs)).collect()} == brute_classes(docs)


def test_large_buckets_of_unlike_pages(make):
    docs = template_pages(2, 4)
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(make(docs), bound=10).collect()} == brute_classes(docs)


def test_links_that_look_weak_are_verified(make):
    docs = template_pages(3, 4, n=60)
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(make(docs)).collect()} == brute_classes(docs)


def test_no_table_holds_the_pairs_of_a_group(make, monkeypatch):
    """Pages of one template look alike and are not: what is written grows with the texts, not with their pairs."""
    docs, written, keep = template_pages(5, 4, n=100), {}, near_dedup.keep

    def counted(df, name):
        out = keep(df, name)
        written[name] = max(written.get(name, 0), out.count())
        return out
    monkeypatch.setattr(near_dedup, "keep", counted)
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(make(docs)).collect()} == brute_classes(docs)
    assert max(written.values()) <= 12 * len(docs)


@pytest.mark.parametrize("split", [False, True])
def test_blocks_unite_classes_with_one_link_each(split):
    docs = [t for _, t in template_pages(6, 2, apart=1, n=6)]  # all alike
    seqs = [near_dedup.shingles(t) for t in docs]
    block = lambda at: near_dedup.Block([10 + i for i in at], [10 + i for i in at], [[i, 7, 7] for i in at], [seqs[i] for i in at])
    blocks = [block(range(5)), block(range(5, 12))] if split else [block(range(12))]
    links = list(near_dedup.united(blocks, 1, 0.8))
    assert len(links) == 11 and all(s >= 0.8 and a != b for a, b, s in links)
    assert not list(near_dedup.united(blocks, 2, 0.8))  # all agree in table 1, where they have met


def test_buckets_of_the_same_texts_count_once(spark):
    parts = spark.createDataFrame([(1, [5, 8, 9, 1]), (2, [5, 8, 9, 2]), (3, [6, 8, 4, 3])], "doc_id long, parts array<long>")
    got = sorted((r["t"], r["doc_id"], r["size"]) for r in near_dedup._members(parts).collect())
    assert got == [(0, 1, 2), (0, 2, 2), (1, 1, 3), (1, 2, 3), (1, 3, 3)]


def test_near_duplicates_of_driver_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()} == brute_classes(rows)


def test_near_dedup_edge_cases(make):
    assert near_dedup.near_duplicates(make([])).count() == 0
    out = near_dedup.near_duplicates(make([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, None)])).collect()
    assert {(r["doc_id"], r["class_id"]) for r in out} == {(None, None), (3, None), (4, 4)}
    kept = near_dedup.deduplicate(make([(1, "a b c d e f"), (2, "A b, c d e f"), (3, "")])).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 3] and kept[0]["b"] == "b"


@pytest.mark.parametrize("seed", range(6))
def test_banded_alignment_equals_full_lcs(seed):
    rng = np.random.default_rng(seed)
    for _ in range(40):
        a = rng.integers(0, rng.choice([2, 5, 50]), rng.integers(1, 60)).astype(np.uint64)
        b = a.copy() if rng.random() < 0.7 else rng.integers(0, 5, rng.integers(1, 60)).astype(np.uint64)
        for _ in range(rng.integers(0, 6)):
            b = np.delete(b, rng.integers(len(b))) if len(b) > 1 and rng.random() < 0.5 else np.insert(b, rng.integers(len(b) + 1), 99)
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        m = table[-1, -1]
        sim = m / (len(a) + len(b) - m)
        got = near_dedup.aligned(a, b, 0.8)
        assert got == pytest.approx(sim) if sim >= 0.8 else got is None


def test_band_moves_through_long_sequences():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1000, 3000).tolist()
    b = list(a)
    for i in range(0, 3000, 40):
        b[i] = -1
    assert near_dedup._band_lcs(a, b, 200) == 3000 - 75
