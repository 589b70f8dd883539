"""Packing, token files, WARC and top-k: exact round trips and brute force."""

import random
import zlib

import numpy as np
import pytest

from quarry.llm import files, packing, token_files, tokens, topk, warc

BYTES, WORDS = "byte_bpe_50k.json", "word_bpe_49k.json"


def plain_ids(name, text):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokens.public(name))
    tok.encode_special_tokens = True
    return np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], np.uint32)


@pytest.mark.parametrize("name", [BYTES, WORDS])
def test_encoder_gives_the_tokenizers_ids(name):
    rng = random.Random(5)
    settled = [chr(c) for c in [*range(0x250), *range(0x2010, 0x2028), *range(0x20a0, 0x20c0)] if not 0x1c <= c <= 0x1f]
    odd = ["漢", "😀", "　", " ", "\x1d", "Σ", "İ", "é", "<|endoftext|>", "'s", "'LL", "  ", "\r\n", "ing", " the"]
    texts = ["".join(rng.choices(settled, k=rng.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(rng.choices(odd + [" ", "a", "3", "."], k=rng.randint(0, 30))) for _ in range(1500)]
    texts += ["", "a" * 3000, " " * 2000, "ab " * 5000]
    enc = tokens.Encoder(tokens.public(name))
    assert enc.fast is not None
    want = [plain_ids_fast(enc, t) for t in texts]
    assert enc.encode(texts) == want
    assert enc._encode_words(texts) == want  # the way for other files and characters


def plain_ids_fast(enc, text):
    return np.array([*enc.tok.encode(text, add_special_tokens=False).ids, 1], np.uint32).tobytes()


DOCS = [(4, "the cat sat on the mat"), (2, "word " * 5000), (7, ""), (9, None), (1, "A b c. " * 700), (3, "x"), (3, "x"), (None, "no id"), (12, "漢字 and more")]


def test_packing_round_trip(make):
    rows = packing.pack(make(DOCS), tokens.public(BYTES), with_ids=True)
    got = [r.asDict() for r in rows.collect()]
    want = sorted((i if i is not None else -1, plain_ids(BYTES, t).tolist()) for i, t in DOCS)
    whole = {}
    for r in sorted(got, key=lambda r: (r["doc_id"] or -1, r["start"])):
        ids = np.array(r["ids"]).astype(np.uint32)
        assert len(ids) == r["length"] and zlib.crc32(ids.tobytes()) == r["ids_crc32"]
        whole.setdefault((r["doc_id"] if r["doc_id"] is not None else -1), []).extend(ids.tolist())
    assert {d: v for d, v in whole.items()} == {d: [x for e, ids in want if e == d for x in ids] for d, _ in want}
    for s in {r["sequence_id"] for r in got}:
        at = 0
        for r in sorted((r for r in got if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    for r in packing.sequences(rows).collect():
        n = r["n_tokens"]
        assert len(r["ids"]) == (n if n & (n - 1) == 0 else 2048)
    assert packing.pack(make([]), tokens.public(BYTES)).count() == 0


def test_plan_holds_every_piece_with_little_padding():
    rng = np.random.default_rng(2)
    counts = {int(s): int(n) for s, n in zip(*np.unique(np.minimum(256, rng.geometric(0.01, 20_000)), return_counts=True), strict=True)}
    patterns = packing.plan(counts, 256)
    held = {}
    for p, n in patterns:
        assert sum(s * c for s, c in p.items()) <= 256
        for s, c in p.items():
            held[s] = held.get(s, 0) + c * n
    assert held == counts
    used, room = sum(s * n for s, n in counts.items()), 256 * sum(n for _, n in patterns)
    assert used / room > 0.98


def test_inverse_by_elimination():
    a = np.random.default_rng(4).integers(0, 9, (40, 40)) + np.diag([0, *range(1, 40)])
    a[0, 0] = 0  # the first pivot must come from another row
    assert np.allclose((packing.inverted(a)[:, :, None] * a[None]).sum(1), np.eye(40), atol=1e-8)


def test_linear_program_after_a_spark_job(spark):
    """Over 1,000 steps, with their fresh inverses, beside a session that has run a job."""
    assert spark.range(1000).groupBy("id").count().count() == 1000
    rng = np.random.default_rng(7)
    sizes = np.sort(rng.choice(np.arange(16, 512), 240, replace=False))
    demand = rng.integers(1000, 100_000, len(sizes)).astype(float)
    steps = 0
    best = packing.best_pattern

    def counted(*args):
        nonlocal steps
        steps += 1
        return best(*args)

    packing.best_pattern = counted
    try:
        used = packing.column_generation(sizes, demand, 512, gap=0)
    finally:
        packing.best_pattern = best
    held = sum(p * n for p, n in used)
    assert steps > 1000 and (held > demand * (1 - 1e-6)).all()


def test_knapsack_equals_enumeration():
    sizes, price = np.array([3, 5, 7]), np.array([0.31, 0.55, 0.7])
    best = max(0.31 * a + 0.55 * b + 0.7 * c for a in range(8) for b in range(5) for c in range(4) if 3 * a + 5 * b + 7 * c <= 23)
    worth, pattern = packing.best_pattern(price, sizes, 23)
    assert worth == pytest.approx(best) and pattern @ sizes <= 23 and pattern @ price == pytest.approx(worth)


def test_token_files_round_trip(spark, make):
    docs = [d for d in DOCS if d[0] is not None]
    folder = files.new_folder(spark, "tokens")
    manifest = token_files.write(make(docs), tokens.public(WORDS), folder, shard_bytes=500)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read(manifest, folder).collect())
    want, at = [], 0
    for i, t in sorted(docs, key=lambda d: (d[0], d[1] or "")):
        ids = plain_ids(WORDS, t)
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    dictionary = files.read(f"{folder}/dictionary")
    for r in manifest.collect():
        shard = token_files.Shard(r["path"], dictionary)
        assert [shard.document(i) for i in range(r["doc_count"])] == [x[2] for x in shard.documents()]
        with pytest.raises(ValueError):
            token_files.Shard(r["path"], dictionary + b"x")
    empty = files.new_folder(spark, "tokens")
    assert token_files.read(token_files.write(make([]), tokens.public(WORDS), empty), empty).count() == 0


def brute_warc(pages, min_bytes=0):
    data = [(i, (h or "").encode()) for i, h in pages]
    first = {}
    for i, b in data:
        first[b] = min(first.get(b, i), i)
    return sorted((i, len(b), warc.payload_digest(b), "response" if first[b] == i or len(b) < min_bytes else "revisit",
                   None if first[b] == i or len(b) < min_bytes else first[b]) for i, b in data)


@pytest.mark.parametrize("min_bytes", [0, 3])
def test_warc_round_trip_with_magic_in_payloads(spark, min_bytes):
    trap = warc.page_record(99, "http://x", b"inner", warc.payload_digest(b"inner"), None).decode()
    pages = [(5, "<p>a</p>"), (3, "<p>a</p>"), (8, None), (9, ""), (10, trap), (11, trap * 3 + "é"), (12, "WARC/1.1\r\n" * 50), (13, "x" * 9000), (14, "\r\n\r\n"), (15, trap), (15, trap), (16, "<p>a</p>"), (16, trap)]
    df = spark.createDataFrame([(i, "http://h/ \r\n" if i % 2 else None, h, "zz", 1) for i, h in pages], "page_id long, url string, html string, digest string, size int")
    for split in (100, 700, 4_000_000):
        out = warc.read(warc.write(df, files.new_folder(spark, "warc"), min_bytes, file_bytes=3000), split_bytes=split).collect()
        assert sorted(tuple(r) for r in out) == brute_warc(pages, min_bytes)
    assert warc.read(warc.write(df.limit(0), files.new_folder(spark, "warc"))).count() == 0


def test_warc_long_urls_and_broken_chains(spark):
    pages = [(1, "u" * 200_000, "<p>a</p>"), (2, "http://h/", "b"), (3, "\x01" * 70_000, "c"), (4, "WARC/1.1", "d" * 100_000), (5, "x: " * 50_000, "<p>a</p>"), (6, None, "e")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    archives = warc.write(df, files.new_folder(spark, "warc"))
    for split in (30_000, 4_000_000):
        assert sorted(tuple(r) for r in warc.read(archives, split_bytes=split).collect()) == brute_warc([(i, h) for i, _, h in pages])
    with pytest.raises(ValueError, match="chain"):
        warc.read(archives.selectExpr("path", "size - 1 AS size"))


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 1, 8).astype(np.float32).tolist()) for i in range(300)]
    rows += [(400 + i, rows[7][1]) for i in range(40)] + [(500, None), (501, [1.0, None] + [0.0] * 6), (502, [float("nan")] * 8),
                                                         (600, [float("inf")] * 8), (700, [1.0, 2.0]), (701, [3.0, 4.0]), (702, []), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, i) for i, v in rows], "vec_id long, embedding array<float>, label long")
    from pyspark.sql import functions as F
    got = sorted(tuple(r) for r in topk.search(df, F.col("vec_id") % 100 == 0, query_block=3, cell_block=50).collect())
    ok = {i: [int(np.floor(1024 * float(np.float32(x)))) for x in v] for i, v in rows
          if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q, a in ok.items():
        if q % 100 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in ok.items() if i != q and len(a) == len(b))
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:10])]
    assert got == sorted(want)
    assert topk.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("first,grid", [(1, 1), (3, 2), (None, 4)])
def test_topk_reads_exact_vectors_in_bound_order(spark, monkeypatch, first, grid):
    """Vectors are read by falling bound and no further than needed: fewer than the bounds alone would let through."""
    from pyspark.sql import functions as F
    rng = np.random.default_rng(6)
    base = np.abs(rng.normal(0, 1, (400, 4)))
    base[5::20] = -400.0  # far vectors make cells wide, and bounds loose
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "vec_id long, embedding array<double>")
    held = {}
    kept = topk.keep
    monkeypatch.setattr(topk, "keep", lambda t, name: held.setdefault(name, []).append(kept(t, name)) or held[name][-1])
    got = sorted(tuple(r) for r in topk.search(df, F.col("vec_id") % 100 == 0, k=3, query_block=2, cell_block=60, grid=grid, first=first).collect())
    v = np.floor(1024 * base).astype(np.int64)
    want = []
    for q in range(0, 400, 100):
        scored = sorted((-int(v[q] @ v[i]), i) for i in range(400) if i != q)
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:3])]
    assert got == sorted(want)
    bounds = {(r["query_id"], r["vec_id"]): r["upper"] for r in held["va-hopeful"][0].collect()}
    rounds = [[(r["query_id"], r["vec_id"]) for r in t.collect()] for t in held["va-read"]]
    read = [x for r in rounds for x in r]
    assert len(read) == len(set(read)) and set(read) <= set(bounds)
    for q in range(0, 400, 100):  # each round reads lower bounds than the one before, and what is left can't matter
        tops = [[bounds[x] for x in r if x[0] == q] for r in rounds]
        tops = [t for t in tops if t]
        assert all(min(a) >= max(b) for a, b in zip(tops, tops[1:], strict=False))
        kth = [s for qq, r, _, s in got if qq == q and r == 3][0]
        assert all(u < kth for (qq, i), u in bounds.items() if qq == q and (qq, i) not in set(read))
    if first == 1:
        assert len(rounds) > 1 and len(read) < len(bounds)
