"""Near-duplicate classes by Order MinHash, verified by banded alignment.

Texts become sequences of five-word shingles. A sketch takes, under one hash
order, the ``width`` smallest occurrence-labelled shingles of a text and keeps
them in text order; texts that agree in any of ``tables`` sketches share a
bucket. With similarity s a sketch agrees with probability of about s**width,
so the defaults miss a pair at 0.8 with probability 0.488 per table, to the
power of 12: about 2 in 10,000. Similarity is that of an alignment: with m
shingles matched in order, m / (n_a + n_b - m); the longest common subsequence
is computed exactly inside the band that the threshold allows.

Exact copies (same words) collapse first. Then texts of a bucket take turns as
leaders, and each claims the unclaimed texts that look like it by a bottom-48
sample of shingles; a bucket of more than ``bound`` texts does so in parts, and
the leaders of its parts meet again in further rounds. Claims are verified, and
verified links joined to classes: that unites most of a group with a few pairs
a text. A claim settles nothing by itself. Afterwards the texts of every bucket
that still holds several classes meet, block against block where it is large.
A task has the texts of its two blocks at hand and compares every pair of
unlike classes: the shingles both have bound the similarity from above, and
pairs that reach the threshold are aligned, the likeliest first, except those
that came into one class meanwhile. So a task gives at most one link for each
class that it unites, and no list of pairs is ever made. There is no cap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import keep, map_batches, mix64, null_id, with_id
from quarry.llm.components import components

WORD = re.compile(r"\w+")
#: Size of the sample of smallest shingle hashes that says how alike two texts look.
SAMPLE = 48
#: Mean number of shingles a text up to which blocks are cut by the number of texts alone.
MEAN_SHINGLES = 2000


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def shingles(text: str, k: int = 5) -> np.ndarray:
    """64-bit hashes of all runs of ``k`` words; of all words if there are fewer; empty without words."""
    return shingle_hashes(words(text), k)


def shingle_hashes(w: list[str], k: int) -> np.ndarray:
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    k = min(k, len(w))
    out = np.zeros(len(w) - k + 1, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + mix64(h[j:len(h) - k + 1 + j] + np.uint64(j))
    return mix64(out)


def label_occurrences(h: np.ndarray) -> np.ndarray:
    """Make equal shingles of a text different: the n-th occurrence of a shingle gets a hash of its own."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.empty(len(s), bool)
    new[:1] = True
    new[1:] = s[1:] != s[:-1]
    if new.all():
        return h
    first = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    nth = np.empty(len(s), np.uint64)
    nth[order] = (np.arange(len(s)) - first).astype(np.uint64)
    return mix64(h + nth * np.uint64(0xC2B2AE3D27D4EB4F))


def sketch(h: np.ndarray, tables: int, width: int) -> tuple[list[int], bytes]:
    """``tables`` order sketches as signed 64-bit numbers; the bottom sample as 32-bit ones."""
    labelled = label_occurrences(h)
    seeds = mix64(np.arange(1, tables + 1, dtype=np.uint64))[:, None]
    v = (labelled[None, :] ^ seeds) * (mix64(seeds) | np.uint64(1))
    v ^= v >> np.uint64(32)
    n = len(h)
    at = np.sort(np.argpartition(v, width - 1, axis=1)[:, :width], axis=1) if n > width else np.broadcast_to(np.arange(n), (tables, n))
    acc = seeds[:, 0].copy()
    for j in range(at.shape[1]):
        acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + h[at[:, j]])
    low = (labelled >> np.uint64(32)).astype(np.uint32)
    low = np.sort(np.partition(low, SAMPLE - 1)[:SAMPLE] if n > SAMPLE else low)
    return acc.view(np.int64).tolist(), low.tobytes()


def likeness(one: np.ndarray, n_one: int, many: np.ndarray, n_many: np.ndarray) -> np.ndarray:
    """Estimated similarity of one text's sample to each row of ``many`` (padded with 2**32); 0 where lengths rule out 0.8.

    The samples are compared up to the smaller of their largest values; a text
    of at most SAMPLE shingles has all of them in its sample.
    """
    full = 2**32
    limit = np.minimum(one[-1] if n_one > SAMPLE else full, np.where(n_many > SAMPLE, many[:, -1], full))[:, None]
    in_many = (many <= limit) & (many < full)
    at = np.minimum(np.searchsorted(one, many), len(one) - 1)
    both = (in_many & (one[at] == many)).sum(1)
    total = np.searchsorted(one, limit[:, 0], side="right") + in_many.sum(1) - both
    return np.where(np.minimum(n_many, n_one) * 5 >= np.maximum(n_many, n_one) * 4 - 4, both / np.maximum(total, 1), 0.0)


def _matrix(samples: list[bytes]) -> np.ndarray:
    out = np.full((len(samples), SAMPLE), 2**32, np.int64)
    for i, s in enumerate(samples):
        v = np.frombuffer(s, np.uint32)
        out[i, :len(v)] = v
    return out


def lead(ids: np.ndarray, n: np.ndarray, samples: np.ndarray, threshold: float) -> Iterator[tuple[int, int | None]]:
    """Claims (text, leader) of one part of a bucket, and its leaders as (leader, None)."""
    free = np.ones(len(ids), bool)
    for c in range(len(ids)):
        if not free[c]:
            continue
        free[c] = False
        yield int(ids[c]), None
        rest = np.flatnonzero(free)
        like = likeness(samples[c][samples[c] < 2**32], int(n[c]), samples[rest], n[rest])
        for m in rest[like >= threshold]:
            free[m] = False
            yield int(ids[m]), int(ids[c])


class Block:
    """Texts of a block: ids, labels of their classes, rows of sketches, sequences of shingles and, as numbers, the occurrences of these."""

    def __init__(self, ids: list[int], labels: list[int], sketches: list[list[int]], seqs: list[np.ndarray]):
        self.ids, self.labels, self.sketches, self.seqs = ids, np.array(labels), np.array(sketches), seqs
        self.n = np.array([len(x) for x in seqs])
        self.terms: list[np.ndarray] = []


def number_terms(blocks: list[Block]) -> int:
    """Number the occurrence-labelled shingles of all blocks that more than one text has; the others of a text match nothing."""
    labelled = [label_occurrences(x) for b in blocks for x in b.seqs]
    _, at, count = np.unique(np.concatenate(labelled), return_inverse=True, return_counts=True)
    parts = iter(np.split(at, np.cumsum([len(x) for x in labelled])[:-1]))
    for b in blocks:
        b.terms = [p[count[p] > 1] for _, p in zip(b.seqs, parts)]  # noqa: B905  one part for each text of the block
    return len(count)


def united(blocks: list[Block], table: int, threshold: float) -> Iterator[tuple[int, int, float]]:
    """Links (text, text, similarity) that unite classes of two blocks, or inside one.

    All pairs of unlike labels are compared that agree in ``table`` and in no table
    before it, where they would have met already. Two texts can't match more shingles
    in order than they share; only pairs whose shared ones reach the threshold are aligned.
    """
    left, right = blocks[0], blocks[-1]
    marked = np.zeros(number_terms(blocks), bool)
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x
    for c in range(len(left.ids)):
        start = c + 1 if left is right else 0
        meet = (right.labels[start:] != left.labels[c]) & (np.minimum(right.n[start:], left.n[c]) >= threshold * np.maximum(right.n[start:], left.n[c]) - 1e-9)
        others = np.flatnonzero(meet) + start
        if len(others):
            others = others[(right.sketches[others] == left.sketches[c]).argmax(1) == table]
        if not len(others):
            continue
        marked[left.terms[c]] = True
        theirs = [right.terms[o] for o in others]
        whose = np.repeat(np.arange(len(others)), [len(x) for x in theirs])
        shared = np.bincount(whose[marked[np.concatenate(theirs)]], minlength=len(others))
        marked[left.terms[c]] = False
        most = shared / (left.n[c] + right.n[others] - shared)
        for i in np.argsort(-most, kind="stable"):
            if most[i] < threshold - 1e-12:
                break
            o = others[i]
            x, y = find(int(left.labels[c])), find(int(right.labels[o]))
            if x != y and (sim := aligned(left.seqs[c], right.seqs[o], threshold)) is not None:
                parent[max(x, y)] = min(x, y)
                yield int(left.ids[c]), int(right.ids[o]), sim


def aligned(a: np.ndarray, b: np.ndarray, threshold: float) -> float | None:
    """Similarity m / (n_a + n_b - m) of the best alignment, or None if it is below ``threshold``.

    At the threshold at most d = (n_a + n_b) (1 - 2 t / (1 + t)) shingles are
    unmatched, so an alignment that reaches it never leaves the diagonals
    -d..d. The longest common subsequence inside this band is found bit-parallel:
    one integer of 2 d + 1 + step bits holds the band's row.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return None
    need = int(np.ceil(threshold * (n + m) / (1 + threshold) - 1e-9))
    if min(n, m) < need:
        return None
    low = 0  # what both share at the start and end is matched in some best alignment
    while low < min(n, m) and a[low] == b[low]:
        step = 1
        while low + step <= min(n, m) and np.array_equal(a[low:low + step], b[low:low + step]):
            low, step = low + step, step * 2
    tail = 0
    while tail < min(n, m) - low and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    x, y = a[low:n - tail], b[low:m - tail]
    common = low + tail
    if len(x) and len(y) and common < need + 1:
        ux, cx = np.unique(x, return_counts=True)
        uy, cy = np.unique(y, return_counts=True)
        _, ix, iy = np.intersect1d(ux, uy, assume_unique=True, return_indices=True)
        if common + int(np.minimum(cx[ix], cy[iy]).sum()) < need:
            return None
    common += _band_lcs(x.tolist(), y.tolist(), n + m - 2 * need)
    sim = common / (n + m - common)
    return sim if sim >= threshold - 1e-12 else None


def _band_lcs(x: list[int], y: list[int], d: int, step: int = 256) -> int:
    """Longest common subsequence over matches (i, j) with |i - j| <= d."""
    if not x or not y:
        return 0
    where: dict[int, list[int]] = {}
    for j, v in enumerate(y):
        where.setdefault(v, []).append(j)
    lo, done = 0, 0
    hi = min(len(y), d + 1 + step)
    row = (1 << hi) - 1  # a zero bit: the row's value grows there
    for i, v in enumerate(x):
        if i % step == 0 and i:
            new = min(max(0, i - d), len(y))
            done += (new - lo) - (row & ((1 << (new - lo)) - 1)).bit_count()
            row >>= new - lo
            top = min(len(y), i + d + 1 + step)
            row |= ((1 << (top - hi)) - 1) << (hi - new) if top > hi else 0
            lo, hi = new, max(hi, top)
        at = where.get(v)
        if at is None:
            continue
        match = 0
        for j in at:
            if max(lo, i - d) <= j <= i + d and j < hi:
                match |= 1 << (j - lo)
        if match:
            hit = row & match
            row = ((row + hit) | (row & ~match)) & ((1 << (hi - lo)) - 1)
    return done + (hi - lo) - row.bit_count()


def _sketches(docs: DataFrame, k: int, tables: int, width: int) -> DataFrame:
    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        digest, parts, size, low = [], [], [], []
        for text in b.column(1).to_pylist():
            w = words(text)
            digest.append(xxhash.xxh3_128_digest(" ".join(w)) if w else None)
            h = shingle_hashes(w, k)
            size.append(len(h))
            p, s = sketch(h, tables, width) if len(h) else ([], b"")
            parts.append(p)
            low.append(s)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(digest, pa.binary()), pa.array(size, pa.int32()),
                                           pa.array(parts, pa.list_(pa.int64())), pa.array(low, pa.binary())], ["doc_id", "digest", "n", "parts", "low"])
    return map_batches(docs, one, "doc_id long, digest binary, n int, parts array<long>, low binary")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of sorted batches by their first column, which names the group."""
    key, rows = None, []
    for batch in batches:
        for k, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if k != key:
                if rows:
                    yield key, rows
                key, rows = k, []
            rows.append(row)
    if rows:
        yield key, rows


def _members(parts: DataFrame) -> DataFrame:
    """(key, t, doc_id, size) of all buckets of more than one text; of buckets that hold the same texts that of the first table t."""
    rows = keep(parts.select("doc_id", F.posexplode("parts").alias("t", "v")).select(F.xxhash64("t", "v").alias("key"), "t", "doc_id"), "buckets")
    sizes = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("t").alias("t"),
                                    *[F.bit_xor(F.xxhash64("doc_id", F.lit(i))).alias(f"s{i}") for i in (1, 2)]).where("size > 1")
    first = sizes.groupBy("s1", "s2", "size").agg(F.min(F.struct("t", "key")).alias("f")).select(F.col("f.key").alias("key"), "size")
    return keep(rows.join(first, "key"), "bucket-members")


def _claims(members: DataFrame, details: DataFrame, bound: int, threshold: float) -> DataFrame:
    """Pairs (a, b): each text's claim by a leader, all to be verified. Leaders of large buckets go on while they become fewer."""
    def led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches):
            key, size, ids, n, low = (list(x) for x in zip(*rows, strict=True))
            pairs = [p for p in lead(np.array(ids), np.array(n), _matrix(low), threshold) if p[1] is not None or size[0] > bound]
            if pairs:
                a, b = zip(*pairs, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(a), pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["key", "a", "b"])

    found, level, before = [], 0, None
    while True:
        part = F.pmod(F.xxhash64("doc_id", F.lit(level)), F.ceil(F.col("size") / bound))
        rows = members.select("key", "size", "doc_id", F.xxhash64("key", part).alias("part")).join(details, "doc_id")
        rows = rows.repartition("part").sortWithinPartitions("part", F.xxhash64("doc_id"), "doc_id").select("part", "key", "size", "doc_id", "n", "low")
        claims = keep(rows.mapInArrow(led, "key long, a long, b long"), "claims")
        found.append(claims.where("b is not null").select("a", "b"))
        leaders = claims.where("b is null").select("key", F.col("a").alias("doc_id"))
        now = leaders.count()
        # Leaders that stay as many are unlike each other; what they miss is looked at with the pairs of unlike classes.
        if not now or before is not None and now > 0.9 * before:
            break
        members = keep(leaders.join(leaders.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "key"), "bucket-members")
        level, before = level + 1, now
    pairs = found[0]
    for f in found[1:]:
        pairs = pairs.union(f)
    # Claims run from the text to its leader; one direction for a pair that came both ways.
    return pairs.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.min("a").alias("a")).select(
        "a", (F.col("x") + F.col("y") - F.col("a")).alias("b"))


def _open_links(members: DataFrame, parts: DataFrame, labels: DataFrame, texts: DataFrame, bound: int, k: int, threshold: float) -> DataFrame:
    """(a, b, sim): links that unite classes of texts that share a bucket.

    Buckets are cut in blocks of about ``bound`` texts, or of as many shingles as that
    many texts of MEAN_SHINGLES; a class that is larger has blocks of its own, which
    needn't meet each other.
    """
    named = _labelled(members.select("key", "t", "doc_id"), labels).join(parts.select("doc_id", "n"), "doc_id")
    classes = keep(named.groupBy("key", "lab").agg(F.count("*").alias("n_class"), F.sum("n").alias("n_shingles")), "bucket-classes")
    whole = F.col("n_class") > bound
    loose = lambda c: F.sum(F.when(whole, 0).otherwise(F.col(c)))
    mixed = (classes.groupBy("key").agg(F.count("*").alias("n_classes"), loose("n_class").alias("n_loose"), loose("n_shingles").alias("s_loose"))
             .where("n_classes > 1").drop("n_classes"))
    cuts = lambda n, s: F.greatest(F.ceil(F.col(n) / bound), F.ceil(F.col(s) / (bound * MEAN_SHINGLES)))
    of_class = classes.join(mixed, "key").select("key", "lab", whole.alias("whole"), F.when(whole, F.col("lab")).otherwise(0).alias("home"),
                                                 F.when(whole, cuts("n_class", "n_shingles")).otherwise(cuts("n_loose", "s_loose")).alias("cuts"))
    block = F.struct("whole", "home", F.pmod(F.xxhash64("doc_id"), F.col("cuts")).alias("cut"))
    rows = keep(named.join(of_class, ["key", "lab"]).select("key", "t", "doc_id", "lab", block.alias("block")), "bucket-blocks")
    blocks = keep(rows.select("key", "block").distinct(), "blocks")
    meet = blocks.withColumnRenamed("block", "x").join(blocks.withColumnRenamed("block", "y"), "key").where(
        "x <= y and not (x.whole and y.whole and x.home = y.home)")
    meet = keep(meet.select("key", "x", "y", F.xxhash64("key", "x", "y").alias("g")), "blocks-met")
    columns = ["g", "t", "doc_id", "lab"]
    sides = (rows.join(meet.select("key", F.col("x").alias("block"), "g"), ["key", "block"]).select(*columns, F.lit(0).alias("side"))
             .union(rows.join(meet.where("x <> y").select("key", F.col("y").alias("block"), "g"), ["key", "block"]).select(*columns, F.lit(1).alias("side"))))
    # Shuffled at every size, as in _verify.
    full = (sides.join(parts.select("doc_id", "parts").hint("merge"), "doc_id").join(texts.hint("merge"), "doc_id")
            .select("g", "side", "t", "doc_id", "lab", "parts", "text"))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = (pa.RecordBatch.from_arrays(b.columns[:6] + [pa.array([shingles(x.as_py(), k).tobytes() for x in b.column(6)], pa.binary())], b.schema.names)
                for b in batches)
        for _, rows in _groups(read):
            blocks = []
            for s in (0, 1):
                if side := [r[1:] for r in rows if r[0] == s]:
                    t, ids, lab, sketches, seqs = zip(*side, strict=True)
                    blocks.append(Block(ids, lab, sketches, [np.frombuffer(x, np.uint64) for x in seqs]))
            if found := list(united(blocks, t[0], threshold)):
                a, b, sim = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sim, pa.float64())], ["a", "b", "sim"])

    return full.repartition("g").sortWithinPartitions("g", "side", "doc_id").mapInArrow(compared, "a long, b long, sim double")


def _verify(pairs: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """(a, b) -> (a, b, sim), sim null where the texts are not similar."""
    # Shuffled at every size: a plan that broadcasts few pairs at first would shuffle texts only on larger inputs.
    both = (pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")).hint("merge"), "a")
            .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")).hint("merge"), "b").select("a", "b", "ta", "tb"))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        last, other, sims = None, None, []
        for ta, b, tb in zip(batch.column(2), batch.column(1).to_pylist(), batch.column(3), strict=True):
            if b != last:  # pairs of a leader come together after the join on it
                last, other = b, shingles(tb.as_py(), k)
            sims.append(aligned(shingles(ta.as_py(), k), other, threshold))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims, pa.float64())], ["a", "b", "sim"])
    return map_batches(both, one, "a long, b long, sim double")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Attach each doc's class so far (itself without links)."""
    return (rows.join(labels.select(F.col("id").alias("doc_id"), "class_id"), "doc_id", "left")
            .withColumn("lab", F.coalesce("class_id", "doc_id")).drop("class_id"))


def _verified(pairs: DataFrame, labels: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """The links among the pairs of texts that aren't in one class yet."""
    left = _labelled(pairs.withColumnRenamed("a", "doc_id"), labels).select(F.col("doc_id").alias("a"), F.col("lab").alias("la"), F.col("b").alias("doc_id"))
    todo = _labelled(left, labels).where("la <> lab").select("a", F.col("doc_id").alias("b"))
    return keep(_verify(todo, texts, k, threshold), "checked").where("sim is not null")


def _joined(links: DataFrame, labels: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, labels) with the links found."""
    if not found.limit(1).count():
        return links, labels
    links = links.union(found)
    return links, keep(components(links), "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: float = 0.8,
                    tables: int = 12, width: int = 3, bound: int = 500) -> DataFrame:
    """One row per id: doc_id, class_id (smallest id of its class), n_links (links found to other texts by comparison).

    Texts without words (null, empty, only punctuation) are classes of their
    own. Texts with the same words share a class without counting as links.
    Rows that repeat an id must carry the same text; they come back once.
    """
    base = with_id(docs, id_col, text_col)
    sk = keep(_sketches(base, k, tables, width).dropDuplicates(["doc_id"]), "sketches")
    reps = keep(sk.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep")), "reps")
    parts = keep(sk.where("digest is not null").join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"), "parts")
    details = parts.select("doc_id", "n", "low")
    members = _members(parts)
    texts = keep(base.join(members.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts")
    claims = keep(_claims(members, details, bound, threshold), "pairs")
    # First one pair for each text, with the other text of least hash: most members of a group meet there.
    first = claims.groupBy("a").agg(F.min(F.struct(F.xxhash64("b"), F.col("b").alias("id"))).alias("c")).select("a", F.col("c.id").alias("b"))
    links = keep(_verify(first, texts, k, threshold), "checked").where("sim is not null")
    labels = keep(components(links), "classes")
    # Then the other claims of texts that aren't in one class yet, then all that is left open in the buckets.
    links, labels = _joined(links, labels, _verified(claims.join(first, ["a", "b"], "left_anti"), labels, texts, k, threshold))
    links, labels = _joined(links, labels, keep(_open_links(members, parts, labels, texts, bound, k, threshold), "open-links"))
    n_links = links.select(F.explode(F.array("a", "b")).alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("n_links"))
    rep_class = _labelled(reps.select(F.col("rep").alias("doc_id"), "digest"), labels).select("digest", F.col("lab").alias("class_id"))
    out = sk.select("doc_id", "digest").join(keep(rep_class, "rep-class"), "digest", "left")
    return (out.join(n_links, "doc_id", "left")
            .select(null_id("doc_id"), F.coalesce("class_id", "doc_id").alias("class_id"),
                    F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
            .withColumn("class_id", null_id("class_id")))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kwargs) -> DataFrame:
    """``docs`` with one document of each class, the one of smallest id; all columns as they were."""
    classes = near_duplicates(docs, id_col, text_col, **kwargs)
    kept = classes.where("doc_id <=> class_id").select(F.col("doc_id").alias("_kept"))
    return docs.join(kept.hint("merge"), F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("_kept")), "left_semi")  # shuffled at every size
