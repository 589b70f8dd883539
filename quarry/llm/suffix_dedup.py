"""Removal of repeated 100-byte strings by suffix arrays (difference cover modulo 3).

A byte goes if a string of ``length`` bytes around it also starts earlier: in a
document of smaller id, or earlier in the same one. Three exact steps:

1. Blocks. The k-byte string of least hash in a window of ``length`` bytes is
   its anchor; equal windows have equal anchors. The windows in a row with one
   anchor, about 35 at the default, make up a block. A block that an earlier
   document has too is a repeat as a whole: only its first holder keeps it.
2. Partition. Kept blocks whose anchor stands in other, different blocks too may
   share windows with those. They are grouped by the anchor, so equal windows
   meet in one group, wherever they are.
3. Suffix arrays. Each task builds suffix arrays over its groups' texts with the
   difference-cover algorithm (sort sampled triples, recurse on their names,
   merge the remaining suffixes) and compares the ``length``-byte prefixes of
   adjacent suffixes; all but the earliest of equal ones are repeats. An anchor
   found in more than ``hot_blocks`` blocks would make a group that one task
   can't hold; its windows are compared by a 128-bit digest of the whole string
   in a pre-aggregated groupBy instead.

Only (anchor, block digest, id) rows are shuffled for the whole text, about one
per 35 bytes, combined within each batch before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import keep, keep_by, map_batches, null_id, with_id

#: Odd multipliers, one for each doubling of the hashed string.
DOUBLINGS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)


def anchor_size(length: int) -> int:
    """The largest power of two up to 32 and a third of ``length`` or so."""
    return min(32, 1 << max(0, (length // 3).bit_length() - 1))


def string_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of the k bytes (a power of two) from each position on."""
    h = data.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    size = 1
    while size < k:
        h = h[:-size] * np.uint64(DOUBLINGS[size.bit_length() - 1]) + h[size:]
        h ^= h >> np.uint64(31)
        size *= 2
    return h


def sliding(a: np.ndarray, w: int, f) -> np.ndarray:
    """f over every window of w values, by doubling."""
    size = 1
    while size * 2 <= w:
        a = f(a[:-size], a[size:])
        size *= 2
    return f(a[:-(w - size)], a[w - size:]) if size < w else a


def blocks(data: bytes, length: int) -> tuple[np.ndarray, list[int], list[int], np.ndarray]:
    """Blocks of ``data``, which has a window at least: anchor hash, first byte, end byte and content digest.

    A block is a run of window starts whose windows have the same first place of least hash.
    """
    k = anchor_size(length)
    h = string_hashes(np.frombuffer(data, np.uint8), k)
    least = sliding(h, length - k + 1, np.minimum)
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (h[:len(least) - 1] == least[:-1])
    first = np.flatnonzero(new)
    start = first.tolist()
    end = (np.append(first[1:], len(least)) + length - 1).tolist()
    digest = np.fromiter((xxhash.xxh3_64_intdigest(data[s:e]) for s, e in zip(start, end, strict=True)), np.uint64, len(start))
    return least[first], start, end, digest


def _block_rows(docs: DataFrame, length: int) -> DataFrame:
    """(anchor, digest, smallest id, number of the block in it), combined within each batch."""
    def one(b: pa.RecordBatch) -> pa.RecordBatch | None:
        keys, ids = [], []
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            data = text.as_buffer().to_pybytes()
            if len(data) >= length:
                a, _, _, d = blocks(data, length)
                keys.append(np.stack([a, d], 1))
                ids.append(np.stack([np.full(len(a), doc_id), np.arange(len(a))], 1))
        if not keys:
            return None
        key, place = np.concatenate(keys).view(np.int64), np.concatenate(ids)
        order = np.lexsort((place[:, 1], place[:, 0], key[:, 1], key[:, 0]))
        key, place = key[order], place[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]).any(1)
        new = np.sort(order[new])  # back in order of documents, whose ids then compress well in the shuffle
        key, place = np.concatenate(keys).view(np.int64), np.concatenate(ids)
        return pa.RecordBatch.from_arrays([pa.array(c[new]) for c in (key[:, 0], key[:, 1], place[:, 0], place[:, 1])], ["anchor", "digest", "doc_id", "number"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 2500):
                if (out := one(b.slice(i, 2500))) is not None:
                    yield out
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, "anchor long, digest long, doc_id long, number long")


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of non-negative integers by the difference cover modulo 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    top = int(s.max()) + 2
    if top > 2_000_000:  # triples must fit into 63 bits
        s = np.unique(s, return_inverse=True)[1]
        top = int(s.max()) + 2
    t = np.concatenate([s.astype(np.int64) + 1, np.zeros(3, np.int64)])
    # Sampled positions: all i mod 3 = 1, then all i mod 3 = 2; one more of the first kind if n mod 3 = 1.
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    triple = (t[sample] * top + t[sample + 1]) * top + t[sample + 2]
    order = np.argsort(triple, kind="stable")
    name = np.empty(len(sample), np.int64)
    name[order] = np.concatenate([[0], np.cumsum(triple[order][1:] != triple[order][:-1])])
    if name[order[-1]] + 1 < len(sample):  # names repeat: order the sample by the suffixes of its names
        order = suffix_array(name)
        name[order] = np.arange(len(order))
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = name + 1
    by_rank = sample[order]
    by_rank = by_rank[by_rank < n]
    # The rest, i mod 3 = 0: by first letter, then by the rank of the suffix behind it.
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(t[rest] * (len(sample) + 2) + rank[rest + 1], kind="stable")]
    # Merge: how many sampled suffixes stand before each of the rest. A sampled i mod 3 = 1 compares as
    # (letter, rank behind), i mod 3 = 2 as (letter, letter, rank behind); within each kind the order is known.
    wide = len(sample) + 2
    kind = by_rank % 3
    ones, twos = by_rank[kind == 1], by_rank[kind == 2]
    before = np.searchsorted(t[ones] * wide + rank[ones + 1], t[rest] * wide + rank[rest + 1])
    if top * top < 2**62 // wide:
        pair = lambda i: (t[i] * top + t[i + 1]) * wide + rank[i + 2]
    else:
        joint = np.unique(np.concatenate([t[twos] * top + t[twos + 1], t[rest] * top + t[rest + 1]]))
        pair = lambda i: np.searchsorted(joint, t[i] * top + t[i + 1]) * wide + rank[i + 2]
    before += np.searchsorted(pair(twos), pair(rest))
    out = np.empty(n, np.int64)
    places = before + np.arange(len(rest))
    out[places] = rest
    free = np.ones(n, bool)
    free[places] = False
    out[free] = by_rank
    return out


def repeated_windows(texts: list[bytes], doc: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of all windows of the texts, (row, window number) of those equal to an earlier one in order of (doc, start).

    Text r starts at byte ``first[r]`` of document ``doc[r]``. A suffix array over
    the texts brings equal windows together; only the prefixes of adjacent ones are compared.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts])
    base = np.concatenate([[0], np.cumsum(size)[:-1]])
    row_of = np.repeat(np.arange(len(texts)), size)
    is_start = np.zeros(len(data), bool)
    count = size - length + 1
    starts = np.repeat(base - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    is_start[starts] = True
    order = suffix_array(data)
    order = order[is_start[order]]
    window = np.lib.stride_tricks.sliding_window_view(data, length)
    same = np.zeros(len(order), bool)
    for a in range(1, len(order), 100_000):
        b = min(len(order), a + 100_000)
        left, right = order[a - 1:b - 1], order[a:b]
        same[a:b] = (window[left] == window[right]).all(1)
    cls = np.cumsum(~same)
    row, offset = row_of[order], order - base[row_of[order]]
    by = np.lexsort((first[row] + offset, doc[row], cls))
    row, offset, cls = row[by], offset[by], cls[by]
    later = np.concatenate([[False], cls[1:] == cls[:-1]])
    return row[later], offset[later]


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Half-open runs of consecutive sorted integers."""
    if len(values):
        cut = np.flatnonzero(np.diff(values) > 1) + 1
        for part in np.split(values, cut):
            yield int(part[0]), int(part[-1]) + 1


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


SPAN_LIST = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _as_spans(data: bytes, spans: list[tuple[int, int]]) -> tuple:
    return data.decode(), [{"a": a, "b": b} for a, b in spans]


def _as_digest(data: bytes, spans: list[tuple[int, int]]) -> tuple:
    h, at = hashlib.sha256(), 0
    for a, b in spans:
        h.update(data[at:a])
        at = b
    h.update(data[at:])
    return len(data), sum(b - a for a, b in spans), len(spans), h.hexdigest()


def _as_text(data: bytes, spans: list[tuple[int, int]]) -> tuple:
    parts, at = [], 0
    for a, b in [*spans, (len(data), len(data))]:
        parts.append(data[at:a].decode("utf-8", "ignore"))
        at = b
    return ("".join(parts),)


#: What ``repeats`` returns of a document, from its bytes and the runs to remove: function and columns.
RESULTS = {
    "spans": (_as_spans, {"text": pa.string(), "spans": SPAN_LIST}),
    "digest": (_as_digest, {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}),
    "text": (_as_text, {"text": pa.string()}),
}
DDL = {pa.string(): "string", pa.int64(): "long", pa.bool_(): "boolean", pa.binary(): "binary", SPAN_LIST: "array<struct<a:long,b:long>>"}


def _examine(joined: DataFrame, length: int, result: str) -> DataFrame:
    """Rows of three kinds (``kind``): a settled document's result, an open one's text with the spans of its repeated
    blocks, and the questions that it waits for.

    Questions: (anchor, doc_id, start, piece) for a block that may share windows with others; for one of a hot anchor
    a row for each window, with the window's 128-bit digest as (anchor, check).
    """
    finish, columns = RESULTS[result]
    fields = {"kind": pa.string(), "doc_id": pa.int64(), "whole": pa.string(), "known": SPAN_LIST, "anchor": pa.int64(), "check": pa.int64(),
              "start": pa.int64(), "piece": pa.binary()} | columns
    names = list(fields)

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc_id, text, codes in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
            data, spans, asked = text.as_buffer().to_pybytes(), [], False
            if len(data) >= length:
                anchor, start, end, _ = blocks(data, length)
                held = {c >> 2: c & 3 for c in codes.as_py() or ()}
                for i, (h, s, e) in enumerate(zip(anchor.view(np.int64).tolist(), start, end, strict=True)):
                    flag = held.get(i)
                    if flag is None:
                        spans.append((s, e))
                    elif flag & 2:
                        asked = True
                        for j in range(s, e - length + 1):
                            x = xxhash.xxh3_128_intdigest(data[j:j + length])
                            rows.append({"kind": "hot", "doc_id": doc_id, "anchor": (x >> 64) - 2**63, "check": (x & (2**64 - 1)) - 2**63, "start": j})
                    elif flag & 1:
                        asked = True
                        rows.append({"kind": "cold", "doc_id": doc_id, "anchor": h, "start": s, "piece": data[s:e]})
            spans = _merge(spans)
            if asked:
                rows.append({"kind": "open", "doc_id": doc_id, "whole": data.decode(), "known": [{"a": x, "b": y} for x, y in spans]})
            else:
                rows.append({"kind": "done", "doc_id": doc_id} | dict(zip(columns, finish(data, spans), strict=True)))
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], fields[c]) for c in names], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 300):
                yield one(b.slice(i, 300))
            pa.default_memory_pool().release_unused()

    return joined.mapInArrow(run, ", ".join(f"{c} {DDL[t]}" for c, t in fields.items()))


def _search(questions: DataFrame, length: int, batch_bytes: int) -> DataFrame:
    """Spans of windows that repeat, from suffix arrays over whole anchor groups of about ``batch_bytes``."""
    def spans(rows: list[tuple]) -> pa.RecordBatch | None:
        _, doc, start, texts = zip(*rows, strict=True)
        row, offset = repeated_windows(list(texts), np.array(doc), np.array(start), length)
        order = np.lexsort((offset, row))
        row, offset = row[order], offset[order]
        out = [(doc[row[part[0]]], start[row[part[0]]] + int(offset[part[0]]), start[row[part[0]]] + int(offset[part[-1]]) + length)
               for part in np.split(np.arange(len(row)), np.flatnonzero((np.diff(row) != 0) | (np.diff(offset) > 1)) + 1) if len(part)]
        if not out:
            return None
        d, a, b = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["doc_id", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, last = 0, None
        for b in batches:
            for r in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if size >= batch_bytes and r[0] != last:
                    if (found := spans(rows)) is not None:
                        yield found
                    rows, size = [], 0
                rows.append(r)
                size, last = size + len(r[3]), r[0]
        if rows and (found := spans(rows)) is not None:
            yield found

    rows = questions.select("anchor", "doc_id", "start", "piece").repartition("anchor").sortWithinPartitions("anchor")
    return rows.mapInArrow(run, "doc_id long, a long, b long")


def repeats(docs: DataFrame, length: int = 100, result: str = "spans", id_col: str = "doc_id", text_col: str = "text",
            hot_blocks: int = 2000, batch_bytes: int = 500_000) -> DataFrame:
    """One row per document: doc_id and, of the bytes of its UTF-8 text that a string starting earlier covers, by ``result``

    - spans: text, and spans, the maximal runs [a, b) of such bytes;
    - digest: n_bytes, n_removed, n_spans, kept_sha256 of the remaining bytes;
    - text: what remains; characters that lost some of their bytes go as a whole.

    Null texts are empty. Empty texts and those of fewer than ``length`` bytes
    lose nothing. Null ids sort before all others. Rows that repeat an id must
    carry the same text, and are one place in the order: each comes back with
    what one of them alone would have.
    """
    base = with_id(docs, id_col, text_col)
    found = _block_rows(base, length).repartition("anchor")
    # By the one exchange on the anchor: first holder of each block, and how many different blocks an anchor has.
    first = found.groupBy("anchor", "digest").agg(F.min("doc_id").alias("doc_id"), F.min_by("number", "doc_id").alias("number"))
    alike = F.count("*").over(Window.partitionBy("anchor"))
    flag = F.when(alike > hot_blocks, 3).when(alike > 1, 1).otherwise(0)
    held = first.select("doc_id", (F.col("number") * 4 + flag).cast("int").alias("code")).groupBy("doc_id").agg(F.collect_list("code").alias("codes"))
    joined = base.join(held, "doc_id", "left").select("doc_id", "text", "codes")
    # In buckets of doc_id, as the join above left the rows: waiting texts meet their answers without another shuffle.
    seen = keep_by(_examine(joined, length, result), "suffix-examined", "doc_id")
    cold = _search(seen.where("kind = 'cold'"), length, batch_bytes)
    hot = seen.where("kind = 'hot'").select("doc_id", "start", "anchor", "check")
    earliest = hot.groupBy("anchor", "check").agg(F.min("doc_id").alias("d"), F.min_by("start", F.struct("doc_id", "start")).alias("s"))
    # This join shuffles at every size, as it must on large inputs.
    later = hot.join(earliest.select(F.col("d").alias("doc_id"), F.col("s").alias("start")).hint("merge"), ["doc_id", "start"], "left_anti")
    spans = cold.union(later.select("doc_id", F.col("start").alias("a"), (F.col("start") + length).alias("b")))
    more = keep(spans.groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("more")), "suffix-spans")
    finish, columns = RESULTS[result]

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, *spans in zip(b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            out.append(finish(text.as_buffer().to_pybytes(), _merge([(x["a"], x["b"]) for s in spans for x in s or []])))
        return pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(zip(*out, strict=True), columns.values(), strict=True)]],
                                          ["doc_id", *columns])

    waiting = seen.where("kind = 'open'").select("doc_id", "whole", "known").join(more.hint("merge"), "doc_id", "left")
    answered = map_batches(waiting, one, "doc_id long, " + ", ".join(f"{c} {DDL[t]}" for c, t in columns.items()))
    settled = seen.where("kind = 'done'").select("doc_id", *columns)
    return settled.union(answered).withColumn("doc_id", null_id("doc_id"))


def remove(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", **kwargs) -> DataFrame:
    """``docs`` with what remains of each text, and its number of characters if there is a ``chars_col``.

    A document of which nothing remains goes; one that was null or empty stays as it was.
    """
    kept = repeats(docs, length, "text", id_col, text_col, **kwargs).dropDuplicates(["doc_id"])
    kept = kept.select(F.col("doc_id").alias("_id"), F.col("text").alias("_kept"))
    old = F.col(f"`{text_col}`")
    marked = docs.withColumn("_was", F.when(old.isNotNull(), F.length(old))).drop(text_col)
    joined = marked.join(kept.hint("merge"), F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("_id"))).where("_was is null or _was = 0 or _kept <> ''")
    text = F.when(F.col("_was").isNotNull(), F.col("_kept"))
    made = {text_col: text.alias(text_col)}
    if chars_col in docs.columns:
        made[chars_col] = F.when(F.col("_was").isNotNull(), F.length("_kept")).otherwise(F.col(f"`{chars_col}`")).cast(docs.schema[chars_col].dataType).alias(chars_col)
    return joined.select(*[made.get(c, F.col(f"`{c}`")) for c in docs.columns])
