"""Removal of repeated word sequences by relative Lempel-Ziv parsing.

A word goes if a window of ``length`` words around it also starts anywhere else,
in the same document or another. All texts are parsed against all texts:

1. Reference blocks. The few words of least hash in a window are its anchor;
   the windows in a row with one anchor make up a block. Equal windows have
   equal anchors, so a block has to be parsed against the reference blocks of
   its own anchor only, and these are all that can hold a window of it. A block
   found more than once repeats as a whole, and one copy of it stays in the
   reference; a block whose anchor has no other block is settled as well.
2. Index. The other blocks are shuffled by their anchor. A task indexes the
   reference blocks of its anchors by the sorted order of all their suffixes
   that start a window; a position's longest factor elsewhere is that with a
   neighbour in the order.
3. Factors. Each block is parsed greedily from left to right. A factor of at
   least ``length`` words is a repeated span. The parse goes on at the factor's
   end with the first window that straddles this boundary, after a shorter
   factor with the next window, so no window is left out.

An anchor may have any number of different blocks: boilerplate with another
neighbour in every document. A group of more than ``group_blocks`` is divided by
finer anchors, several hashes of a window with their places, then more, in the
end all of them: each window's blocks become shorter, those found more than once
repeat as a whole, and equal windows still share a group. The same parse follows
in the groups that are left. All that is shuffled for the whole text is a row of
hashes for each block, about 15 words, combined within each batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import drop_kept, keep, map_batches, null_id, with_id
from quarry.llm.suffix_dedup import sliding, string_hashes

SPAN_LIST = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
DDL = {pa.string(): "string", pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", SPAN_LIST: "array<struct<a:long,b:long>>"}
#: A piece of a document: words from word ``start`` on, joined by blanks, under the key of its windows' anchor.
PIECE = "key long, copies long, doc_id long, text_hash long, start long, piece binary"


class WordHashes(dict):
    """64-bit hashes of words; forgets them all now and then."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter((self[w] for w in words), np.uint64, len(words))


def anchor_words(length: int) -> int:
    """Words of an anchor: the largest power of two up to 8 and a third of ``length`` or so."""
    return min(8, 1 << max(0, (length // 3).bit_length() - 1))


def blocks(h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first word and end of each block of a text that has a window at least, from its words' hashes."""
    k = anchor_words(length)
    g = string_hashes(h, k)
    least = sliding(g, length - k + 1, np.minimum)
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (g[:len(least) - 1] == least[:-1])  # another hash, or another place of it
    first = np.flatnonzero(new)
    return least[first].view(np.int64), first, np.append(first[1:], len(least)) + length - 1


def finer_blocks(h: np.ndarray, length: int, hashes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``blocks`` by anchors of the ``hashes`` least hashes of a window and their places in it."""
    k = anchor_words(length)
    window = np.lib.stride_tricks.sliding_window_view(string_hashes(h, k), length - k + 1)
    held = np.sort(np.argsort(window, axis=1, kind="stable")[:, :hashes], axis=1)
    place = held + np.arange(len(window))[:, None]
    new = np.ones(len(window), bool)
    new[1:] = (place[1:] != place[:-1]).any(1)
    first = np.flatnonzero(new)
    # Places count from the first of them: a block's windows differ in the places within them, not in these.
    parts = np.concatenate([np.take_along_axis(window, held, 1)[first], (place - place[:, :1])[first].astype(np.uint64)], axis=1)
    key = np.array([xxhash.xxh3_64_intdigest(row.tobytes()) for row in parts], np.uint64)
    return key.view(np.int64), first, np.append(first[1:], len(window)) + length - 1


def _digests(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128 bits of the words of each block, as two longs."""
    raw = h.tobytes()
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[8 * s:8 * e]) for s, e in zip(start.tolist(), end.tolist(), strict=True)), np.int64).reshape(-1, 2)


def _block_rows(docs: DataFrame, length: int) -> DataFrame:
    """(key, d1, d2, n, doc_id, text_hash, number): blocks, how often found, and one holder with the block's number in it."""
    names = ["key", "d1", "d2", "n", "doc_id", "text_hash", "number"]

    def one(b: pa.RecordBatch, known: WordHashes) -> pa.RecordBatch | None:
        found: dict[tuple, list] = {}
        for doc_id, text_hash, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            words = text.as_buffer().to_pybytes().split()
            if len(words) < length:
                continue
            h = known.of(words)
            key, start, end = blocks(h, length)
            for number, at in enumerate(zip(key.tolist(), *_digests(h, start, end).T.tolist(), strict=True)):
                if (held := found.get(at)) is None:
                    found[at] = [1, doc_id, text_hash, number]
                else:
                    held[0] += 1
        if not found:
            return None
        columns = [*zip(*found, strict=True), *zip(*found.values(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            for i in range(0, b.num_rows, 2500):
                if (out := one(b.slice(i, 2500), known)) is not None:
                    yield out
            pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "text_hash", "text").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def longest_factors(pieces: list[list[bytes]], length: int) -> tuple[np.ndarray, np.ndarray]:
    """For the windows of all pieces, one piece after the other: (position in the joined pieces, words of the longest factor
    that starts a window elsewhere in the pieces)."""
    codes: dict[bytes, int] = {}
    size = np.array([len(p) for p in pieces])
    joined = np.full(int((size + 1).sum()), -1, np.int64)
    base = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    for at, words in zip(base.tolist(), pieces, strict=True):
        joined[at:at + len(words)] = [codes.setdefault(w, len(codes)) for w in words]
    ends = np.flatnonzero(joined < 0)
    joined[ends] = len(codes) + np.arange(len(ends))  # an end of its own for each piece: no factor goes past it
    count = size - length + 1
    starts = np.repeat(base - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    # Ranks of the first 1, 2, 4 ... words of every suffix, up to the longest piece.
    ranks, reach = [joined], 1
    while reach < size.max():
        last = ranks[-1]
        behind = np.zeros(len(last), np.int64)
        behind[:-reach] = last[reach:] + 1
        ranks.append(np.unique(last * (len(joined) + len(codes) + 2) + behind, return_inverse=True)[1])
        reach *= 2
    order = starts[np.argsort(ranks[-1][starts], kind="stable")]
    left, right, same = order[:-1].copy(), order[1:].copy(), np.zeros(max(0, len(order) - 1), np.int64)
    for level in range(len(ranks) - 1, -1, -1):  # words shared by neighbours in the order, the largest powers of two first
        fits = (left < len(joined)) & (right < len(joined))
        equal = np.zeros(len(left), bool)
        equal[fits] = ranks[level][left[fits]] == ranks[level][right[fits]]
        same[equal] += 1 << level
        left[equal] += 1 << level
        right[equal] += 1 << level
    longest = np.zeros(len(joined), np.int64)
    longest[order[:-1]] = same
    longest[order[1:]] = np.maximum(longest[order[1:]], same)
    return starts, longest[starts]


def parse(pieces: list[list[bytes]], length: int) -> list[tuple[int, int, int]]:
    """(piece, first word, end) of the factors of at least ``length`` words in a greedy parse of each piece against all others."""
    _, longest = longest_factors(pieces, length)
    count = np.array([len(p) - length + 1 for p in pieces])
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    at, out, piece = np.zeros(len(pieces), np.int64), [], np.arange(len(pieces))
    while len(piece):  # a factor of every piece that isn't at its end
        size = longest[first[piece] + at]
        long = size >= length
        out += zip(piece[long].tolist(), at[long].tolist(), (at + size)[long].tolist(), strict=True)
        at = at + np.where(long, size - length + 1, 1)
        on = at < count[piece]
        piece, at = piece[on], at[on]
    return out


def _search(pieces: DataFrame, length: int, batch_bytes: int) -> DataFrame:
    """Spans (doc_id, text_hash, a, b) that repeat, by parsing whole key groups, about ``batch_bytes`` of them at a time."""
    def spans(rows: list[tuple]) -> pa.RecordBatch | None:
        _, doc, text_hash, start, texts = zip(*rows, strict=True)
        found = parse([t.split() for t in texts], length)
        if not found:
            return None
        cols = zip(*[(doc[i], text_hash[i], start[i] + a, start[i] + b) for i, a, b in found], strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "text_hash", "a", "b"])

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
                size, last = size + len(r[4]), r[0]
        if rows and (found := spans(rows)) is not None:
            yield found

    rows = pieces.select("key", "doc_id", "text_hash", "start", "piece").repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(run, "doc_id long, text_hash long, a long, b long")


def _divide(pieces: DataFrame, length: int, hashes: int) -> DataFrame:
    """Pieces cut into blocks by finer anchors, with their digests."""
    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        out, known = [], WordHashes()
        for copies, doc_id, text_hash, start, piece in zip(*[b.column(i).to_pylist() for i in range(1, 6)], strict=True):
            words = piece.split()
            h = known.of(words)
            key, first, end = finer_blocks(h, length, hashes)
            for k, s, e, (d1, d2) in zip(key.tolist(), first.tolist(), end.tolist(), _digests(h, first, end).tolist(), strict=True):
                out.append((k, copies, doc_id, text_hash, start + s, b" ".join(words[s:e]), e - s, d1, d2))
        types = [*[pa.int64()] * 5, pa.binary(), *[pa.int64()] * 3]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)],
                                          ["key", "copies", "doc_id", "text_hash", "start", "piece", "size", "d1", "d2"])

    return map_batches(pieces, one, PIECE + ", size long, d1 long, d2 long")


def _repeated(pieces: DataFrame, length: int, group_blocks: int, batch_bytes: int) -> DataFrame:
    """All spans of repeated windows that ``pieces`` share; large groups are divided first."""
    columns = [c.split()[0] for c in PIECE.split(", ")]
    most = length - anchor_words(length) + 1
    levels = [x for x in (4, 13) if x < most] + [most]
    out = []
    for hashes in levels:
        large = keep(pieces.groupBy("key").count().where(F.col("count") > group_blocks).select("key"), "rlz-large")
        if not large.limit(1).count():
            break
        # Both joins split a large key's rows: its other side is one row.
        out.append(_search(pieces.join(large.hint("merge"), "key", "left_anti"), length, batch_bytes))
        parts = keep(_divide(pieces.join(large.hint("merge"), "key", "left_semi").select(columns), length, hashes), "rlz-parts")
        alike = parts.groupBy("key", "d1", "d2").agg(F.sum("copies").alias("total"))
        several = alike.groupBy("key").agg(F.count("*").alias("alike")).where("alike > 1")
        whole = parts.join(alike.where("total > 1").hint("merge"), ["key", "d1", "d2"])
        out.append(whole.select("doc_id", "text_hash", F.col("start").alias("a"), (F.col("start") + F.col("size")).alias("b")))
        reference = parts.dropDuplicates(["key", "d1", "d2"]).drop("copies").join(alike, ["key", "d1", "d2"]).withColumnRenamed("total", "copies")
        # At the last level an anchor is its whole window, so nothing is left.
        pieces = keep(reference.join(several.hint("merge"), "key", "left_semi").select(columns), "rlz-pieces")
    out.append(_search(pieces, length, batch_bytes))
    spans = out[0]
    for more in out[1:]:
        spans = spans.union(more)
    return spans


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _kept(words: list[bytes], spans: list[tuple[int, int]]) -> bytes:
    left, at = [], 0
    for a, b in [*spans, (len(words), len(words))]:
        left += words[at:a]
        at = b
    return b" ".join(left)


#: What ``repeats`` returns of a document, from its words and the runs to remove: function and columns.
RESULTS = {
    "spans": (lambda words, spans: ([{"a": a, "b": b} for a, b in spans],), {"spans": SPAN_LIST}),
    "digest": (lambda words, spans: (len(words), sum(b - a for a, b in spans), hashlib.sha256(_kept(words, spans)).hexdigest()),
               {"n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string()}),
    "text": (lambda words, spans: (_kept(words, spans).decode(),), {"text": pa.string()}),
}


def _examine(joined: DataFrame, length: int, result: str) -> DataFrame:
    """Rows of three kinds: 0 a settled document's result; 1 an open one's text, with the spans of blocks found more than once;
    2 a piece to be parsed, or to be parsed against."""
    finish, columns = RESULTS[result]
    fields = {"kind": pa.int32(), "doc_id": pa.int64(), "text_hash": pa.int64(), "whole": pa.string(), "known": SPAN_LIST, "key": pa.int64(),
              "copies": pa.int64(), "start": pa.int64(), "piece": pa.binary()} | {f"out_{c}": t for c, t in columns.items()}
    blank = (None,) * len(columns)

    def one(b: pa.RecordBatch, known: WordHashes) -> pa.RecordBatch:
        rows = []
        for doc_id, text_hash, text, codes in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
            words, spans, asked = text.as_buffer().to_pybytes().split(), [], False
            if len(words) >= length:
                held = {c >> 2: c & 3 for c in codes or ()}
                key, start, end = blocks(known.of(words), length)
                for i, (k, s, e) in enumerate(zip(key.tolist(), start.tolist(), end.tolist(), strict=True)):
                    flag = held.get(i, 3)  # 0: no other block with its anchor; 1: others; 2: found again, the reference's copy; 3: found again
                    if flag & 2:
                        spans.append((s, e))
                    if flag in (1, 2):
                        asked |= flag == 1
                        rows.append((2, doc_id, text_hash, None, None, k, flag, s, b" ".join(words[s:e]), *blank))
            spans = _merge(spans)
            if asked:
                rows.append((1, doc_id, text_hash, text.as_py(), [{"a": x, "b": y} for x, y in spans], None, None, None, None, *blank))
            else:
                rows.append((0, doc_id, text_hash, None, None, None, None, None, None, *finish(words, spans)))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), fields.values(), strict=True)], list(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            for i in range(0, b.num_rows, 500):
                yield one(b.slice(i, 500), known)
            pa.default_memory_pool().release_unused()

    return joined.mapInArrow(run, ", ".join(f"{c} {DDL[t]}" for c, t in fields.items()))


def repeats(docs: DataFrame, length: int = 35, result: str = "spans", id_col: str = "doc_id", text_col: str = "text",
            group_blocks: int = 2000, batch_bytes: int = 500_000) -> DataFrame:
    """One row per row of ``docs``: doc_id and, of the words ``[^\\x20\\x09-\\x0D]+`` of its text that a window found twice covers, by ``result``

    - spans: the maximal runs [a, b) of such words, as word numbers;
    - digest: n_words, n_removed, kept_sha256 of the other words, joined by one blank;
    - text: those words, joined by one blank.

    Null texts have no words; texts of fewer than ``length`` words lose none. Each
    row is a document of its own: rows that repeat an id with different texts have
    each its own result, and rows that repeat id and text are copies of each other,
    so they lose all words if there are ``length`` of them. Null ids stay null.
    Other columns are not read. Words and blocks are told apart by 64 and 128 bits
    of hash before, and word by word in, the parse.
    """
    base = with_id(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    found = _block_rows(base, length).groupBy("key", "d1", "d2").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "text_hash", "number")).alias("at"))
    first = keep(found.select("key", "n", "at.*"), "rlz-blocks")
    several = first.groupBy("key").agg(F.count("*").alias("alike")).where("alike > 1")
    flag = F.when(F.col("n") > 1, 2).when(F.col("alike").isNotNull(), 1).otherwise(0)
    # These joins shuffle at every size, as they must on large inputs; large keys are split, their other side is one row.
    flagged = first.join(several.hint("merge"), "key", "left").where("n = 1 or alike is not null")
    held = flagged.select("doc_id", "text_hash", (F.col("number") * 4 + flag).alias("code")).groupBy("doc_id", "text_hash").agg(F.collect_list("code").alias("codes"))
    joined = base.join(held.hint("merge"), ["doc_id", "text_hash"], "left").select("doc_id", "text_hash", "text", "codes")
    seen = keep(_examine(joined, length, result), "rlz-examined")
    drop_kept(first)
    pieces = seen.where("kind = 2").select(*[c.split()[0] for c in PIECE.split(", ")])
    spans = _repeated(pieces, length, group_blocks, batch_bytes)
    more = keep(spans.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("a", "b")).alias("more")), "rlz-spans")
    finish, columns = RESULTS[result]

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, *spans in zip(b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            out.append(finish(text.as_buffer().to_pybytes().split(), _merge([(x["a"], x["b"]) for s in spans for x in s or []])))
        return pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(zip(*out, strict=True), columns.values(), strict=True)]],
                                          ["doc_id", *columns])

    waiting = seen.where("kind = 1").select("doc_id", "text_hash", "whole", "known").join(more.hint("merge"), ["doc_id", "text_hash"], "left")
    answered = map_batches(waiting.select("doc_id", "whole", "known", "more"), one, "doc_id long, " + ", ".join(f"{c} {DDL[t]}" for c, t in columns.items()))
    settled = seen.where("kind = 0").select("doc_id", *[F.col(f"out_{c}").alias(c) for c in columns])
    return settled.union(answered).withColumn("doc_id", null_id("doc_id"))
