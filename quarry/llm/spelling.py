"""Grouping of spelling variants by neighbourhoods in a reduced alphabet.

Words one edit apart are still at most one edit apart when every letter is
hashed to one of a few symbols, and over so few symbols the whole one-edit
neighbourhood of a reduced word is short. Neighbourhoods are joined with the
reduced vocabulary, and every pair of words that meets is verified on the
original strings.

The relation is symmetric: what an insertion makes of the shorter word, a
deletion makes of the longer one, and a replacement by a greater symbol is
undone by one by a smaller symbol. So each pair of neighbouring reduced words
is generated from one of its two sides: the neighbourhood's deletions,
replacements by greater symbols and the reduced word itself are emitted, and
verified pairs count for both words. Nothing of the full neighbourhoods is lost.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import drop_kept, keep, map_batches, mix64

#: Runs of letters; the text's A-Z are in lower case by then.
RUN = re.compile("[a-zÀ-ÿ]+")
#: Base of the polynomial that identifies a reduced word modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
#: Distinct words a task holds before it hands its counts on.
HELD_WORDS = 300_000


def word_counts(docs: DataFrame, least_n: int = 3, least_size: int = 5, modulus: int = 97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) over whole texts: words of at least ``least_size`` code points found at least ``least_n`` times.

    A run loses the code point h % length if ``modulus`` divides h, the crc32 of ``<doc_id>:<run>``. Counted within each task first, in tables of at most ``HELD_WORDS`` words and one text's.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if not text.is_valid:
                    continue
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                # bytes.lower() changes A-Z only
                for word, n in Counter(RUN.findall(text.as_buffer().to_pybytes().lower().decode())).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % modulus == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                    if len(word) >= least_size:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield out()
                    held.clear()
        if held:
            yield out()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def reduced(codes: np.ndarray, symbols: int) -> np.ndarray:
    """Symbols 1 to ``symbols`` of code points."""
    return (((codes.astype(np.uint64) * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)) >> np.uint64(13)) % np.uint64(symbols) + np.uint64(1)


def _sums(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and for each row of digits the sums of digit times power over its prefixes."""
    size = d.shape[1]
    powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, BASE, np.uint64)]))
    return powers, np.concatenate([np.zeros((len(d), 1), np.uint64), np.cumsum(d * powers[:size], axis=1, dtype=np.uint64)], axis=1)


def own_keys(d: np.ndarray) -> np.ndarray:
    """The identity of each reduced word."""
    return mix64(_sums(d)[1][:, -1])


def neighbour_keys(d: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): the reduced words one deletion or one replacement by a greater symbol away, each once per row."""
    n, size = d.shape
    powers, before = _sums(d)
    whole = before[:, -1:]
    made = [before[:, :-1] + (whole - before[:, 1:]) * np.uint64(INVERSE)]
    row = [np.repeat(np.arange(n), size)]
    first = np.ones(d.shape, bool)
    first[:, 1:] = d[:, 1:] != d[:, :-1]  # deleting any symbol of a run of one symbol gives the same word
    made[0], row[0] = made[0][first], row[0][first.ravel()]
    for c in range(2, symbols + 1):
        i, j = np.nonzero(d < c)
        made.append(whole[i, 0] + (np.uint64(c) - d[i, j]) * powers[j])
        row.append(i)
    return np.concatenate(row), mix64(np.concatenate(made))


def _by_length(b: pa.RecordBatch, symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, digits) for the words of each length, in slices whose neighbourhoods fit in some megabytes."""
    words = b.column(0)
    sizes = pa.compute.utf8_length(words).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        step = max(1, 1_000_000 // (int(size) * symbols))
        for i in range(0, len(rows), step):
            part = rows[i:i + step]
            codes = np.frombuffer("".join(words.take(pa.array(part)).to_pylist()).encode("utf-32-le"), np.uint32)
            yield part, reduced(codes.reshape(len(part), int(size)), symbols)


def near_pairs(vocabulary: DataFrame, symbols: int = 6) -> DataFrame:
    """(a, a_n, b, b_n): each unordered pair of words of ``vocabulary`` (word, n) exactly one edit apart, once."""
    def own(b: pa.RecordBatch) -> pa.RecordBatch:
        key = np.empty(b.num_rows, np.int64)
        for rows, d in _by_length(b, symbols):
            key[rows] = own_keys(d).view(np.int64)
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(key)], ["word", "n", "key"])

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, d in _by_length(b, symbols):
                row, key = neighbour_keys(d, symbols)
                picked = pa.array(rows[row])
                yield pa.RecordBatch.from_arrays([b.column(0).take(picked), b.column(1).take(picked), pa.array(key.view(np.int64))], ["a", "a_n", "key"])

    keyed = map_batches(vocabulary, own, "word string, n long, key long")
    near = vocabulary.mapInArrow(around, "a string, a_n long, key long")
    # The reduced word itself: words of one reduced form are paired from the smaller.
    rows = near.withColumn("own", F.lit(False)).union(keyed.select(F.col("word").alias("a"), F.col("n").alias("a_n"), "key", F.lit(True)))
    right = keyed.select(F.col("word").alias("b"), F.col("n").alias("b_n"), "key")
    return (rows.join(right.hint("shuffle_hash"), "key")
            .where((~F.col("own") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
            .select("a", "a_n", "b", "b_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: forms followed to the last, by pointer jumping.

    A form is found at least twice as often as its word, so chains have at most 63 steps and no cycle.
    """
    at = keep(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        up = at.select(F.col("word").alias("root"), F.col("root").alias("above"))
        new = keep(at.join(up, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "spelling-roots")
        drop_kept(at)
        moved = new.where("moved").limit(1).count()
        at = new.select("word", "root")
        if not moved:
            return at


def variants(docs: DataFrame, symbols: int = 6, least_n: int = 3, least_size: int = 5, modulus: int = 97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word of the texts: word, form, root, n, n_near, form_n.

    Words are maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` of whole texts, A-Z in lower
    case, some damaged as ``word_counts`` says. Near words differ by one inserted, deleted or
    replaced code point. A word's form is its most frequent near word (ties: the
    smallest in code-point order) if that is found at least twice as often, else null;
    its root is the last of the forms followed from it, or the word itself.

    Null texts have no words, a null id counts as empty text in that crc32; rows
    that repeat an id count like any other. Empty tables give no rows. Other
    columns are not read. Words of any length take part.
    """
    vocabulary = keep(word_counts(docs, least_n, least_size, modulus, id_col, text_col), "spelling-words")
    pairs = near_pairs(vocabulary, symbols)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
                                          F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))).alias("p")).select("p.*")
    # Strings compare by their UTF-8 bytes, which is code-point order.
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    known = keep(vocabulary.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.less") >= 2 * F.col("n"), F.col("best")).alias("best")), "spelling-near")
    known = known.select("word", "n", "n_near", F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))
    roots = _roots(known.where("form is not null"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
