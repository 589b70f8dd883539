"""Benchmark decontamination by SimHash windows, in DataFrame functions only.

Documents and benchmark items become words (letters and digits, lower case).
For an item of L words, a window is L words of a document. Windows are
fingerprinted with a 64-bit SimHash over their five-word shingles and matched
to item fingerprints of the same L through multi-index Hamming blocks: 64 bits
in ``radius`` + 1 blocks, so two fingerprints within the radius agree in at
least one block. Candidates are verified exactly: weighted similarity of the
shingle multisets, sum of minima over sum of maxima, weight the number of
characters of a shingle, at least ``threshold``.

A window can only be similar to an item if its shingles that the item has, in
whatever order, weigh at least ``threshold`` times the item. So the benchmark's
shingles are joined to the documents' (broadcast if they are counted to be few,
else a shuffled join), a running sum over a document's shared shingles gives
their weight in every window, and only windows that reach the bound are
fingerprinted. A document shorter than the item is one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import NULL_ID, keep, null_id, with_id

#: Benchmark shingles up to this count are broadcast (about 60 bytes each).
BROADCAST_SHINGLES = 1_000_000


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")


def _shingle_hashes(words: Column, k: int) -> Column:
    """xxhash64 of every k words in a row; empty if there are fewer than k."""
    joined = F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.xxhash64(F.slice(words, i, k)))
    return F.when(F.size(words) >= k, joined).otherwise(F.array().cast("array<long>"))


def _weighted(rows: DataFrame, keys: list[str], words: str, k: int) -> DataFrame:
    """(keys, h, n, weight): each distinct shingle of a word array, its count and its number of characters."""
    pieces = F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.slice(F.col(words), i, k))
    out = rows.select(*keys, F.explode(pieces).alias("w"))
    size = F.aggregate("w", F.lit(0), lambda a, x: a + F.length(x)).cast("long")
    return (out.select(*keys, F.xxhash64("w").alias("h"), size.alias("weight"))
            .groupBy(*keys, "h").agg(F.count("*").alias("n"), F.max("weight").alias("weight")))


def _simhash(shingles: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fp): bit b is set where the weighted votes of the shingles' b-th bits are positive."""
    votes = [F.sum(F.when(F.shiftright("h", b).bitwiseAND(F.lit(1)) == 1, F.col("n") * F.col("weight"))
                   .otherwise(-F.col("n") * F.col("weight"))).alias(f"v{b}") for b in range(64)]
    rows = shingles.groupBy(*keys).agg(*votes)
    fp = F.lit(0).cast("long")
    for b in range(64):
        fp = fp.bitwiseOR(F.shiftleft(F.when(F.col(f"v{b}") > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")), b))
    return rows.select(*keys, fp.alias("fp"))


def _blocks(fp: str, radius: int) -> Column:
    """The radius + 1 blocks of a fingerprint, as (number, value)."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(F.col(fp), a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value"))
                     for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))])


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, k: int = 5, radius: int = 20, id_col: str = "doc_id",
            text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity, hamming): for each document and item the best window, the first of equal ones.

    Null and empty texts, and documents or items of fewer than ``k`` words,
    match nothing. A window has as many words as the item, or is the whole of
    a shorter document. Items of equal words match alike, each under its own id.
    Rows that repeat a document id count as one document with their best
    window; a null item id is returned as null, as is a null document id.
    """
    items = (with_id(benchmark, item_col, item_text_col, "item_id", "text").select("item_id", _words(F.col("text")).alias("words"))
             .where(F.size("words") >= k))
    classes = keep(items.groupBy("words").agg(F.min("item_id").alias("item"), F.collect_set("item_id").alias("ids"))
                   .select("item", "ids", "words", F.size("words").alias("length")), "bench-items")
    places = keep(classes.select("item", "length", F.posexplode(_shingle_hashes(F.col("words"), k)).alias("at", "h")), "bench-places")
    of_item = keep(_weighted(classes, ["item", "length"], "words", k), "bench-item-shingles")
    total = lambda rows, keys, name: rows.groupBy(*keys).agg(F.sum(F.col("n") * F.col("weight")).alias(name))
    item_totals = total(of_item, ["item"], "total")
    firsts = places.groupBy("item", "h").agg(F.min("at").alias("first"))
    wanted = keep(places.join(of_item.select("item", "h", "weight"), ["item", "h"]).join(firsts, ["item", "h"]).join(item_totals, "item")
                  .select("h", "item", "length", "at", "weight", "total", (F.col("at") == F.col("first")).alias("first")), "bench-wanted")
    few = wanted.count() <= BROADCAST_SHINGLES
    text = with_id(docs, id_col, text_col)
    # Rows of one id with different texts are told apart by the hash of their words.
    rows = (text.select("doc_id", _words(F.col("text")).alias("words")).where(F.size("words") >= k).withColumn("row", F.xxhash64("words")))
    hashes = rows.select("doc_id", "row", F.size("words").alias("size"), F.posexplode(_shingle_hashes(F.col("words"), k)).alias("pos", "h"))
    one = ["doc_id", "row", "item"]
    hits = keep(hashes.join(F.broadcast(wanted) if few else wanted, "h").drop("h").distinct(), "bench-hits")
    # Where a whole item stands as it is, only an earlier window of all its shingles could be the first of the most similar.
    aligned = hits.groupBy(*one, "length", (F.col("pos") - F.col("at")).alias("start")).agg(F.count("*").alias("votes"))
    whole = aligned.where(F.col("votes") > F.col("length") - k).groupBy(*one).agg(F.min("start").alias("whole"))
    shares = hits.where("first")
    hopeful = (shares.groupBy(*one).agg(F.sum("weight").alias("share"), F.max("total").alias("total"))
               .where(F.col("share") >= F.col("total") * threshold - 1e-6).select(*one).join(whole.hint("merge"), one, "left"))
    # A shingle at pos is in the windows that start at pos - (length - k) to pos.
    change = F.explode(F.array(F.struct((F.col("pos") - F.col("length") + k).alias("start"), F.col("weight").alias("by")),
                               F.struct((F.col("pos") + 1).alias("start"), (-F.col("weight")).alias("by"))))
    changes = (shares.join(hopeful.hint("merge"), one).select(*one, "length", "size", "total", "whole", change.alias("c"))
               .groupBy(*one, "length", "size", "total", "whole", "c.start").agg(F.sum("c.by").alias("by")))
    along = Window.partitionBy(*one).orderBy("start")
    steps = (changes.withColumn("share", F.sum("by").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
             .withColumn("until", F.lead("start").over(along) - 1)
             .where(F.col("share") >= F.col("total") * F.when(F.col("whole").isNull(), threshold).otherwise(1.0) - 1e-6))
    low, high = F.greatest("start", F.lit(0)), F.least("until", F.greatest(F.col("size") - F.col("length"), F.lit(0)), "whole")
    starts = keep(steps.select("doc_id", "row", "length", low.alias("low"), high.alias("high")).where("low <= high")
                  .select("doc_id", "row", "length", F.explode(F.sequence("low", "high")).alias("start")).distinct(), "bench-starts")
    per_doc = starts.groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "length")).alias("spots"))
    spots = rows.join(per_doc, ["doc_id", "row"]).select("doc_id", "words", F.explode("spots").alias("s"))
    windows = keep(spots.select("doc_id", F.col("s.start").alias("start"), F.col("s.length").alias("length"),
                                F.expr("slice(words, s.start + 1, s.length)").alias("words")), "bench-windows")
    # One fingerprint for each distinct window text: copies of a passage are fingerprinted and verified once.
    windows = windows.withColumn("n_words", F.size("words")).withColumn("d1", F.xxhash64("words")).withColumn("d2", F.md5(F.concat_ws(" ", "words")))
    key = ["length", "d1", "d2"]
    texts = keep(windows.groupBy(*key).agg(F.first("words").alias("words")), "bench-texts")
    of_window = keep(_weighted(texts, key, "words", k), "bench-window-shingles")
    left = _simhash(of_window, key).select(*key, "fp", F.explode(_blocks("fp", radius)).alias("b"))
    right = _simhash(of_item, ["item", "length"]).select("item", "length", F.col("fp").alias("item_fp"), F.explode(_blocks("fp", radius)).alias("b"))
    near = (left.join(right, ["length", "b"]).withColumn("hamming", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))))
            .where(F.col("hamming") <= radius).select(*key, "item", "hamming").distinct())
    near = keep(near.join(total(of_window, key, "tw"), key).join(total(of_item, ["item", "length"], "ti"), ["item", "length"]), "bench-near")
    shared = (near.join(of_window, key).join(of_item.select("item", "length", "h", F.col("n").alias("m")), ["item", "length", "h"])
              .groupBy(*key, "item", "hamming", "tw", "ti").agg(F.sum(F.least("n", "m") * F.col("weight")).alias("both")))
    alike = keep(shared.withColumn("similarity", F.col("both") / (F.col("tw") + F.col("ti") - F.col("both")))
                 .where(F.col("similarity") >= threshold).select(*key, "item", "hamming", "similarity"), "bench-alike")
    best = F.max_by(F.struct("start", "n_words", "similarity", "hamming"), F.struct("similarity", -F.col("start")))
    found = windows.select("doc_id", "start", "n_words", *key).join(alike, key).groupBy("doc_id", "item").agg(best.alias("b"))
    named = found.join(classes.select("item", F.explode("ids").alias("item_id")), "item")
    return named.select(null_id("doc_id"), F.when(F.col("item_id") != NULL_ID, F.col("item_id")).alias("item_id"), F.col("b.start").cast("long").alias("start_word"),
                        F.col("b.n_words").cast("long").alias("n_words"), F.col("b.similarity").alias("similarity"), F.col("b.hamming").alias("hamming"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kwargs) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; all columns as they were."""
    bad = matches(docs, benchmark, id_col=id_col, text_col=text_col, **kwargs).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad.hint("merge"), F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("_bad")), "left_anti")
