"""Packing documents into sequences as a cutting-stock problem, by column generation.

Documents are tokenized and cut into pieces of at most the sequence's size;
pieces are counted by length class (``grain`` tokens wide, so the histogram has
a fixed size). A linear program over patterns (how many pieces of each class a
sequence holds) is solved by column generation: the simplex basis gives prices,
a knapsack dynamic program finds the pattern worth most at these prices, until
none is worth more than a sequence. Patterns are rounded down; what the
rounding leaves is packed largest first. Only the histogram and the patterns
(bounded by the number of classes) are on the driver. Pieces get a rank in
their class from (task, place in task) and the tasks' counts; ranges of ranks
belong to patterns, so every piece finds its sequence by its rank alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import keep, null_id, with_id
from quarry.llm.tokens import encoder


def best_pattern(price: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of most worth, any number of pieces of each size: knapsack dynamic program over the room used."""
    at = np.full(capacity + 1, -np.inf)  # price by size
    at[sizes] = price
    of = np.zeros(capacity + 1, np.int64)
    of[sizes] = np.arange(len(sizes))
    least = int(sizes.min())
    worth = np.zeros(capacity + 1)
    taken = np.full(capacity + 1, -1)
    for room in range(least, capacity + 1):
        value = at[least:room + 1] + worth[room - least::-1]
        i = int(value.argmax())
        if value[i] > worth[room - 1] + 1e-12:
            worth[room], taken[room] = value[i], of[least + i]
        else:
            worth[room] = worth[room - 1]
    pattern, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if taken[room] < 0:
            room -= 1
        else:
            pattern[taken[room]] += 1
            room -= int(sizes[taken[room]])
    return float(worth[capacity]), pattern


def inverted(a: np.ndarray) -> np.ndarray:
    """Inverse of a regular matrix by row elimination, element by element.

    The driver holds a JVM session, beside which LAPACK's threads can wait for ever.
    """
    m = len(a)
    left, right = a.astype(float), np.eye(m)
    for j in range(m):
        i = j + int(np.abs(left[j:, j]).argmax())
        if i != j:
            left[[i, j]], right[[i, j]] = left[[j, i]], right[[j, i]]
        right[j] /= left[j, j]
        left[j] /= left[j, j]
        factor = left[:, j].copy()
        factor[j] = 0.0
        left -= factor[:, None] * left[j]
        right -= factor[:, None] * right[j]
    return right


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-3) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often each is used, in a solution of the linear program that meets the demand.

    It ends within ``gap`` of a lower bound (of the prices, or the room that all
    pieces take), or if 4 m steps in a row gained less than that together, as
    happens where many pieces are alike in price.
    """
    m = len(sizes)
    columns = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / np.diag(columns))
    used = (inverse * demand).sum(1)
    bound, mark, step = float((sizes * demand).sum()) / capacity, np.inf, 0
    while True:
        price = inverse.sum(0)
        worth, pattern = best_pattern(price, sizes, capacity)
        bound = max(bound, float(used.sum()) / max(worth, 1.0))
        if worth <= 1 + 1e-9 or used.sum() <= bound * (1 + gap):
            break
        if step % (4 * m) == 0:
            if used.sum() > mark * (1 - gap):
                break
            mark = used.sum()
        step += 1
        held = np.flatnonzero(pattern)
        move = (inverse[:, held] * pattern[held]).sum(1)
        ratio = np.where(move > 1e-9, used / np.where(move > 1e-9, move, 1), np.inf)
        out = int(ratio.argmin())
        amount = max(0.0, ratio[out])
        used -= amount * move
        used[out] = amount
        row = inverse[out] / move[out]
        inverse -= move[:, None] * row
        inverse[out] = row
        columns[:, out] = pattern
        if step % 200 == 0:  # rounding errors don't add up
            inverse = inverted(columns)
            used = (inverse * demand).sum(1)
    return [(columns[:, j].astype(np.int64), max(0.0, float(used[j]))) for j in range(m)]


def plan(lengths: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Whole numbers of patterns that hold exactly the pieces counted in ``lengths`` (class size -> pieces)."""
    sizes = np.array(sorted(lengths), np.int64)
    if not len(sizes):
        return []
    left = np.array([lengths[s] for s in sizes.tolist()], np.int64)
    out = []
    for pattern, used in column_generation(sizes, left.astype(float), capacity):
        n = int(used + 1e-7)
        fits = pattern > 0
        n = min([n, *(left[fits] // pattern[fits]).tolist()])
        if n:
            out.append((pattern, n))
            left = left - n * pattern
    while left.any():  # what rounding left, largest first
        pattern, room = np.zeros(len(sizes), np.int64), capacity
        for i in range(len(sizes) - 1, -1, -1):
            pattern[i] = min(left[i], room // sizes[i])
            room -= int(pattern[i] * sizes[i])
        fits = pattern > 0
        n = int((left[fits] // pattern[fits]).min())
        out.append((pattern, n))
        left = left - n * pattern
    return [({int(s): int(c) for s, c in zip(sizes, p, strict=True) if c}, n) for p, n in out]


def ranges(patterns: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each class, rows (first rank, pieces per sequence, first sequence), ascending."""
    at: dict[int, int] = {}
    out: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for pattern, n in patterns:
        for size, count in pattern.items():
            out.setdefault(size, []).append((at.get(size, 0), count, sequence))
            at[size] = at.get(size, 0) + count * n
        sequence += n
    return {s: np.array(r, np.int64) for s, r in out.items()}


def _pieces(docs: DataFrame, path: str, capacity: int, grain: int, with_ids: bool) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, size class, task, rank in task and class[, ids])."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(-(-capacity // grain) + 1, np.int64)
        for b in batches:
            rows = []
            for doc_id, data in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist()), strict=True):
                n = len(data) // 4
                for a in range(0, n, capacity):
                    part = data[4 * a:4 * (a + capacity)]
                    size = -(-(len(part) // 4) // grain)
                    rows.append((doc_id, a, len(part) // 4, zlib.crc32(part), n, size, task, int(seen[size]), part))
                    seen[size] += 1
            cols = list(zip(*rows, strict=True))
            arrays = [pa.array(c, pa.int64()) for c in cols[:-1]]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(p, np.uint32).astype(np.int32) for p in cols[-1]], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "size", "task", "place"] + ["ids"] * with_ids
    return docs.mapInArrow(run, ", ".join(f"{n} long" for n in names[:8]) + ", ids array<int>" * with_ids)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, grain: int = 8, id_col: str = "doc_id", text_col: str = "text",
         with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, on demand).

    Null and empty texts have their end id alone. Rows that repeat an id are
    packed each for itself. Pieces of a sequence lie without gaps, in order of
    (doc_id, start). ``tokenizer`` is the path of a tokenizers file.
    """
    spark = docs.sparkSession
    pieces = keep(_pieces(with_id(docs, id_col, text_col), tokenizer, capacity, grain, with_ids), "pieces")
    counts = keep(pieces.groupBy("task", "size").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}  # capacity / grain rows at most
    table = spark.sparkContext.broadcast(ranges(plan(histogram, capacity // grain)))
    before = counts.select("task", "size", (F.sum("n").over(Window.partitionBy("size").orderBy("task")) - F.col("n")).alias("before"))
    ranked = pieces.join(before, ["task", "size"]).withColumn("rank", F.col("before") + F.col("place")).drop("before", "place", "task")

    def place(b: pa.RecordBatch) -> pa.RecordBatch:
        size, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("size", "rank"))
        out = np.zeros(len(size), np.int64)
        for s in np.unique(size):
            of = np.flatnonzero(size == s)
            r = table.value[int(s)]
            i = np.searchsorted(r[:, 0], rank[of], side="right") - 1
            out[of] = r[i, 2] + (rank[of] - r[i, 0]) // r[i, 1]
        names = [n for n in b.schema.names if n not in ("size", "rank")]
        return pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(n)) for n in names], pa.array(out)], [*names, "sequence_id"])

    kept = [f for f in ranked.schema.fields if f.name not in ("size", "rank")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", sequence_id long"
    placed = ranked.mapInArrow(lambda batches: (place(b) for b in batches if b.num_rows), schema)
    row = Window.partitionBy("sequence_id").orderBy("doc_id", "start", "ids_crc32")
    end = F.sum("length").over(row.rowsBetween(Window.unboundedPreceding, 0))
    columns = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id"]
    return placed.withColumn("offset", end - F.col("length")).select(null_id("doc_id"), *columns, "offset", *["ids"] * with_ids)


def sequences(pieces: DataFrame, capacity: int = 2048, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids, n_tokens) of what ``pack`` returned with ids: padded to ``capacity``, except at a power of two."""
    rows = pieces.select("sequence_id", F.struct("offset", "ids").alias("p")).groupBy("sequence_id").agg(F.sort_array(F.collect_list("p")).alias("p"))
    ids = F.flatten(F.transform("p", lambda p: p["ids"]))
    whole = rows.select("sequence_id", ids.alias("ids")).withColumn("n_tokens", F.size("ids"))
    exact = F.bit_count(F.col("n_tokens")) == 1
    pad = F.when(exact, F.array().cast("array<int>")).otherwise(F.array_repeat(F.lit(pad_id), F.lit(capacity) - F.col("n_tokens")))
    return whole.select("sequence_id", F.concat("ids", pad).alias("ids"), "n_tokens")
