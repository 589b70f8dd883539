"""Exact top-k by inner product with vector-approximation files.

Vectors are integers. A cell block approximates its vectors by one byte per
component (256 cells between the block's least and largest value). Query blocks
meet cell blocks on a grid, never single vectors: the cells give a lower and an
upper bound of every score, and a vector whose upper bound is below the k-th best
lower bound of its block can't be in the result. The surviving (query, vector)
pairs are cut again by the k-th best lower bound over all blocks. Exact vectors are
then read in the order of their upper bounds, some for every query at a time; a
query is done as soon as its k-th exact score is above the next bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import keep, map_batches


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component as double; rows with a null id, null vector, or null or non-finite component drop out.

    Rows that repeat an id count once, with the least of their vectors.
    """
    x = F.transform(F.col(f"`{vector_col}`"), lambda c: c.cast("double"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull())
            .where(finite).select("vec_id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))
            .groupBy("vec_id").agg(F.min("v").alias("v")))


def _matrices(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """ids and matrix, for each dimension that occurs."""
    ids, vectors = b.column(0).to_numpy(), b.column(1)
    sizes = np.diff(vectors.offsets.to_numpy())
    flat, at = vectors.values.to_numpy(), vectors.offsets.to_numpy()
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield ids[rows], flat[at[rows][:, None] + np.arange(d)]


def _blocks(vectors: DataFrame, size: int, make, schema: str) -> DataFrame:
    """One row per block of about ``size`` vectors of equal dimension."""
    n = max(1, -(-vectors.count() // size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:  # a block's vectors, about ``size`` of them
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            for i in range(0, whole.num_rows, 2 * size):
                yield from (make(ids, m) for ids, m in _matrices(whole.slice(i, 2 * size)))

    return vectors.repartition(n, "vec_id").mapInArrow(run, schema)


def _cells(ids: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
    low, high = m.min(0), m.max(0)
    width = np.maximum(1, -(-(high - low + 1) // 256))
    codes = ((m - low) // width).astype(np.uint8)
    return pa.RecordBatch.from_arrays([pa.array([m.shape[1]], pa.int32()), *[pa.array([x.tobytes()]) for x in (ids, low, width, codes)]],
                                      ["dim", "ids", "low", "width", "codes"])


def _queries(ids: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([m.shape[1]], pa.int32()), pa.array([ids.tobytes()]), pa.array([m.tobytes()])], ["dim", "qids", "q"])


def bounds(q: np.ndarray, low: np.ndarray, width: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of q . v for all queries and cells. Rounding of large sums widens them, never narrows."""
    least = low + codes * width
    most = least + (width - 1)
    plus, minus = np.maximum(q, 0).astype(float), np.minimum(q, 0).astype(float)
    least, most = least.astype(float), most.astype(float)
    lower, upper = plus @ least.T + minus @ most.T, plus @ most.T + minus @ least.T
    slack = np.abs(q).astype(float) @ np.maximum(np.abs(least), np.abs(most)).T * (q.shape[1] + 2) * 2.0**-52
    exact = np.where(slack < 0.25, 0.0, slack)
    return np.floor(lower - exact), np.ceil(upper + exact)


def search(rows: DataFrame, is_query, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding",
           query_block: int = 256, cell_block: int = 4096, grid: int = 4, first: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query row with all other rows, ties to the smaller id.

    ``is_query`` is a condition on vec_id. Vectors of another dimension than the
    query's don't take part in it. Of equal vectors only the k + 1 smallest ids
    can be in a result, so only those are searched. Scores must fit in 63 bits.
    ``first`` vectors of a query (4 k) are read before the first look at its bounds.
    """
    vectors = keep(integer_vectors(rows, id_col, vector_col, scale), "va-vectors")
    alike = Window.partitionBy("v").orderBy("vec_id")
    searched = keep(vectors.withColumn("n", F.row_number().over(alike)).where(F.col("n") <= k + 1).select("vec_id", "v"), "va-searched")
    cells = keep(_blocks(searched, cell_block, _cells, "dim int, ids binary, low binary, width binary, codes binary"), "va-cells")
    wanted = keep(vectors.where(is_query), "va-queries")
    queries = keep(_blocks(wanted, query_block, _queries, "dim int, qids binary, q binary"), "va-query-blocks")

    def scan(b: pa.RecordBatch) -> pa.RecordBatch | None:
        out = []
        for row in b.to_pylist():
            d = row["dim"]
            ids, qids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["qids"], np.int64)
            q = np.frombuffer(row["q"], np.int64).reshape(-1, d)
            lower, upper = bounds(q, np.frombuffer(row["low"], np.int64), np.frombuffer(row["width"], np.int64),
                                  np.frombuffer(row["codes"], np.uint8).reshape(-1, d).astype(np.int64))
            own = qids[:, None] == ids[None, :]
            lower[own] = upper[own] = -np.inf
            cut = np.partition(lower, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(qids), -np.inf)
            i, j = np.nonzero((upper >= cut[:, None]) & ~own)
            out.append((qids[i], ids[j], lower[i, j], upper[i, j]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "vec_id", "lower", "upper"])

    near = keep(map_batches(_grid(cells, queries, grid), scan, "query_id long, vec_id long, lower double, upper double"), "va-bounds")
    best = Window.partitionBy("query_id").orderBy(F.desc("lower"), "vec_id")
    kth = near.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).groupBy("query_id").agg(
        F.when(F.count("*") >= k, F.min("lower")).alias("kth"))
    hopeful = near.join(kth, "query_id").where(F.col("kth").isNull() | (F.col("upper") >= F.col("kth"))).select("query_id", "vec_id", "upper")
    return _in_bound_order(keep(hopeful, "va-hopeful"), vectors, wanted, k, 4 * k if first is None else first)


def _grid(cells: DataFrame, queries: DataFrame, side: int) -> DataFrame:
    """All pairs of a cell block and a query block of one dimension: a stated query set against all rows, in blocks.

    Both are dealt to groups of about ``side`` blocks, and every pair of groups is a key of its own.
    """
    groups = {d: (-(-c // side), -(-q // side)) for d, c, q in cells.groupBy("dim").agg(F.count("*").alias("c")).join(
        queries.groupBy("dim").agg(F.count("*").alias("q")), "dim").collect()}  # one row per dimension
    if not groups:
        return cells.join(queries, "dim").select("dim", "ids", "low", "width", "codes", "qids", "q")
    many = cells.sparkSession.createDataFrame([(d, c, q) for d, (c, q) in groups.items()], "dim int, n_c int, n_q int")
    left = (cells.join(F.broadcast(many), "dim").withColumn("c", F.pmod(F.xxhash64("ids"), "n_c")).withColumn("g", F.explode(F.sequence(F.lit(0), F.col("n_q") - 1)))
            .select("dim", "c", "g", "ids", "low", "width", "codes"))
    right = (queries.join(F.broadcast(many), "dim").withColumn("g", F.pmod(F.xxhash64("qids"), "n_q").cast("int")).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("n_c") - 1)))
             .select("dim", F.col("c").cast("long").alias("c"), "g", "qids", "q"))
    return left.join(right, ["dim", "c", "g"]).select("dim", "ids", "low", "width", "codes", "qids", "q")


def _in_bound_order(left: DataFrame, vectors: DataFrame, wanted: DataFrame, k: int, size: int) -> DataFrame:
    """The k best of each query among ``left`` (query_id, vec_id, upper), exact vectors read by falling upper bound.

    Each round reads the next ``size`` vectors of every query that isn't done, twice as many
    as the round before; what lies below a query's k-th exact score is never read.
    """
    product = F.aggregate(F.zip_with("cv", "qv", lambda a, b: a * b), F.lit(0).cast("long"), lambda a, x: a + x)
    by_bound = Window.partitionBy("query_id").orderBy(F.desc("upper"), "vec_id")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = None
    while True:
        # A limit per query runs in each task before rows meet.
        now = keep(left.withColumn("n", F.row_number().over(by_bound)).where(F.col("n") <= size).drop("n"), "va-read")
        scored = (now.join(vectors.withColumnRenamed("v", "cv"), "vec_id").join(wanted.select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv")), "query_id")
                  .select("query_id", "vec_id", product.alias("score")))
        so_far = scored if best is None else best.select("query_id", "vec_id", "score").union(scored)
        best = keep(so_far.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k), "va-best")
        last = now.groupBy("query_id").agg(F.min_by(F.struct("upper", "vec_id"), F.struct("upper", -F.col("vec_id"))).alias("last"))
        kth = best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
        behind = (F.col("upper") < F.col("last.upper")) | ((F.col("upper") == F.col("last.upper")) & (F.col("vec_id") > F.col("last.vec_id")))
        open_ = left.join(last, "query_id").join(kth, "query_id").where(behind & (F.col("kth").isNull() | (F.col("upper") >= F.col("kth"))))
        left = keep(open_.select("query_id", "vec_id", "upper"), "va-hopeful")
        if not left.limit(1).count():
            return best.select("query_id", "rank", "vec_id", "score")
        size *= 2
