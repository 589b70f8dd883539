"""Exact order statistics by radix selection: counts move between tasks, values don't.

Doubles map to 64-bit keys of the same order. A pass over the rows counts, for
every column at once, the keys by their next 16 bits; the bucket that holds a
wanted rank is the only one looked into by the next pass, so at most four passes
reach the value itself. A pass is skipped or cut short where it can be, without
another result:

* a task counts whole keys as long as a column has at most ``HELD_KEYS`` of them,
  and buckets from then on; a column all of whose tasks still held whole keys is
  finished after the first pass;
* once the buckets looked into hold at most ``SMALL_ROWS`` rows, their values are
  counted one by one and collected.

All ranks of all columns share the passes. The driver holds one number per
column and rank, and up to ``DRIVER_ROWS`` bucket counts; the exchanges carry bucket
counts: at most 65,536 for each column and bucket looked into, however many rows there are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BITS = 16
#: Distinct keys of a column that a task counts one by one before it turns to buckets.
HELD_KEYS = 4096
#: Rows of all buckets looked into whose values may be collected.
SMALL_ROWS = 50_000
#: Bucket counts that are collected and summed up by the driver; beyond, a window does it.
DRIVER_ROWS = 200_000
#: Codes a task holds before it adds up equal ones.
HELD_CODES = 500_000

_SIGN = np.uint64(1 << 63)


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """64-bit keys in the order of doubles; -0.0 is 0.0, and NaN, as in Spark, the largest value."""
    x = x + 0.0
    x[np.isnan(x)] = np.nan
    b = x.view(np.uint64)
    return np.where(b & _SIGN, ~b, b | _SIGN)


def from_bits(key: int) -> float:
    """The double of an ordered key."""
    b = np.uint64(key)
    return float(np.array([b & ~_SIGN if b & _SIGN else ~b], np.uint64).view(np.float64)[0])


def _signed(key: np.ndarray) -> np.ndarray:
    """Keys as longs of the same order, as Spark stores them."""
    return (key ^ _SIGN).view(np.int64)


class _Counts:
    """Counts of int64 codes, added up now and then."""

    def __init__(self) -> None:
        self.codes, self.n, self.new, self.size = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

    def add(self, codes: np.ndarray) -> None:
        if len(codes):
            self.new.append(codes)
            self.size += len(codes)
            if self.size > HELD_CODES:
                self.settle()

    def settle(self) -> None:
        if self.new:
            codes, n = np.unique(np.concatenate(self.new), return_counts=True)
            self.new, self.size = [], 0
            self.codes, at = np.unique(np.concatenate([self.codes, codes]), return_inverse=True)
            self.n = np.bincount(at, np.concatenate([self.n, n]), len(self.codes)).astype(np.int64)


@dataclass
class _Column:
    """What is known of a column: its rows, and for each wanted rank the key's upper bits and the rank among keys with these."""
    n: int = 0
    at: dict[int, tuple[int, int]] = field(default_factory=dict)
    found: dict[int, float] = field(default_factory=dict)


def _doubles(b: pa.RecordBatch, i: int) -> np.ndarray:
    return b.column(i).drop_null().to_numpy(zero_copy_only=False).astype(np.float64)


def _rows(i: int, whole: bool, above: np.ndarray, code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    size = len(code)
    return pa.RecordBatch.from_arrays([pa.array(np.full(size, i, np.int32)), pa.array(np.full(size, whole)), pa.array(above.astype(np.int64)), pa.array(code), pa.array(n)],
                                      ["column", "whole", "above", "code", "n"])


_COUNTS = "column int, whole boolean, above long, code long, n long"


def _first_pass(values: DataFrame, n_columns: int) -> DataFrame:
    """Counts of whole keys while there are few, else of their upper bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, whole = [_Counts() for _ in range(n_columns)], [True] * n_columns
        for b in batches:
            for i in range(n_columns):
                codes = _signed(ordered_bits(_doubles(b, i)))
                held[i].add(codes if whole[i] else codes >> (64 - BITS))
                if whole[i]:
                    held[i].settle()
                    if len(held[i].codes) > HELD_KEYS:
                        whole[i], keys = False, held[i]
                        held[i] = _Counts()
                        held[i].codes, at = np.unique(keys.codes >> (64 - BITS), return_inverse=True)
                        held[i].n = np.bincount(at, keys.n, len(held[i].codes)).astype(np.int64)
        for i, c in enumerate(held):
            c.settle()
            if len(c.codes):
                yield _rows(i, whole[i], np.zeros(len(c.codes)), c.codes, c.n)

    return values.mapInArrow(run, _COUNTS).groupBy("column", "whole", "above", "code").agg(F.sum("n").alias("n"))


def _next_pass(values: DataFrame, open_at: dict[int, list[int]], depth: int, whole: bool) -> DataFrame:
    """Of the keys whose upper ``depth`` bits are looked into, counts by the next bits, or of the ``whole`` keys.

    ``above`` numbers the looked into upper bits of a column.
    """
    wanted = {i: np.array(sorted(p), np.int64) for i, p in open_at.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {i: _Counts() for i in wanted}
        for b in batches:
            for i, upper in wanted.items():
                key = _signed(ordered_bits(_doubles(b, i)))
                mine = key >> (64 - depth)
                at = np.minimum(np.searchsorted(upper, mine), len(upper) - 1)
                inside = upper[at] == mine
                held[i].add(key[inside] if whole else at[inside] << BITS | (key[inside] >> (64 - depth - BITS)) & ((1 << BITS) - 1))
        for i, c in held.items():
            c.settle()
            if len(c.codes):
                yield _rows(i, whole, np.searchsorted(wanted[i], c.codes >> (64 - depth)) if whole else c.codes >> BITS,
                            c.codes if whole else c.codes & ((1 << BITS) - 1), c.n)

    return values.mapInArrow(run, _COUNTS).groupBy("column", "whole", "above", "code").agg(F.sum("n").alias("n"))


def _gathered(counts: DataFrame) -> list[tuple[int, int, int, int, bool]] | None:
    """(column, above, code, n, whole) rows, if there are at most ``DRIVER_ROWS``."""
    rows = counts.select("column", "above", "code", "n", "whole").limit(DRIVER_ROWS + 1).collect()
    return [tuple(r) for r in rows] if len(rows) <= DRIVER_ROWS else None


def _locate_rows(counts: Iterable[tuple[int, int, int, int]], wanted: list[tuple[int, int, int]]) -> dict[tuple[int, int, int], tuple[int, int, int]]:
    """``_locate`` on gathered counts (column, above, code, n)."""
    held: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for column, above, code, n in counts:
        held.setdefault((column, above), []).append((code, n))
    ends = {at: (found := sorted(rows), np.cumsum([n for _, n in found])) for at, rows in held.items()}
    out = {}
    for column, above, rank in set(wanted):
        found, end = ends[column, above]
        i = int(np.searchsorted(end, rank, side="right"))
        out[column, above, rank] = (found[i][0], rank - int(end[i]) + found[i][1], found[i][1])
    return out


def _locate(counts: DataFrame, wanted: list[tuple[int, int, int]]) -> dict[tuple[int, int, int], tuple[int, int, int]]:
    """(column, above, rank) -> (code, rank within the code, n): a running sum over the bucket counts of each column."""
    if not wanted:
        return {}
    spark = counts.sparkSession
    by = Window.partitionBy("column", "above").orderBy("code").rowsBetween(Window.unboundedPreceding, 0)
    ends = counts.withColumn("end", F.sum("n").over(by))
    ranks = spark.createDataFrame(sorted(set(wanted)), "column int, above long, rank long")
    hit = ends.join(F.broadcast(ranks), ["column", "above"]).where((F.col("rank") < F.col("end")) & (F.col("rank") >= F.col("end") - F.col("n")))
    return {(r["column"], r["above"], r["rank"]): (r["code"], r["rank"] - (r["end"] - r["n"]), r["n"]) for r in hit.collect()}


def select_ranks(df: DataFrame, cols: list[str], wanted: Callable[[str, int], Iterable[int]]) -> dict[str, tuple[int, dict[int, float]]]:
    """For each column its number of non-null values n and the values, as doubles, at the 0-based ranks ``wanted(column, n)``.

    Ranks beyond n are left out. Equal values take ranks next to each other. A
    column of nulls, or a table without rows, has n = 0 and no values.
    """
    out: dict[str, tuple[int, dict[int, float]]] = {}
    for at in range(0, len(cols), 64):  # so many columns share the passes
        out |= _select(df, cols[at:at + 64], wanted)
    return out


def _select(df: DataFrame, cols: list[str], wanted: Callable[[str, int], Iterable[int]]) -> dict[str, tuple[int, dict[int, float]]]:
    values = df.select(*[F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate(cols)])
    columns = [_Column() for _ in cols]
    first = _first_pass(values, len(cols)).persist()  # at most 65,536 buckets, or HELD_KEYS keys of each task, for each column
    try:
        rows = _gathered(first)
        if rows is None:
            buckets = (first.select("column", "above", F.when(F.col("whole"), F.shiftright("code", 64 - BITS)).otherwise(F.col("code")).alias("code"), "whole", "n")
                       .groupBy("column", "above", "code").agg(F.sum("n").alias("n"), F.min("whole").alias("whole"), F.count("*").alias("keys")))
            sizes = {r["column"]: (r["n"], r["whole"], r["keys"]) for r in
                     buckets.groupBy("column").agg(F.sum("n").alias("n"), F.min("whole").alias("whole"), F.sum("keys").alias("keys")).collect()}
        else:
            sizes, upper = {}, {}
            for i, above, code, n, whole in rows:
                old = sizes.get(i, (0, True, 0))
                sizes[i] = (old[0] + n, old[1] and whole, old[2] + 1)
                at = (i, above, code >> (64 - BITS) if whole else code)
                upper[at] = upper.get(at, 0) + n
        for i, (n, _, _) in sizes.items():
            columns[i].n = n
        ranks = {i: sorted({r for r in wanted(cols[i], c.n) if 0 <= r < c.n}) for i, c in enumerate(columns)}
        done = {i for i, (_, whole, keys) in sizes.items() if whole and keys <= 1 << BITS}
        exact = [(i, 0, r) for i in done for r in ranks[i]]
        todo = [(i, 0, r) for i in range(len(cols)) if i not in done for r in ranks[i]]
        if rows is None:
            keys = _locate(first.where(F.col("column").isin(*done)), exact) if done else {}
            hit = _locate(buckets.select("column", "above", "code", "n"), todo)
        else:
            keys = _locate_rows(((i, above, code, n) for i, above, code, n, _ in rows if i in done), exact)
            hit = _locate_rows(((*at, n) for at, n in upper.items()), todo)
        for (i, _, rank), (key, _, _) in keys.items():
            columns[i].found[rank] = from_bits(key + 2**63)
    finally:
        first.unpersist()
    rows = {(i, code): n for (i, _, _), (code, _, n) in hit.items()}
    for (i, _, rank), (code, left, _) in hit.items():
        columns[i].at[rank] = (code, left)
    depth = BITS
    while depth < 64 and any(c.at for c in columns):
        open_at = {i: sorted({upper for upper, _ in c.at.values()}) for i, c in enumerate(columns) if c.at}
        whole = sum(rows.values()) <= SMALL_ROWS
        counts = _next_pass(values, open_at, depth, whole)
        places = {(i, upper): k for i, uppers in open_at.items() for k, upper in enumerate(uppers)}
        if whole:
            kept: dict[tuple[int, int], list[tuple[int, int]]] = {}
            for r in counts.collect():  # SMALL_ROWS rows at most
                kept.setdefault((r["column"], r["above"]), []).append((r["code"], r["n"]))
            ends = {at: (sorted(found), np.cumsum([n for _, n in sorted(found)])) for at, found in kept.items()}
            for i, c in enumerate(columns):
                for rank, (upper, left) in c.at.items():
                    found, end = ends[i, places[i, upper]]
                    c.found[rank] = from_bits(found[int(np.searchsorted(end, left, side="right"))][0] + 2**63)
                c.at = {}
            break
        todo = [(i, places[i, upper], left) for i, c in enumerate(columns) for upper, left in c.at.values()]
        held = _gathered(counts)
        hit = _locate(counts.select("column", "above", "code", "n"), todo) if held is None else _locate_rows((r[:4] for r in held), todo)
        rows = {}
        for i, c in enumerate(columns):
            for rank, (upper, left) in c.at.items():
                code, inside, n = hit[i, places[i, upper], left]
                c.at[rank] = (upper << BITS | code, inside)
                rows[i, c.at[rank][0]] = n
        depth += BITS
    for c in columns:
        c.found |= {rank: from_bits(upper + 2**63) for rank, (upper, _) in c.at.items()}
    return {name: (c.n, c.found) for name, c in zip(cols, columns, strict=True)}


def quantile_ranks(n: int, probs: Iterable[float]) -> set[int]:
    """Ranks between which quantiles of n values lie."""
    return {r for p in probs for r in (math.floor((n - 1) * p), math.ceil((n - 1) * p))} if n else set()


def interpolated(n: int, value: Callable[[int], float], p: float) -> float | None:
    """Linear-interpolation quantile (numpy default, SQL ``percentile_cont``) of n values from those at its ranks."""
    if not n:
        return None
    h = (n - 1) * p
    lo, hi = math.floor(h), math.ceil(h)
    low, high = value(lo), value(hi)
    return low if low == high else low + (h - lo) * (high - low)


def quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> dict[str, dict[float, float | None]]:
    """Exact quantiles of the non-null values of each column; None where there are none."""
    found = select_ranks(df, cols, lambda _, n: quantile_ranks(n, probs))
    return {c: {p: interpolated(n, at.__getitem__, p) for p in probs} for c, (n, at) in found.items()}
