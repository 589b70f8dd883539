"""C0 value frequency table and the exact quantile machinery built on it.

``value_frequency`` unpivots the selected columns into ``(column, value)`` and
counts once with map-side partial aggregation, replacing p separate
``count(distinct)`` (which Catalyst would plan as an Expand of p copies into a
two-level aggregate anyway) and feeding nunique, top-k, entropy, mode and
quantiles.

``exact_quantiles`` is exact at any scale: the frequency table is range
partitioned on (column, value), every task sums its sorted rows as they pass, the
per-partition totals (one row for each column and partition it reaches) give
each task its global offset, and of the ranked rows only those go on whose
interval holds the rank of a requested probability. No task ever
holds all values of a column, unlike the ``percentile`` aggregate whose buffer
keeps every distinct value of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import ensure_checkpoint_dir, materialize


def value_frequency(df: DataFrame, cols: list[str] | None = None, value_type: str = "string",
                    drop_null: bool = False) -> DataFrame:
    """``(column, value, n)`` counts per column, NULL counted as a value."""
    cols = list(cols or df.columns)
    stacked = df.select(*[F.col(c).cast(value_type).alias(c) for c in cols]).unpivot(
        [], cols, "column", "value")
    if drop_null:
        stacked = stacked.filter(F.col("value").isNotNull())
    return stacked.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def numeric_frequency(df: DataFrame, cols: list[str]) -> DataFrame:
    """Non-null numeric values as doubles: ``(column, value double, n)``.

    Integers and decimals from 2**53 on that are one double keep a row each, so
    that rows count distinct values.
    """
    exact = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.LongType, T.DecimalType))}
    if not exact & set(cols):
        return value_frequency(df, cols, "double", drop_null=True)

    def pair(c: str):
        x = F.col(c)
        own = F.when(F.abs(x.cast("double")) >= float(2**53), x.cast("string")) if c in exact else F.lit(None).cast("string")
        return F.struct(x.cast("double").alias("value"), own.alias("own")).alias(c)

    stacked = df.select(*[pair(c) for c in cols]).unpivot([], cols, "column", "v")
    return (stacked.select("column", F.col("v.value").alias("value"), F.col("v.own").alias("own")).filter(F.col("value").isNotNull())
            .groupBy("column", "value", "own").agg(F.count(F.lit(1)).alias("n")).drop("own"))


#: Most columns whose distinct values are counted in plans of their own.
NARROW = 16


def distinct_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(column, unique_values)`` of numeric columns, NULL not counted: integers are grouped as longs, floating point
    numbers as doubles and decimals by their own type, so no value becomes text and none is rounded."""
    carriers: dict[str, list[str]] = {}
    for c in cols:
        t = df.schema[c].dataType
        own = "double" if isinstance(t, (T.FloatType, T.DoubleType)) else t.simpleString() if isinstance(t, T.DecimalType) else "bigint"
        carriers.setdefault(own, []).append(c)
    if len(cols) <= NARROW:  # a scan of one column each, grouped by the bare number; the last key is one constant
        parts = [df.select(F.col(c).cast(t).alias("value")).filter(F.col("value").isNotNull()).groupBy("value").agg(F.lit(1).alias("one"))
                 .groupBy(F.lit(c).alias("column")).agg(F.count("one").alias("unique_values")) for t, mine in carriers.items() for c in mine]
    else:
        parts = [df.select(*[F.col(c).cast(t).alias(c) for c in mine]).unpivot([], mine, "column", "value").filter(F.col("value").isNotNull())
                 .groupBy("column", "value").agg(F.lit(1).alias("one")).groupBy("column").agg(F.count("one").alias("unique_values"))
                 for t, mine in carriers.items()]
    return reduce(DataFrame.unionByName, parts)


def _partitions(df: DataFrame, partitions: int | None) -> int:
    if partitions:
        return partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: Most rows of a small table that is collected or broadcast; beyond it the table is joined by a shuffle.
SMALL_ROWS = 100_000


def small_side(df: DataFrame, name: str) -> DataFrame:
    """``df``, written once, with a broadcast hint if it has at most ``SMALL_ROWS`` rows."""
    df = materialize(df, name)
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def _running_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add ``local_end``, the running sum of ``n`` over a task's rows of each column (rows sorted by column)."""
    last, seen = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        n = b.column("n").to_numpy(zero_copy_only=False)
        code = b.column("column").dictionary_encode().indices.to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        before = n[starts] - np.cumsum(n)[starts]
        if b.column("column")[0].as_py() == last:
            before[0] += seen
        local_end = np.cumsum(n) + np.repeat(before, np.diff(np.r_[starts, len(n)]))
        last, seen = b.column("column")[-1].as_py(), local_end[-1]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(local_end, pa.int64())], names=[*b.schema.names, "local_end"])


def ranked_frequency(freq: DataFrame, partitions: int | None = None) -> DataFrame:
    """Attach global rank intervals ``[rank_lo, rank_hi)`` and the column ``total`` to ``(column, value, n)``.

    Ranks are 0-based positions in ascending value order within each column.
    One range exchange: tasks sort their rows and sum them batch by batch. The
    table with its local running counts is materialised (Parquet under the
    shared checkpoint folder) so partition ids stay fixed for both of its uses.
    Columns may be classes of the data, so the offsets are a window over the
    per-partition totals, broadcast only up to ``SMALL_ROWS`` rows.
    """
    ensure_checkpoint_dir(freq.sparkSession)
    p = _partitions(freq, partitions)
    ranged = (freq.filter(F.col("value").isNotNull()).select("column", "value", "n")
              .repartitionByRange(p, "column", "value")
              .sortWithinPartitions("column", "value")
              .withColumn("pid", F.spark_partition_id()))
    local = materialize(ranged.mapInArrow(_running_counts, T.StructType([*ranged.schema.fields, T.StructField("local_end", T.LongType())])),
                        "ranked")
    by_column = Window.partitionBy("column")
    offsets = (local.groupBy("column", "pid").agg(F.sum("n").alias("part_n"))
               .select("column", "pid",
                       (F.sum("part_n").over(by_column.orderBy("pid").rowsBetween(Window.unboundedPreceding, 0))
                        - F.col("part_n")).alias("offset"),
                       F.sum("part_n").over(by_column).alias("total")))
    out = local.join(small_side(offsets, "offsets"), ["column", "pid"])
    return out.select("column", "value", "n",
                      (F.col("offset") + F.col("local_end") - F.col("n")).alias("rank_lo"),
                      (F.col("offset") + F.col("local_end")).alias("rank_hi"), "total")


def dictionary(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(column, value, code)``: dense codes from 0 of the distinct non-null values of each column, as text, in their order.

    A code is a rank after one range exchange, so no list of values is on the driver.
    The table is written: the planner knows its size when it is joined back, and sends
    it to the rows or shuffles both.
    """
    distinct = value_frequency(df, cols, drop_null=True).select("column", "value", F.lit(1).cast("long").alias("n"))
    return materialize(ranked_frequency(distinct).select("column", "value", F.col("rank_lo").alias("code")), "dictionary")


def column_totals(ranked: DataFrame) -> DataFrame:
    """Per-column non-null totals of a ranked table (small)."""
    return ranked.groupBy("column").agg(F.max("total").alias("total"))


def exact_quantiles(freq: DataFrame, probs: list[float], partitions: int | None = None,
                    ranked: DataFrame | None = None, detail: bool = False) -> DataFrame:
    """Linear-interpolation quantiles (numpy default / SQL ``percentile_cont``).

    Input ``(column, value, n)``; output ``(column, p, q)``; NULL values ignored.
    One pass over the ranked table: each row compares its interval with the
    target ranks of its column, and only the rows holding one survive.
    """
    ranked = ranked if ranked is not None else ranked_frequency(freq, partitions)
    tm1 = F.col("total") - 1

    def holds(p: float) -> Column:  # the row's ranks [rank_lo, rank_hi) hold floor(h) or ceil(h)
        h = tm1 * F.lit(float(p))
        return (h > F.col("rank_lo") - 1) & (h < F.col("rank_hi"))

    # rows that hold no target rank, nearly all, go before the explode
    cand = F.array(*[F.when(holds(p), F.lit(float(p))) for p in probs])
    hit = (ranked.filter(reduce(or_, [holds(p) for p in probs]))
           .select("column", "value", "rank_lo", "rank_hi", "total", F.explode(cand).alias("p"))
           .filter(F.col("p").isNotNull())
           .withColumn("h", tm1 * F.col("p"))
           .withColumn("lo", F.floor("h").cast("long")).withColumn("hi", F.ceil("h").cast("long")))
    picked = hit.groupBy("column", "p").agg(
        F.max(F.when((F.col("lo") >= F.col("rank_lo")) & (F.col("lo") < F.col("rank_hi")), F.col("value"))).alias("v_lo"),
        F.max(F.when((F.col("hi") >= F.col("rank_lo")) & (F.col("hi") < F.col("rank_hi")), F.col("value"))).alias("v_hi"),
        F.first("h").alias("h"))
    frac = F.col("h") - F.floor("h")
    extra = ["v_lo", "v_hi"] if detail else []
    return picked.select("column", "p", (F.col("v_lo") + frac * (F.col("v_hi") - F.col("v_lo"))).alias("q"), *extra)


def quantiles_wide(quant: DataFrame, names: dict[float, str]) -> DataFrame:
    """Pivot ``(column, p, q)`` to one row per column with named quantile fields."""
    aggs = [F.max(F.when(F.col("p") == F.lit(float(p)), F.col("q"))).alias(n) for p, n in names.items()]
    return quant.groupBy("column").agg(*aggs)
