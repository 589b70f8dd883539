"""Counts of texts of any length, by digest: no exchange carries the texts themselves.

A value is known by 64 and 32 bits of two hashes and its length, so a count of
whole documents moves about 40 bytes for each distinct one and task. The first
``HEAD`` characters go along to put values of one count in order. The texts of
the few values that are wanted are read in a second scan, which joins rows to
the wanted digests; only those rows are exchanged, one per digest and task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.freq import distinct_counts
from quarry.session import materialize

#: Characters of a value that order it among values of one count.
HEAD = 24
KEY = ["h1", "h2", "size"]

_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _key(v: Column) -> list[Column]:
    some = v.isNotNull()
    return [F.when(some, F.xxhash64(v)).alias("h1"), F.when(some, F.hash(v)).alias("h2"), F.char_length(v).alias("size")]


def _stacked(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in cols]).unpivot([], [F.col(f"`{c}`") for c in cols], "column", "value")


def digest_frequency(df: DataFrame, cols: list[str], lower: bool = False) -> DataFrame:
    """``(column, h1, h2, size, head, n)``: how often each value, as text, occurs; NULL is a value with NULL digests.

    With ``lower`` also ``low``, a hash of the value in lower case.
    """
    v = F.col("value")
    rows = _stacked(df, cols).select("column", *_key(v), F.substring(v, 1, HEAD).alias("head"), *([F.xxhash64(F.lower(v)).alias("low")] if lower else []))
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))


def cardinality(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(column, unique_values)``: distinct values, NULL not counted; numbers by their own type, all else by digest."""
    numbers = [c for c in cols if isinstance(df.schema[c].dataType, _NUMBERS)]
    texts = [c for c in cols if c not in numbers]
    parts = [distinct_counts(df, numbers)] if numbers else []
    if texts:
        keys = _stacked(df, texts).where(F.col("value").isNotNull()).select("column", *_key(F.col("value"))).distinct()
        parts.append(keys.groupBy("column").agg(F.count(F.lit(1)).alias("unique_values")))
    return reduce(DataFrame.unionByName, parts)


def top_digests(freq: DataFrame, k: int) -> DataFrame:
    """The rows of a digest frequency that can be among the k most frequent values of their column.

    ``rank() <= k`` runs as a partial limit in every task first. Values that agree in count and head all stay.
    """
    w = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("head").asc_nulls_last())
    return freq.withColumn("_r", F.rank().over(w)).where(F.col("_r") <= k).drop("_r")


def with_texts(df: DataFrame, cols: list[str], wanted: DataFrame) -> DataFrame:
    """``wanted`` (column, h1, h2, size, n) with the values themselves, NULL for the NULL digest.

    The wanted digests are written first: the planner then knows their size and sends
    them to the rows where they are few, so the other rows' texts stay where they are.
    """
    wanted, v = materialize(wanted, "wanted-digests"), F.col("value")
    rows = _stacked(df, cols).where(v.isNotNull()).select("column", *_key(v), "value")
    named = rows.join(wanted.select("column", *KEY).where("h1 is not null"), ["column", *KEY], "left_semi")
    texts = named.groupBy("column", *KEY).agg(F.min("value").alias("value"))
    known = wanted.where("h1 is not null").select("column", *KEY, "n").join(texts, ["column", *KEY]).select("column", "value", "n")
    return known.unionByName(wanted.where("h1 is null").select("column", F.lit(None).cast("string").alias("value"), "n"))


def top_texts(df: DataFrame, cols: list[str], k: int, freq: DataFrame | None = None) -> DataFrame:
    """``(column, value, n, rank)``: the k most frequent values of each column, ties by value, NULL last."""
    found = with_texts(df, cols, top_digests(freq if freq is not None else digest_frequency(df, cols), k))
    w = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def two_valued(df: DataFrame, cols: list[str]) -> dict[str, bool]:
    """Whether a column has exactly two values, NULL counting as one: least and greatest values in one scan, and, where they
    differ, how many rows have neither in a second; no values are exchanged but these two of each task."""
    at = {c: F.col(f"`{c}`").cast("string") if isinstance(df.schema[c].dataType, T.MapType) else F.col(f"`{c}`") for c in cols}
    row = df.agg(*[f(at[c]).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("lo", F.min), ("hi", F.max))],
                 *[F.count_if(at[c].isNull()).alias(f"nulls{i}") for i, c in enumerate(cols)]).first()  # three numbers or texts a column
    other = [(i, c) for i, c in enumerate(cols) if row[f"lo{i}"] is not None and row[f"lo{i}"] != row[f"hi{i}"] and not row[f"nulls{i}"]]
    out = {c: row[f"lo{i}"] is not None and row[f"lo{i}"] == row[f"hi{i}"] and row[f"nulls{i}"] > 0 for i, c in enumerate(cols)}
    if other:
        ends = df.agg(F.struct(*[f(at[c]).alias(f"{n}{i}") for i, c in other for n, f in (("lo", F.min), ("hi", F.max))]).alias("e")).scalar()
        rows = df.select(*[at[c].alias(f"v{i}") for i, c in other], ends.alias("e"))
        between = rows.agg(*[F.count_if((F.col(f"v{i}") != F.col(f"e.lo{i}")) & (F.col(f"v{i}") != F.col(f"e.hi{i}"))).alias(f"n{i}") for i, c in other]).first()
        out |= {c: between[f"n{i}"] == 0 for i, c in other}
    return out
