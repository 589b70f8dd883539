"""C17: numeric profiles from mergeable sketches.

A sketch table has one row per group (a day, a partition, a source) and column:
counts and sums, a KLL sketch of the values and an HLL sketch of the distinct
ones. It is kept and merged like any other table, so a profile over a year
reads 365 rows per column, not the year's data, and a late day is one more row.

Errors: a KLL quantile's rank is within ``rank_error(k)`` of the wanted one, an
HLL count within ``distinct_error(lg_k)`` of the true one, each in about 99 of
100 cases, whatever was merged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size of a KLL sketch, and binary logarithm of the registers of an HLL sketch.
KLL_K, HLL_LG_K = 1000, 14


def rank_error(k: int = KLL_K) -> float:
    """Normalised rank error of a KLL sketch, from the published fit of its error by size."""
    return 2.296 / k ** 0.9021


def distinct_error(lg_k: int = HLL_LG_K) -> float:
    """Three standard deviations of an HLL count."""
    return 3 * 1.04 / 2 ** (lg_k / 2)


def sketch_table(df: DataFrame, cols: list[str], by: list[str] | None = None, k: int = KLL_K, lg_k: int = HLL_LG_K) -> DataFrame:
    """``(by..., column, rows, n, total, low, high, kll, hll)``: one row per group of ``by`` and numeric column.

    One partial aggregation per task; only sketches are exchanged. NULLs count in
    ``rows`` only. Groups in which a column has no value keep a row with empty sketches.
    """
    by = list(by or [])
    long = df.select(*[F.col(f"`{c}`") for c in by], *[F.col(f"`{c}`").cast("double").alias(f"__{c}") for c in cols]).unpivot(
        [F.col(f"`{c}`") for c in by], [F.col(f"`__{c}`") for c in cols], "column", "value")
    v = F.col("value")
    return long.withColumn("column", F.substring("column", 3, 2**31 - 1)).groupBy(*by, "column").agg(
        F.count(F.lit(1)).alias("rows"), F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("low"), F.max(v).alias("high"),
        F.kll_sketch_agg_double(v, k).alias("kll"), F.hll_sketch_agg(F.when(v.isNotNull(), F.xxhash64(v)), lg_k).alias("hll"))


def merge_sketches(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The sketch table by fewer groups: rows of ``table`` that agree in ``by`` and column become one."""
    return table.groupBy(*(by or []), "column").agg(
        F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.kll_merge_agg_double("kll").alias("kll"), F.hll_union_agg("hll").alias("hll"))


def sketch_profile(table: DataFrame, probs: dict[str, float]) -> DataFrame:
    """Each sketch's counts, mean, extremes, distinct values and quantiles, named by ``probs``; NULL where a column has no value."""
    some = F.col("n") > 0
    others = [c for c in table.columns if c not in ("total", "low", "high", "kll", "hll")]
    return table.select(
        *others, F.try_divide("total", "n").alias("mean"), F.col("low").alias("min"), F.col("high").alias("max"),
        F.hll_sketch_estimate("hll").alias("unique_values"),
        *[F.when(some, F.kll_sketch_get_quantile_double("kll", F.lit(float(p)))).alias(name) for name, p in probs.items()])


def rank_check(df: DataFrame, profile: DataFrame, probs: dict[str, float], k: int = KLL_K) -> DataFrame:
    """``(column, quantile, low_rank, high_rank, within)``: the exact share of values below, and up to, each quantile of a
    profile (a row per column), and whether the wanted share is within the stated error of these.

    One scan of ``df``; the quantiles, one per column and probability, become literals.
    """
    found = {r["column"]: r for r in profile.collect()}
    aggs, rows = [], []
    for i, (c, r) in enumerate(found.items()):
        x = F.col(f"`{c}`").cast("double")
        for j, (name, p) in enumerate(probs.items()):
            q = F.lit(r[name]).cast("double")
            aggs += [F.avg(F.when(x.isNotNull(), (x < q).cast("double"))).alias(f"l{i}_{j}"), F.avg(F.when(x.isNotNull(), (x <= q).cast("double"))).alias(f"h{i}_{j}")]
            low, high, eps = F.col(f"l{i}_{j}"), F.col(f"h{i}_{j}"), rank_error(k)
            rows.append(F.struct(F.lit(c).alias("column"), F.lit(name).alias("quantile"), low.alias("low_rank"), high.alias("high_rank"),
                                 ((F.lit(p) >= low - eps) & (F.lit(p) <= high + eps)).alias("within")))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))
