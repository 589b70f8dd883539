"""Sampling and splitting.

Randomness comes from an md5/xxhash key of the row id and a seed, never
``rand()``: results are stable under repartitioning and retries, and the md5
form has a cross-engine oracle. Exact-count selections (k smallest keys per
class or overall) rank the keys alone, range partitioned, so no class is ever
gathered into one task; rows are then compared with the cutoff key of their
class, without a shuffle of the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.freq import ranked_frequency, small_side

SEED = 42
SPLIT_COLUMN_NAMES = ("split", "set", "subset", "train_test")
TRAIN_VALUES = ("train", "training")
TEST_VALUES = ("test", "testing")


def hash_key(cols: list[str], seed: int = SEED) -> Column:
    """60-bit integer from md5(id|...|seed) (same value in DuckDB via hex cast)."""
    txt = F.concat_ws("|", *[F.col(c).cast("string") for c in cols], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(txt), 1, 15), 16, 10).cast("bigint")


def sample_pct(df: DataFrame, pct: float | None, id_cols: list[str], seed: int = SEED) -> DataFrame:
    """G1: NULL pct -> whole table; 0 < pct <= 100 else error; keep keys in the first pct percent of the 60-bit range."""
    if pct is None:
        return df
    if not (0 < pct <= 100):
        raise ValueError("sample_percentage must be in (0, 100]")
    return df.filter(hash_key(id_cols, seed) < F.lit(round(pct * 2**60 / 100)))


def _smallest(df: DataFrame, id_cols: list[str], group: str | None, seed: int, k: Callable[[Column], Column]) -> DataFrame:
    """``df`` with ``_in``: whether the row's hash key is among the ``k(n)`` smallest of its class's (or all) n rows.

    A NULL class is a class. Only hash keys are shuffled; the cutoffs, one row
    for each class, are broadcast up to a checked number of classes.
    """
    g = F.coalesce(F.col(group).cast("string"), F.lit("\u0000null")) if group else F.lit("__all__")
    keyed = df.withColumn("_grp", g).withColumn("_key", hash_key(id_cols, seed))
    freq = keyed.groupBy(F.col("_grp").alias("column"), F.col("_key").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    cut = (ranked_frequency(freq).filter(F.col("rank_lo") < k(F.col("total")))
           .groupBy(F.col("column").alias("_grp")).agg(F.max("value").alias("_cut")))
    marked = keyed.join(small_side(cut, "cutoffs"), "_grp", "left")
    return marked.withColumn("_in", F.coalesce(F.col("_key") <= F.col("_cut"), F.lit(False))).drop("_grp", "_key", "_cut")


def _split(marked: DataFrame, chosen: str, rest: str) -> DataFrame:
    return marked.withColumn("split", F.when(F.col("_in"), F.lit(chosen)).otherwise(F.lit(rest))).drop("_in")


def stratified_sample(df: DataFrame, target: str, pct: float, id_cols: list[str], seed: int = SEED) -> DataFrame:
    """G2 (deterministic): per class the ceil(n_c * pct / 100) rows with the smallest hash keys."""
    return _smallest(df, id_cols, target, seed, lambda n: F.ceil(n * F.lit(pct / 100.0))).filter("_in").drop("_in")


def split_random(df: DataFrame, id_cols: list[str], test_size: float = 0.2, seed: int = SEED) -> DataFrame:
    """ceil(test_size * n) rows with the smallest hash keys form the test split."""
    return _split(_smallest(df, id_cols, None, seed, lambda n: F.ceil(n * F.lit(test_size))), "test", "train")


def split_stratified(df: DataFrame, target: str, id_cols: list[str], test_size: float = 0.2, seed: int = SEED,
                     max_classes: int = 100) -> DataFrame:
    """Stratify by the target when it has fewer than ``max_classes`` values, else random."""
    n_classes = df.agg(F.count_distinct(target)).first()[0]
    if n_classes >= max_classes:
        return split_random(df, id_cols, test_size, seed)
    return _split(_smallest(df, id_cols, target, seed, lambda n: F.round(n * F.lit(test_size))), "test", "train")


def split_column(df: DataFrame) -> DataFrame:
    """First column named split/set/subset/train_test; train vs test counts; either zero -> invalid."""
    col = next((c for c in df.columns if c.lower() in SPLIT_COLUMN_NAMES), None)
    if col is None:
        raise ValueError("no split indicator column")
    v = F.lower(F.col(col).cast("string"))
    out = df.agg(F.count_if(v.isin(*TRAIN_VALUES)).alias("train_count"),
                 F.count_if(v.isin(*TEST_VALUES)).alias("test_count"))
    return out.select(F.lit(col).alias("split_column"), "train_count", "test_count",
                      ((F.col("train_count") > 0) & (F.col("test_count") > 0)).alias("valid"))


def split_sizes(df: DataFrame, train_ratio: float = 0.8) -> DataFrame:
    """train = int(n * 0.8), test = n - train."""
    n = F.count(F.lit(1))
    return df.agg(n.alias("n")).select(
        F.col("n").cast("long").alias("total_rows"),
        F.floor(F.col("n") * F.lit(train_ratio)).cast("long").alias("train_rows"),
        (F.col("n") - F.floor(F.col("n") * F.lit(train_ratio))).cast("long").alias("test_rows"))


def image_split(listing: DataFrame, val_ratio: float = 0.2, seed: int = SEED) -> DataFrame:
    """80/20 over an image listing; val = int(n * 0.2) smallest hash keys."""
    return _split(_smallest(listing, ["path"], None, seed, lambda n: F.floor(n * F.lit(val_ratio))), "val", "train")


def split_distribution(split_df: DataFrame, target: str, top: int = 5) -> DataFrame:
    """Per split: size, share of all rows and top-5 class counts (ties by class)."""
    from pyspark.sql import Window
    counts = split_df.groupBy("split", F.col(target).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("split").orderBy(F.col("n").desc(), F.col("class").asc_nulls_last())
    top_rows = counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    sizes = counts.groupBy("split").agg(F.sum("n").alias("split_rows"))
    total = split_df.agg(F.count(F.lit(1))).scalar()
    return (top_rows.join(sizes, "split")
            .select("split", F.col("split_rows").cast("long").alias("split_rows"),
                    (F.col("split_rows") * 100.0 / total).alias("split_percent"), "rank", "class",
                    F.col("n").cast("long").alias("n")))


def representativeness(pop_profile: DataFrame, sample_profile: DataFrame, mean_tol: float = 0.1,
                       quantile_tol: float = 0.1) -> DataFrame:
    """Compare two numeric profiles by column: relative mean and median gaps -> verdict + reason."""
    p = pop_profile.select("column", F.col("mean").alias("p_mean"), F.col("median").alias("p_median"),
                           F.col("std_dev").alias("p_std"))
    s = sample_profile.select("column", F.col("mean").alias("s_mean"), F.col("median").alias("s_median"))
    j = p.join(s, "column", "left")
    scale = F.greatest(F.abs(F.col("p_std")), F.lit(1e-12))
    mean_gap = F.abs(F.col("s_mean") - F.col("p_mean")) / scale
    med_gap = F.abs(F.col("s_median") - F.col("p_median")) / scale
    ok = (mean_gap <= mean_tol) & (med_gap <= quantile_tol)
    return j.select("column", mean_gap.alias("mean_gap"), med_gap.alias("median_gap"),
                    F.coalesce(ok, F.lit(False)).alias("is_representative"),
                    F.when(ok, F.lit("within tolerance"))
                    .when(mean_gap > mean_tol, F.lit("mean shifted"))
                    .otherwise(F.lit("median shifted")).alias("reason"))
