"""Association statistics (D1-D10): correlation, quantile bins, mutual information.

All of them reduce the raw rows once into a small table (a Gram matrix by
column blocks, a k x p projection, a contingency table) that is summed within
each task first; the math that follows runs on that small table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.freq import distinct_counts, value_frequency
from quarry.operators.profile import columns_by_kind
from quarry.operators.radix import interpolated, quantile_ranks, quantiles, select_ranks

# Fixed values of the reference's mutual-information report.
BIN_COUNTS = (10, 20, 30)
NEAR_ZERO = 1e-4
UNSTABLE_STD = 0.01
MAX_CARDINALITY = 50
TOP_K_CATEGORIES = 20
LOW_CARDINALITY = 5
EDGE_TOLERANCE = 1e-8
MISSING = "Missing"
OTHER = "Other"


# ---------------------------------------------------------------------------
# Exact mean-imputed Pearson (one-pass Gram matrix)
# ---------------------------------------------------------------------------

#: Columns of a block of the Gram matrix, and rows a task multiplies at a time.
BLOCK = 64
BLOCK_ROWS = 8192


def _means(df: DataFrame, cols: list[str]) -> dict[str, float]:
    row = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols]).first()
    return {c: row[c] for c in cols}


def gram(df: DataFrame, cols: list[str], block: int = BLOCK) -> DataFrame:
    """``(i, j, v)`` for i <= j: sums over all rows of column i times column j; NULL counts as 0.

    Each task multiplies blocks of columns as dense matrices and hands on one sum per
    pair of blocks; these are dealt out by the pair and added up as they stream by.
    A task holds one matrix of partial sums, an exchange one block pair of each task,
    and the plan has one expression per column.
    """
    p = len(cols)
    edges = list(range(0, p, block))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((p, p))
        for b in batches:
            for at in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(at, BLOCK_ROWS)
                m = np.stack([c.to_numpy(zero_copy_only=False) for c in part.columns])
                for bi in edges:
                    left = m[bi:bi + block]
                    for bj in edges:
                        if bj >= bi:
                            total[bi:bi + block, bj:bj + block] += left @ m[bj:bj + block].T
        pairs = [(bi, bj) for bi in edges for bj in edges if bj >= bi]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int32()), pa.array([y for _, y in pairs], pa.int32()),
                                          pa.array([total[x:x + block, y:y + block].tobytes() for x, y in pairs], pa.binary())], ["bi", "bj", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for b in batches:
            for bi, bj, sums in zip(*[c.to_pylist() for c in b.columns], strict=True):
                m = np.frombuffer(sums).reshape(min(block, p - bi), min(block, p - bj))
                if (bi, bj) == at:
                    total += m
                else:
                    if at:
                        yield cells(at, total)
                    at, total = (bi, bj), m.copy()
        if at:
            yield cells(at, total)

    def cells(at: tuple[int, int], m: np.ndarray) -> pa.RecordBatch:
        i, j = np.indices(m.shape)
        i, j = i.ravel() + at[0], j.ravel() + at[1]
        upper = i <= j
        return pa.RecordBatch.from_arrays([pa.array(i[upper], pa.int32()), pa.array(j[upper], pa.int32()), pa.array(m.ravel()[upper])], ["i", "j", "v"])

    values = df.select(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(f"v{i}") for i, c in enumerate(cols)])
    sums = values.mapInArrow(partial, "bi int, bj int, sums binary").repartition("bi", "bj").sortWithinPartitions("bi", "bj")
    return sums.mapInArrow(added, "i int, j int, v double")


def _cosines(cells: DataFrame, cols: list[str]) -> DataFrame:
    """``(col_a, col_b, corr)`` for all ordered pairs, from the upper half of a Gram matrix; zero where a column has no variance.

    The diagonal, one row per column, is joined to the cells; no side is larger than the matrix.
    """
    names = F.array(*[F.lit(c) for c in cols])
    own = cells.where("i = j").select(F.col("i").alias("k"), F.col("v").alias("s"))
    both = (cells.join(own.select(F.col("k").alias("i"), F.col("s").alias("si")), "i")
            .join(own.select(F.col("k").alias("j"), F.col("s").alias("sj")), "j"))
    corr = F.when((F.col("si") > 0) & (F.col("sj") > 0), F.col("v") / F.sqrt(F.col("si") * F.col("sj"))).otherwise(F.lit(0.0))
    a, b = names[F.col("i")], names[F.col("j")]
    pair = F.array(F.struct(a.alias("col_a"), b.alias("col_b")), F.struct(b.alias("col_a"), a.alias("col_b")))
    return both.select(F.explode(F.when(F.col("i") == F.col("j"), F.slice(pair, 1, 1)).otherwise(pair)).alias("p"), corr.alias("corr")).select("p.*", "corr")


def pearson_mean_imputed(df: DataFrame, cols: list[str], digits: int = 4) -> DataFrame:
    """Cosine of mean-centred columns with NULL -> 0; zero variance -> 0 (diagonal too).

    One scan for the p means, one for the blocked Gram matrix of the centred columns.
    """
    means = _means(df, cols)
    centred = df.select(*[(F.col(c).cast("double") - F.lit(means[c] if means[c] is not None else 0.0)).alias(c) for c in cols])
    return _cosines(gram(centred, cols), cols).withColumn("corr", F.bround("corr", digits))


def target_correlation(corr: DataFrame, target: str) -> DataFrame:
    """D3: feature-target column of a long correlation matrix; target diagonal forced to 1.0."""
    return corr.filter(F.col("col_b") == target).select(
        F.col("col_a").alias("feature"),
        F.when(F.col("col_a") == target, F.lit(1.0)).otherwise(F.col("corr")).alias("corr"))


# ---------------------------------------------------------------------------
# Sparse random projection sketch
# ---------------------------------------------------------------------------

def jl_min_dim(n_samples: int, eps: float = 0.1) -> int:
    """Johnson-Lindenstrauss minimum dimension (same bound as the common ML libraries)."""
    denom = (eps ** 2 / 2) - (eps ** 3 / 3)
    return int(4 * math.log(n_samples) / denom)


def pcc_sketch(df: DataFrame, cols: list[str], target: str | None = None, eps: float = 0.1,
               n_components: int | None = None, n_projections: int = 3, seed: int = 42,
               id_col: str | None = None, digits: int = 4) -> DataFrame:
    """Averaged correlation of sparse random projections of the centred feature vectors.

    Each row draws its projection entries from a seeded hash of (row id, run,
    component): with density 1/sqrt(n) an entry is +-sqrt(1/density / k). Only
    non-zero entries are exploded, then one aggregation by (run, component)
    builds the k x p projected matrix, which is small.
    """
    feats = [c for c in cols if c != target]
    if len(cols) < 2:
        raise ValueError("Need at least two numerical columns to compute correlation.")
    means = _means(df, cols)
    k = n_components or jl_min_dim(len(feats), eps)
    n = df.count()
    density = 1.0 / math.sqrt(max(n, 1))
    scale = math.sqrt(1.0 / density / k)
    expected = max(1, int(round(k * density * 4)) + 4)  # candidate draws per row and run
    # Without an id the row's own values draw for it, alike on every retry; equal rows then share their draws.
    rid = F.col(id_col) if id_col else F.xxhash64(*cols)
    z = [F.coalesce(F.col(c).cast("double") - F.lit(means[c] or 0.0), F.lit(0.0)).alias(c) for c in cols]
    base = df.select(rid.alias("_rid"), *z)
    runs = F.sequence(F.lit(0), F.lit(n_projections - 1))
    draws = F.sequence(F.lit(0), F.lit(expected - 1))
    # per (row, run): Binomial(k, density) non-zero components approximated by hashed draws
    h = lambda *a: F.xxhash64(F.lit(seed), *a)
    exploded = (base.withColumn("_run", F.explode(runs)).withColumn("_d", F.explode(draws))
                .withColumn("_u", (F.pmod(h(F.col("_rid"), F.col("_run"), F.col("_d")), F.lit(1 << 30)) / float(1 << 30)))
                .filter(F.col("_u") < k * density / expected)
                .withColumn("_comp", F.pmod(h(F.col("_rid"), F.col("_run"), F.col("_d"), F.lit(1)), F.lit(k)))
                .withColumn("_sign", F.when(F.pmod(h(F.col("_rid"), F.col("_run"), F.col("_d"), F.lit(2)), F.lit(2)) == 0,
                                            F.lit(scale)).otherwise(F.lit(-scale))))
    proj = exploded.groupBy("_run", "_comp").agg(*[F.sum(F.col(c) * F.col("_sign")).alias(c) for c in cols])
    # standardise each feature across components, then correlate (k x p table: small)
    stats = proj.groupBy("_run").agg(*[F.avg(c).alias(f"m_{c}") for c in cols],
                                     *[F.stddev_pop(c).alias(f"s_{c}") for c in cols],
                                     F.lit(k).alias("_k"))
    j = proj.join(stats, "_run")
    zs = {c: F.coalesce(F.try_divide(F.col(c) - F.col(f"m_{c}"), F.col(f"s_{c}")), F.lit(0.0)) for c in cols}
    # the runs stand side by side as p columns each, so one Gram matrix holds them all
    wide = j.select(*[F.when(F.col("_run") == run, zs[c]).alias(f"{run} {c}") for run in range(n_projections) for c in cols])
    cells = gram(wide, wide.columns).where(F.floor(F.col("i") / len(cols)) == F.floor(F.col("j") / len(cols)))
    long = _cosines(cells, [c for _ in range(n_projections) for c in cols])
    corr = F.bround(F.avg("corr"), digits)
    if target is not None:
        corr = F.when((F.col("col_a") == target) & (F.col("col_b") == target), F.lit(1.0)).otherwise(corr)
    return long.groupBy("col_a", "col_b").agg(corr.alias("corr"))


# ---------------------------------------------------------------------------
# Quantile binning
# ---------------------------------------------------------------------------

def edge_probs(bin_counts=BIN_COUNTS) -> list[float]:
    """Probabilities of the edges of all bin counts, so that one selection serves them all."""
    return sorted({i / b for b in bin_counts for i in range(b + 1)})


def inner_edges(at: dict[float, float | None], bins: int) -> list[float]:
    """Equal-frequency edges from quantiles by probability, near-duplicate ones merged, without the outer two.

    Edge i stays when it exceeds the one before it by more than the tolerance.
    """
    raw = [at[i / bins] for i in range(bins + 1)]
    if raw[0] is None:
        return []
    return [e for i, e in enumerate(raw) if i == 0 or e - raw[i - 1] > EDGE_TOLERANCE][1:-1]


def bin_chain(x: Column, inner: list[float]) -> Column:
    """Same right-side search against literal edges as a CASE chain (whole-stage codegen)."""
    expr = F.when(x.isNull(), F.lit(None).cast("int"))
    for i, e in enumerate(inner):
        expr = expr.when(x < F.lit(float(e)), F.lit(i))
    return expr.otherwise(F.lit(len(inner)))


def quantile_binning(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """Ordinal equal-frequency bin per row, appended as ``<col>_bin``."""
    inner = inner_edges(quantiles(df, [col], edge_probs((bins,)))[col], bins)  # bins - 1 values at most
    return df.withColumn(f"{col}_bin", bin_chain(F.col(col).cast("double"), inner))


# ---------------------------------------------------------------------------
# Contingency tables and mutual information
# ---------------------------------------------------------------------------

def contingency(df: DataFrame, x: str, y: str) -> DataFrame:
    """Two-way counts in long form ``(x, y, n)``."""
    return df.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("n"))


def mi_from_contingency(cont: DataFrame, groups: list[str], total: Column) -> DataFrame:
    """MI in bits per group from ``(groups..., x, y, n)``; rows with NULL y are ignored.

    ``total`` is the all-rows denominator (NULL targets included, as the reference).
    """
    c = cont.filter(F.col("y").isNotNull())
    nx = c.groupBy(*groups, "x").agg(F.sum("n").alias("nx"))
    ny = c.groupBy(*groups, "y").agg(F.sum("n").alias("ny"))
    j = c.join(nx, groups + ["x"]).join(ny, groups + ["y"])
    N = total.cast("double")
    term = (F.col("n") / N) * F.log2(F.col("n") * N / (F.col("nx") * F.col("ny")))
    return j.groupBy(*groups).agg(F.sum(term).alias("mi"))


def onehot_mi_from_contingency(cont: DataFrame, groups: list[str], total: Column) -> DataFrame:
    """Sum over categories d of MI(1[x=d]; y), from the (x, y) table only.

    The indicator-0 side is derived from the y marginals: for category d,
    m_y = n(y) - n(d, y); categories where n(d, y) = 0 contribute
    (n(y)/N) log2(N/n0) each, summed in closed form, so no category x class
    grid is ever built.
    """
    N = total.cast("double")
    c = cont  # includes NULL-y rows so every category is enumerated
    cy = c.filter(F.col("y").isNotNull())
    ny = cy.groupBy(*groups, "y").agg(F.sum("n").alias("ny"))
    tot_y = cy.groupBy(*groups).agg(F.sum("n").alias("Ny"))
    cats = c.groupBy(*groups, "x").agg(F.sum(F.when(F.col("y").isNotNull(), F.col("n")).otherwise(0)).alias("n1"))
    cats = cats.join(tot_y, groups, "left").withColumn("Ny", F.coalesce("Ny", F.lit(0))).withColumn(
        "n0", F.col("Ny") - F.col("n1"))
    rows = cy.join(ny, groups + ["y"]).join(cats.select(*groups, "x", "n1", "n0"), groups + ["x"])
    m = F.col("ny") - F.col("n")

    def h(cnt: Column, marg: Column) -> Column:
        return F.when(cnt > 0, (cnt / N) * F.log2(cnt * N / (marg * F.col("ny")))).otherwise(F.lit(0.0))

    per_row = rows.select(*groups, "x",
                          h(F.col("n"), F.col("n1")).alias("a1"),
                          F.when(F.col("n0") > 0, h(m, F.col("n0")) - (F.col("ny") / N) * F.log2(N / F.col("n0")))
                          .otherwise(F.lit(0.0)).alias("a0"))
    per_cat = per_row.groupBy(*groups, "x").agg(F.sum("a1").alias("a1"), F.sum("a0").alias("a0"))
    per_cat = per_cat.join(cats, groups + ["x"], "right").select(
        *groups, "x",
        (F.coalesce(F.col("a1"), F.lit(0.0)) + F.coalesce(F.col("a0"), F.lit(0.0))
         + F.when(F.col("n0") > 0, (F.col("Ny") / N) * F.log2(N / F.col("n0"))).otherwise(F.lit(0.0))).alias("mi"))
    return per_cat.groupBy(*groups).agg(F.sum("mi").alias("mi"))


def histogram_mi(df: DataFrame, x: str, y: str) -> DataFrame:
    """MI(x; y) in bits; denominator is all rows."""
    cont = contingency(df, x, y).withColumn("g", F.lit(1))
    total = df.agg(F.count(F.lit(1))).scalar()
    return mi_from_contingency(cont, ["g"], total).drop("g")


def stable_mi(df: DataFrame, target: str, bin_counts=BIN_COUNTS, near_zero: float = NEAR_ZERO,
              max_cardinality: int = MAX_CARDINALITY, top_k: int = TOP_K_CATEGORIES,
              drop_null_target: bool = False, per_run: bool = False) -> DataFrame:
    """MI per feature at several bin counts -> avg, population std, flags.

    One radix selection gives the medians and all quantile edges of the numeric
    columns (ranks among median-filled values are ranks among the others, shifted).
    Rows are binned once, on the merged edges of all bin counts, and counted once by
    ``(feature, x, y)``; each bin count's contingency table is a sum over this one,
    which is bounded by features x cells x categories x classes.
    """
    from pyspark.sql import Window
    if drop_null_target:
        df = df.filter(F.col(target).isNotNull())
    kinds = columns_by_kind(df, exclude=(target,))
    strings, bools, dates = kinds["categorical"], kinds["bool"], kinds["datetime"]
    tdt = df.schema[target].dataType.simpleString()
    t_numeric = tdt in ("tinyint", "smallint", "int", "bigint", "float", "double") or tdt.startswith("decimal")
    num_cols = kinds["numeric"] + ([target] if t_numeric else [])
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(c).alias(f"d_{c}") for c in dates],
                    F.count_if(F.col(target).isNull()).alias("no_target")).first()
    rows, total = counts["n"], F.lit(counts["n"])
    nun = {c: counts[f"d_{c}"] for c in dates}
    if num_cols:
        nun |= {r["column"]: r["unique_values"] for r in distinct_counts(df, num_cols).collect()}  # p rows
    lowcard = bools + [c for c in kinds["numeric"] + dates if nun.get(c, 0) <= LOW_CARDINALITY]
    numeric = [c for c in kinds["numeric"] if nun.get(c, 0) > LOW_CARDINALITY]
    t_binned = t_numeric and nun.get(target, 0) > LOW_CARDINALITY
    if t_binned and counts["no_target"]:
        raise ValueError("numeric target with NULLs cannot be binned; pass drop_null_target=True")

    probs = edge_probs(bin_counts)

    def filled_rank(n: int, r: int) -> int | None:
        """Rank among the n values of rank r among them and rows - n medians; None for one of these medians."""
        below, above = (n - 1) // 2, n // 2
        return r if r <= below else r - (rows - n) if r >= above + rows - n else None

    def wanted(c: str, n: int) -> set[int]:
        shifted = {filled_rank(n, r) for r in quantile_ranks(rows, probs)} if n else set()
        return quantile_ranks(n, [0.5]) | {r for r in shifted if r is not None}

    med_vals, edges = {}, {}
    for c, (n, at) in select_ranks(df, numeric + ([target] if t_binned else []), wanted).items():
        med = med_vals[c] = interpolated(n, at.__getitem__, 0.5)
        value = lambda r, n=n, at=at, med=med: med if (own := filled_rank(n, r)) is None else at[own]
        edges[c] = {b: inner_edges({p: interpolated(rows, value, p) for p in probs}, b) for b in bin_counts}
    merged = {c: sorted({e for inner in own.values() for e in inner}) for c, own in edges.items()}

    # the target's cell on its merged edges when numeric with > 5 distinct values
    y = bin_chain(F.col(target).cast("double"), merged[target]).cast("string") if t_binned else F.col(target).cast("string")
    base = df.withColumn("_y", y)

    def unpivoted(columns: dict[str, Column], branch: str) -> DataFrame:
        return (base.select(F.col("_y").alias("y"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), x.alias("x")) for c, x in columns.items()])).alias("kv"))
                .select("kv.feature", F.lit(branch).alias("branch"), "kv.x", "y"))

    parts = []
    if strings:
        s_long = unpivoted({c: F.coalesce(F.col(c), F.lit(MISSING)) for c in strings}, "onehot")
        sfreq = value_frequency(df.select(*[F.coalesce(F.col(c), F.lit(MISSING)).alias(c) for c in strings]), strings)
        card = sfreq.groupBy("column").agg(F.count(F.lit(1)).alias("card"))
        w = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value").asc())
        # high-cardinality columns keep their top k: a pure row_number() <= k lets Spark run a
        # partial WindowGroupLimit before the shuffle (no column's values gather in one task)
        top = (sfreq.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= top_k)
               .select(F.col("column").alias("feature"), F.col("value").alias("x")))
        keep = top.withColumn("_keep", F.lit(True))
        highs = card.filter(F.col("card") > max_cardinality).select(F.col("column").alias("feature"), F.lit(True).alias("_high"))
        parts.append(s_long.join(F.broadcast(highs), "feature", "left")
                     .join(F.broadcast(keep), ["feature", "x"], "left")  # <= features x top_k rows
                     .withColumn("x", F.when(F.col("_high").isNull() | F.col("_keep").isNotNull(), F.col("x")).otherwise(F.lit(OTHER)))
                     .select("feature", "branch", "x", "y"))
    if lowcard:
        parts.append(unpivoted({c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in lowcard}, "lowcard"))
    if numeric:
        # the cell id comes from a literal CASE chain on the median-filled value
        parts.append(unpivoted({c: bin_chain(F.coalesce(F.col(c).cast("double"), F.lit(med_vals[c]).cast("double")), merged[c]).cast("string")
                                for c in numeric}, "numeric"))
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    cells = long.groupBy("feature", "branch", "x", "y").agg(F.count(F.lit(1)).alias("n"))

    def bin_of(c: str) -> list[tuple[str, int, str]]:
        """(cell, bins, bin): a cell lies in the bin whose lower edge is at or below its own."""
        return [(str(cell), b, str(sum(e <= low for e in inner))) for b, inner in edges[c].items() for cell, low in enumerate([-math.inf, *merged[c]])]

    spark = df.sparkSession
    cells = cells.withColumn("bins", F.explode(F.array(*[F.lit(b) for b in bin_counts])))
    if numeric:  # features x cells x bin counts, a table of edges
        of_x = spark.createDataFrame([(c, *r) for c in numeric for r in bin_of(c)], "feature string, x string, bins int, x_bin string")
        cells = cells.join(F.broadcast(of_x), ["feature", "x", "bins"], "left").withColumn(
            "x", F.when(F.col("branch") == "numeric", F.col("x_bin")).otherwise(F.col("x")))
    if t_binned:
        of_y = spark.createDataFrame(bin_of(target), "y string, bins int, y_bin string")
        cells = cells.join(F.broadcast(of_y), ["y", "bins"], "left").withColumn("y", F.col("y_bin"))
    cont = cells.groupBy("feature", "branch", "bins", "x", "y").agg(F.sum("n").alias("n"))
    g = ["feature", "bins"]
    mi_std = mi_from_contingency(cont.filter(F.col("branch") != "onehot"), g, total)
    mi_oh = onehot_mi_from_contingency(cont.filter(F.col("branch") == "onehot"), g, total)
    runs = mi_std.unionByName(mi_oh)
    if per_run:
        return runs
    out = runs.groupBy("feature").agg(F.avg("mi").alias("avg"), F.stddev_pop("mi").alias("std")).orderBy(F.desc("avg"), "feature")  # one row a feature
    return out.select(
        "feature", F.bround("avg", 6).alias("avg_mi"), F.bround("std", 6).alias("std_mi"),
        F.when(F.col("std") > UNSTABLE_STD, F.lit("Unstable")).otherwise(F.lit("Stable")).alias("stability"),
        F.when(F.col("avg") < near_zero, F.lit("Near-Zero")).otherwise(F.lit("Informative")).alias("mi_flag"))
