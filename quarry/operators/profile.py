"""Column profiling.

One wide partial aggregation per column chunk gives counts and moments in a
single scan, exact quantiles come from radix selection, and the shared
``(column, value, n)`` frequency table gives top-k and entropy. Everything is
returned as long tables: one row per profiled column with a nullable superset
schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.digests import digest_frequency, top_texts, two_valued
from quarry.operators.freq import distinct_counts, value_frequency
from quarry.operators.ordered import lag1_autocorr
from quarry.operators.radix import quantiles
from quarry.operators.sketches import sketch_profile, sketch_table
from quarry.session import materialize

# Fixed values of the reference profile.
TOP_K = 10
HIGH_CARDINALITY = 50
IQR_FENCE = 1.5
AGG_CHUNK = 100  # columns per generated aggregate (keeps codegen methods small)

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_DATETIME = (T.TimestampType, T.TimestampNTZType, T.DateType)


def column_kind(dt: T.DataType) -> str:
    if isinstance(dt, T.BooleanType):
        return "bool"
    if isinstance(dt, _NUMERIC):
        return "numeric"
    if isinstance(dt, T.StringType):
        return "categorical"
    if isinstance(dt, _DATETIME):
        return "datetime"
    return "other"


def columns_by_kind(df: DataFrame, exclude=()) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {"bool": [], "numeric": [], "categorical": [], "datetime": [], "other": []}
    for f in df.schema.fields:
        if f.name in exclude:
            continue
        out[column_kind(f.dataType)].append(f.name)
    return out


def _dtype_map(df: DataFrame) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


def _chunks(cols: list[str], size: int = AGG_CHUNK):
    for i in range(0, len(cols), size):
        yield cols[i:i + size]


def _long_stats(df: DataFrame, cols: list[str], per_col) -> DataFrame:
    """One scan per chunk: ``per_col(c) -> list[(name, Column)]`` unpivoted to one row per column."""
    parts = []
    for chunk in _chunks(cols):
        aggs = [F.count(F.lit(1)).alias("__rows")]
        names: list[str] = []
        for i, c in enumerate(chunk):
            for name, expr in per_col(c):
                aggs.append(expr.alias(f"c{i}__{name}"))
                if i == 0:
                    names.append(name)
        wide = df.agg(*aggs)
        rows = F.array(*[F.struct(F.lit(c).alias("column"),
                                  *[F.col(f"c{i}__{n}").alias(n) for n in names])
                         for i, c in enumerate(chunk)])
        parts.append(wide.select(F.col("__rows").alias("rows"), F.inline(rows)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _pct(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double") * F.lit(100.0), den.cast("double"))


# ---------------------------------------------------------------------------
# C0 / B11 / C2
# ---------------------------------------------------------------------------

def top_values(df: DataFrame | None, cols: list[str] | None = None, k: int = TOP_K, freq: DataFrame | None = None) -> DataFrame:
    """Top-k values per column by count (NULL counted), ties by value, NULL last.

    Values are counted by digest; given a frequency table with the values, by these.
    Either way a limit per column runs in each task before the shuffle.
    """
    if freq is None:
        return top_texts(df, list(cols or df.columns), k)
    w = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value").asc_nulls_last())
    return freq.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_values_text(top: DataFrame) -> DataFrame:
    """Top values rendered as ``value:count|...`` in rank order (NULL shown as ``NULL``)."""
    item = F.struct(F.col("rank"), F.concat(F.coalesce(F.col("value"), F.lit("NULL")), F.lit(":"),
                                            F.col("n").cast("string")).alias("txt"))
    return top.groupBy("column").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["txt"]), "|").alias("top_values"))


def binary_columns(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Exactly two distinct values, NULL counting as one value."""
    return df.sparkSession.createDataFrame(list(two_valued(df, list(cols or df.columns)).items()), "column string, is_binary boolean")


def head_n(df: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    """First n rows in an explicit order (TakeOrderedAndProject, top-n per task)."""
    return df.orderBy(*order).limit(n)


def basic_profile(df: DataFrame) -> DataFrame:
    """Field names, dtypes, position and binary flag (preview is ``head_n``)."""
    dtypes = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                                F.lit(f.dataType.simpleString()).alias("dtype"))
                       for i, f in enumerate(df.schema.fields)])
    schema_rows = df.sparkSession.range(1).select(F.inline(dtypes))
    return schema_rows.join(F.broadcast(binary_columns(df)), "column", "left")


# ---------------------------------------------------------------------------
# C3 / C4 / C5-C7 / C8-C9
# ---------------------------------------------------------------------------

def numeric_profile(df: DataFrame, cols: list[str] | None = None, approx: bool = False, sketches: DataFrame | None = None) -> DataFrame:
    """C4 (C17 with ``approx=True``): moments, exact quartiles, outliers, zero/missing share.

    Quartiles come from radix selection (bucket counts are exchanged, no values); their
    fences, one row a column, go into the one aggregate that takes moments and outliers.
    Only the exact number of distinct values exchanges values, once each per task. With
    ``approx`` quartiles and distinct values are those of sketches, given (one merged
    row per column) or made in one scan.
    """
    cols = list(cols if cols is not None else columns_by_kind(df)["numeric"])
    dtypes = _dtype_map(df)
    distinct = {}
    if approx:
        names = {"q1": 0.25, "median": 0.5, "q3": 0.75}
        rows = {r["column"]: r for r in sketch_profile(sketches if sketches is not None else sketch_table(df, cols), names).collect()}  # p rows
        quart = {c: {p: rows[c][name] for name, p in names.items()} for c in cols}
        distinct = {c: rows[c]["unique_values"] for c in cols}
    else:
        quart = quantiles(df, cols, [0.25, 0.5, 0.75])

    rows = []
    for c in cols:
        q1, mid, q3 = (quart[c][p] for p in (0.25, 0.5, 0.75))
        rows.append((c, q1, mid, q3, *((None, None) if q1 is None else (q1 - IQR_FENCE * (q3 - q1), q3 + IQR_FENCE * (q3 - q1))), distinct.get(c)))
    known = df.sparkSession.createDataFrame(rows, "column string, q1 double, median double, q3 double, lo double, hi double, unique_values long")
    # One set of expressions for all columns: a wide aggregate of many moments is too large a method to be compiled.
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "column", "value")
    x = F.col("value")
    stats = long.join(F.broadcast(known.select("column", "lo", "hi")), "column").groupBy("column").agg(  # a row per column
        F.count(F.lit(1)).alias("rows"), F.count(x).alias("nn"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std_dev"),
        F.skewness(x).alias("skewness"), F.kurtosis(x).alias("kurtosis"), F.count_if(x == 0).alias("zeros"), F.min(x).alias("vmin"), F.max(x).alias("vmax"),
        F.count_if((x < F.col("lo")) | (x > F.col("hi"))).alias("n_out"))
    if not approx:
        known = known.drop("unique_values").join(distinct_counts(df, cols), "column", "left")
    out = known.join(stats, "column", "left").withColumn("nn", F.coalesce("nn", F.lit(0)))
    dtype_col = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(dtypes[c]))])
    nn = F.col("nn")
    return out.select(
        "column",
        dtype_col[F.col("column")].alias("dtype"),
        F.col("mean"), F.col("std_dev"), F.col("median"), F.col("q1"), F.col("q3"),
        F.when(nn > 1, F.col("skewness")).alias("skewness"),
        F.when(nn > 1, F.col("kurtosis")).alias("kurtosis"),
        _pct(F.col("rows") - nn, F.col("rows")).alias("missing_percent"),
        _pct(F.col("zeros"), F.col("rows")).alias("zero_percent"),
        F.coalesce(F.col("unique_values"), F.lit(0)).cast("long").alias("unique_values"),
        F.when(nn > 0, _pct(F.col("n_out"), nn)).alias("outlier_percent"),
        F.when(F.col("mean") != 0, F.col("std_dev") / F.col("mean")).alias("coefficient_of_variation"),
        (F.coalesce(F.col("unique_values"), F.lit(0)) == 1).alias("is_constant"),
        F.col("vmin").alias("min"), F.col("vmax").alias("max"),
    )


def bool_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Value counts (NULL included), missing share, constant = one distinct non-null value."""
    cols = list(cols if cols is not None else columns_by_kind(df)["bool"])
    freq = value_frequency(df, cols)
    txt = top_values_text(top_values(None, freq=freq, k=3)).withColumnRenamed("top_values", "value_counts")
    agg = freq.groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("nulls"),
        F.count("value").alias("cardinality"))
    return agg.join(txt, "column").select(
        "column", F.lit("boolean").alias("dtype"), "value_counts",
        _pct(F.col("nulls"), F.col("rows")).alias("missing_percent"),
        (F.col("cardinality") == 1).alias("is_constant"))


def categorical_profile(df: DataFrame, cols: list[str] | None = None, k: int = TOP_K) -> DataFrame:
    """Cardinality, entropy (NULL as a category), top-k, casing and length.

    Values are grouped by digest, however long they are; the texts of the top values come from a second scan.
    """
    cols = list(cols if cols is not None else columns_by_kind(df)["categorical"])
    dtypes = _dtype_map(df)
    freq = materialize(digest_frequency(df, cols, lower=True), "digests")  # for counts, top values and casing
    v, n = F.col("h1"), F.col("n")
    agg = freq.groupBy("column").agg(
        F.sum(n).alias("rows"),
        F.sum(F.when(v.isNull(), n).otherwise(0)).alias("nulls"),
        F.count(v).alias("cardinality"),
        F.sum(n * F.log2(n)).alias("s_nlogn"),
        F.sum(F.when(v.isNotNull(), n * F.col("size"))).alias("len_sum"))
    lower = freq.filter(v.isNotNull()).select("column", "low").distinct().groupBy("column").agg(F.count(F.lit(1)).alias("lower_distinct"))
    agg = agg.join(lower, "column", "left").withColumn("lower_distinct", F.coalesce("lower_distinct", F.lit(0)))
    txt = top_values_text(top_texts(df, cols, k, freq))
    rows = F.col("rows").cast("double")
    ent = F.when(F.col("cardinality") > 1,
                 F.log2(rows) - F.col("s_nlogn") / rows).otherwise(F.lit(0.0))
    dtype_col = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(dtypes[c]))])
    return agg.join(txt, "column").select(
        "column", dtype_col[F.col("column")].alias("dtype"),
        F.col("top_values"),
        F.col("cardinality").cast("long").alias("cardinality"),
        ent.alias("entropy"),
        _pct(F.col("nulls"), F.col("rows")).alias("missing_percent"),
        (F.col("cardinality") > HIGH_CARDINALITY).alias("high_cardinality"),
        (F.col("cardinality") == 1).alias("is_constant"),
        (F.col("lower_distinct") == F.col("cardinality")).alias("lowercase_consistent"),
        F.try_divide(F.col("len_sum").cast("double"), (F.col("rows") - F.col("nulls")).cast("double")).alias("avg_str_length"))


def datetime_profile(df: DataFrame, cols: list[str] | None = None, order: list[str] | None = None,
                     partitions: int | None = None) -> DataFrame:
    """Min, max, missing share and (given an order) lag-1 autocorrelation."""
    cols = list(cols if cols is not None else columns_by_kind(df)["datetime"])
    dtypes = _dtype_map(df)

    def per_col(c):
        ts = F.col(c).cast("timestamp_ntz")
        return [("nn", F.count(ts)), ("min_timestamp", F.min(ts)), ("max_timestamp", F.max(ts))]

    stats = _long_stats(df, cols, per_col)
    dtype_col = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(dtypes[c]))])
    out = stats.select("column", dtype_col[F.col("column")].alias("dtype"), "min_timestamp", "max_timestamp",
                       _pct(F.col("rows") - F.col("nn"), F.col("rows")).alias("missing_percent"))
    if order:
        ac = None
        for c in cols:
            one = lag1_autocorr(df, c, order, partitions, column_name=c)
            ac = one if ac is None else ac.unionByName(one)
        out = out.join(ac, "column", "left")
    return out


def other_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    dtypes = _dtype_map(df)
    return df.sparkSession.createDataFrame([(c, dtypes[c]) for c in cols], "column string, dtype string")


def feature_profile(df: DataFrame, target: str | None = None, order: list[str] | None = None,
                    partitions: int | None = None) -> DataFrame:
    """One row per non-target column; C3-C9 by type, union on a superset schema."""
    kinds = columns_by_kind(df, exclude=(target,) if target else ())
    parts = []
    if kinds["bool"]:
        parts.append(bool_profile(df, kinds["bool"]).withColumn("kind", F.lit("bool")))
    if kinds["numeric"]:
        parts.append(numeric_profile(df, kinds["numeric"]).drop("min", "max")
                     .withColumn("kind", F.lit("numeric")))
    if kinds["categorical"]:
        parts.append(categorical_profile(df, kinds["categorical"]).withColumn("kind", F.lit("categorical")))
    if kinds["datetime"]:
        parts.append(datetime_profile(df, kinds["datetime"], order, partitions).withColumn("kind", F.lit("datetime")))
    if kinds["other"]:
        parts.append(other_profile(df, kinds["other"]).withColumn("kind", F.lit("other")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


# ---------------------------------------------------------------------------
# C11 / C12 targets
# ---------------------------------------------------------------------------

def target_profile_numeric(df: DataFrame, target: str) -> DataFrame:
    """C11: numeric or bool target; bool is taken as 0/1."""
    x = df.select(F.col(target).cast("double").alias(target))
    p = numeric_profile(x, [target])
    return p.select(
        "column", F.lit(df.schema[target].dataType.simpleString()).alias("dtype"), "missing_percent",
        F.col("is_constant").alias("constant_value"), "mean", "median", "std_dev", "q1", "q3",
        (F.col("q3") - F.col("q1")).alias("iqr"), "skewness", "kurtosis", "min", "max",
        (F.col("max") - F.col("min")).alias("range"), "outlier_percent")


def target_profile_class(df: DataFrame, target: str) -> DataFrame:
    """Classes over non-null values; most frequent (ties: smallest value), shares, entropy, imbalance."""
    freq = value_frequency(df, [target])
    nonnull = freq.filter(F.col("value").isNotNull())
    w = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value").asc())
    ranked = nonnull.withColumn("rank", F.row_number().over(w))
    first_two = ranked.filter(F.col("rank") <= 2).groupBy("column").agg(
        F.max(F.when(F.col("rank") == 1, F.col("value"))).alias("most_frequent_class"),
        F.max(F.when(F.col("rank") == 1, F.col("n"))).alias("n1"),
        F.max(F.when(F.col("rank") == 2, F.col("n"))).alias("n2"))
    dist_item = F.struct(F.col("rank"), F.format_string("%s:%.2f%%", F.col("value"),
                                                        F.col("n") * 100.0 / F.col("total")).alias("txt"))
    totals = freq.groupBy("column").agg(
        F.sum("n").alias("rows"), F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("total"),
        F.count("value").alias("num_classes"),
        F.sum(F.when(F.col("value").isNotNull(), F.col("n") * F.log2("n"))).alias("s_nlogn"))
    dist = (ranked.join(totals.select("column", "total"), "column")
            .groupBy("column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(dist_item)),
                                                            lambda s: s["txt"]), "|").alias("class_distribution")))
    tot = F.col("total").cast("double")
    return totals.join(first_two, "column", "left").join(dist, "column", "left").select(
        "column", F.lit(df.schema[target].dataType.simpleString()).alias("dtype"),
        _pct(F.col("rows") - F.col("total"), F.col("rows")).alias("missing_percent"),
        (F.col("num_classes") == 1).alias("constant_value"),
        F.col("num_classes").cast("long").alias("num_classes"), "most_frequent_class",
        _pct(F.col("n1"), F.col("total")).alias("most_frequent_class_percent"),
        "class_distribution",
        F.when(F.col("num_classes") > 1, F.log2(tot) - F.col("s_nlogn") / tot).otherwise(F.lit(0.0)).alias("entropy"),
        F.bround(F.try_divide(F.col("n1").cast("double"), F.col("n2").cast("double")), 2).alias("class_imbalance_ratio"))


# ---------------------------------------------------------------------------
# C14-C16
# ---------------------------------------------------------------------------

def null_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    cols = list(cols or df.columns)
    return _long_stats(df, cols, lambda c: [("nulls", F.count_if(F.col(c).isNull()))])


def null_report(df: DataFrame) -> DataFrame:
    """C14: per-column NULL counts > 0 with the table total."""
    nc = null_counts(df)
    total = F.sum("nulls").over(Window.partitionBy(F.lit(1)))  # one row per column: bounded
    return nc.filter(F.col("nulls") > 0).select("column", F.col("nulls").cast("long").alias("null_count"),
                                                total.cast("long").alias("total_nulls"))


def missing_overall_pct(df: DataFrame) -> DataFrame:
    """NULL cells / (rows x columns) x 100, two decimals."""
    cells = F.lit(0)
    for c in df.columns:
        cells = cells + F.count_if(F.col(c).isNull())
    ncols = len(df.columns)
    return df.agg(cells.alias("nulls"), F.count(F.lit(1)).alias("rows")).select(
        F.col("nulls").cast("long").alias("null_cells"), F.col("rows").cast("long").alias("rows"),
        F.bround(F.try_divide(F.col("nulls") * 100.0, F.col("rows") * float(ncols)), 2).alias("missing_percent"))


def dtype_counts(df: DataFrame) -> DataFrame:
    """Number of columns, and of non-null values in them, per dtype."""
    stats = _long_stats(df, df.columns, lambda c: [("nn", F.count(F.col(c)))])
    dtypes = F.create_map(*[x for c, t in _dtype_map(df).items() for x in (F.lit(c), F.lit(t))])
    return stats.groupBy(dtypes[F.col("column")].alias("dtype")).agg(F.count(F.lit(1)).alias("n_columns"), F.sum("nn").alias("n_values"))


def approx_profile(df: DataFrame, cols: list[str] | None = None, sketches: DataFrame | None = None) -> DataFrame:
    """C17: numeric profile with quartiles and distinct counts of mergeable sketches (``operators.sketches``)."""
    return numeric_profile(df, cols, approx=True, sketches=sketches)


def complete_profile(df: DataFrame, target: str, order: list[str] | None = None) -> dict[str, DataFrame]:
    """Feature profile + target profile + correlation (>= 3 numeric columns) + stable MI.

    Four DataFrames with different shapes; rendering them as text is left to the caller.
    """
    from quarry.operators.assoc import pearson_mean_imputed, stable_mi
    kinds = columns_by_kind(df)
    out = {"features": feature_profile(df, target, order)}
    tdt = df.schema[target].dataType
    out["target"] = (target_profile_numeric(df, target) if column_kind(tdt) in ("numeric", "bool")
                     else target_profile_class(df, target))
    if len(kinds["numeric"]) >= 3:
        out["correlation"] = pearson_mean_imputed(df, kinds["numeric"])
    out["mutual_information"] = stable_mi(df, target)
    return out
