"""Missing-value operators (B16, C14-based dispatch, E1-E8).

Fill values are bounded statistics (one per column) computed by one
aggregation and applied in a single projection; ordered fills use the
range-partitioned segmented scan so a hot key never lands in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.digests import digest_frequency, top_texts
from quarry.operators.freq import value_frequency
from quarry.operators.ordered import segmented_scan
from quarry.operators.profile import columns_by_kind
from quarry.operators.radix import quantiles

STRATEGIES = ("drop", "mean", "median", "mode", "ffill", "bfill", "constant")


def drop_null_rows(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Drop rows with any NULL."""
    return df.na.drop("any", subset=subset)


def _numeric_cols(df: DataFrame) -> list[str]:
    return columns_by_kind(df)["numeric"]


def _fill_with(df: DataFrame, values: dict[str, object], cast_double: bool = False) -> DataFrame:
    out = []
    for f in df.schema.fields:
        if f.name in values and values[f.name] is not None:
            src = F.col(f.name).cast("double") if cast_double else F.col(f.name)
            lit = F.lit(values[f.name])
            lit = lit.cast("double") if cast_double else lit.cast(f.dataType)
            out.append(F.coalesce(src, lit).alias(f.name))
        elif f.name in values and cast_double:
            out.append(F.col(f.name).cast("double").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def _null_counts(df: DataFrame, cols: list[str]) -> dict[str, int]:
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()  # p numbers
    return {c: row[c] for c in cols}


def fill_mean(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Numeric columns with NULLs <- their mean (as double); bool, strings and complete columns untouched."""
    cols = list(cols if cols is not None else _numeric_cols(df))
    if not cols:
        return df
    aggs = [F.avg(F.col(c).cast("double")).alias(c) for c in cols] + \
           [F.count_if(F.col(c).isNull()).alias(f"{c}__nulls") for c in cols]
    row = df.agg(*aggs).first()  # one row of p means and p null counts
    return _fill_with(df, {c: row[c] for c in cols if row[f"{c}__nulls"] > 0}, cast_double=True)


def fill_median(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Numeric columns with NULLs <- exact median (linear interpolation), by radix selection."""
    cols = list(cols if cols is not None else _numeric_cols(df))
    nulls = _null_counts(df, cols) if cols else {}
    cols = [c for c in cols if nulls.get(c, 0) > 0]
    if not cols:
        return df
    med = quantiles(df, cols, [0.5])
    return _fill_with(df, {c: q[0.5] for c, q in med.items()}, cast_double=True)


def mode_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """Most frequent non-null value per column, smallest on a tie: ``(column, value)``; texts are counted by digest."""
    texts = [f.name for f in df.schema.fields if f.name in cols and isinstance(f.dataType, T.StringType)]
    others = [c for c in cols if c not in texts]
    parts = []
    if texts:
        freq = digest_frequency(df, texts).filter(F.col("h1").isNotNull())
        parts.append(top_texts(df, texts, 1, freq).select("column", "value"))
    if others:
        # typed ordering: compare numerically for numeric columns via a double key
        w = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("key_num").asc_nulls_last(), F.col("value").asc())
        parts.append(value_frequency(df, others, drop_null=True).withColumn("key_num", F.col("value").try_cast("double"))
                     .withColumn("rk", F.row_number().over(w)).filter(F.col("rk") == 1).select("column", "value"))
    return reduce(DataFrame.unionByName, parts)


def fill_mode(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Any column with NULLs <- its mode (smallest on tie); numeric order for numeric columns."""
    cols = list(cols or df.columns)
    modes = {r["column"]: r["value"] for r in mode_values(df, cols).collect()}  # p rows
    return _fill_with(df, modes)


def ffill(df: DataFrame, cols: list[str], order: list[str], keys: list[str] | None = None) -> DataFrame:
    """Last non-null value at or above, per key in ``order``; leading NULLs stay."""
    specs = {f"__ff_{c}": ("ffill", c) for c in cols}
    out = segmented_scan(df, keys or [], order, specs)
    return out.select(*[F.col(f"__ff_{f.name}").alias(f.name) if f.name in cols else F.col(f.name)
                        for f in df.schema.fields])


def bfill(df: DataFrame, cols: list[str], order: list[str], keys: list[str] | None = None) -> DataFrame:
    """E5: next non-null value at or below; trailing NULLs stay."""
    specs = {f"__bf_{c}": ("bfill", c) for c in cols}
    out = segmented_scan(df, keys or [], order, specs)
    return out.select(*[F.col(f"__bf_{f.name}").alias(f.name) if f.name in cols else F.col(f.name)
                        for f in df.schema.fields])


def fill_constant(df: DataFrame, value) -> DataFrame:
    """Constant into every type-compatible column; a missing constant is an error."""
    if value is None:
        raise ValueError("constant_value must be provided for the 'constant' strategy")
    return df.na.fill(value)


def null_total(df: DataFrame) -> int:
    cells = F.lit(0)
    for c in df.columns:
        cells = cells + F.count_if(F.col(c).isNull())
    return df.agg(cells.alias("n")).first()["n"]


def handle_null(df: DataFrame, strategy: str, constant_value=None, order: list[str] | None = None,
                keys: list[str] | None = None) -> DataFrame:
    """Dispatcher; a table without NULLs is returned unchanged."""
    if strategy not in STRATEGIES:
        raise ValueError(f"Unknown strategy: {strategy}")
    if null_total(df) == 0:
        return df
    if strategy == "drop":
        return drop_null_rows(df)
    if strategy == "mean":
        return fill_mean(df)
    if strategy == "median":
        return fill_median(df)
    if strategy == "mode":
        return fill_mode(df)
    if strategy in ("ffill", "bfill"):
        if not order:
            raise ValueError("ffill/bfill need an explicit order: Spark rows have no order")
        cols = [c for c in df.columns if c not in (order or []) and c not in (keys or [])]
        return (ffill if strategy == "ffill" else bfill)(df, cols, order, keys)
    return fill_constant(df, constant_value)


def _clean_value(c: Column, dt: T.DataType) -> Column:
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None).cast(dt)).otherwise(c)
    if isinstance(dt, T.ArrayType):
        return F.transform(c, lambda e: _clean_value(e, dt.elementType))
    if isinstance(dt, T.MapType):
        return F.transform_values(c, lambda k, v: _clean_value(v, dt.valueType))
    if isinstance(dt, T.StructType):
        return F.struct(*[_clean_value(c[f.name], f.dataType).alias(f.name) for f in dt.fields])
    return c


def nan_inf_to_null(df: DataFrame) -> DataFrame:
    """NaN and +-Inf -> NULL, recursively through arrays, maps and structs."""
    return df.select(*[_clean_value(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])
