"""Casting and encoding.

``auto_cast_and_encode`` takes one statistics pass (row count, per-column
distinct counts from the shared frequency table, integer min/max), decides a
rule per column on the driver from those p numbers, and applies every rule in
a single ``select``. One-hot category lists are bounded by the <= 50 rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.digests import cardinality
from quarry.operators.freq import dictionary, value_frequency

# Fixed values of the reference's encoding rules.
ONEHOT_MAX = 50
HASH_BUCKETS = 32
ID_LIKE_RATIO = 0.9
PII_TOKENS = ("name", "email", "phone")
NULL_HASH_TEXT = "nan"
DATE_LIKE = r"^\d{4}-\d{2}-\d{2}"

_INTS = (T.ShortType, T.IntegerType, T.LongType)
_LIMITS = [("tinyint", -128, 127), ("smallint", -32768, 32767), ("int", -2 ** 31, 2 ** 31 - 1),
           ("bigint", -2 ** 63, 2 ** 63 - 1)]


def cast_bool(c: Column) -> Column:
    """boolean -> 0/1 tinyint."""
    return c.cast("tinyint")


def binary_encode(c: Column, low: str, high: str) -> Column:
    """sorted two values -> 0 / 1; NULL stays NULL."""
    return F.when(c == F.lit(high), F.lit(1)).when(c == F.lit(low), F.lit(0)).cast("tinyint")


def one_hot_columns(c: Column, name: str, categories: list[str]) -> list[Column]:
    """dummies for sorted categories minus the first, named ``<col>___<value>``; NULL -> zeros."""
    cats = sorted(v for v in categories if v is not None)
    return [F.coalesce((c == F.lit(v)), F.lit(False)).cast("tinyint").alias(f"{name}___{v}") for v in cats[1:]]


def hash_trick(c: Column, buckets: int = HASH_BUCKETS, null_text: str | None = NULL_HASH_TEXT) -> Column:
    """the whole md5 of the text as a number, mod buckets: int(md5hex, 16) % buckets."""
    txt = c.cast("string")
    if null_text is not None:
        txt = F.coalesce(txt, F.lit(null_text))
    digest, out = F.md5(txt), F.lit(0).cast("bigint")
    for at in range(1, 33, 7):  # 28 bits at a time
        size = min(7, 33 - at)
        out = F.pmod(out * F.lit(16**size) + F.conv(F.substring(digest, at, size), 16, 10).cast("bigint"), F.lit(buckets))
    return out.cast("smallint" if buckets <= 2**15 else "int")


def smallest_int_type(lo, hi) -> str:
    """smallest signed Spark integer type holding [lo, hi]."""
    if lo is None or hi is None:
        return "tinyint"
    for name, a, b in _LIMITS:
        if a <= lo and hi <= b:
            return name
    return "bigint"


def drop_pii(df: DataFrame, protect=()) -> DataFrame:
    """the table without columns whose name is that of personal data, but for protected ones."""
    return df.drop(*[c for c in df.columns if c not in protect and is_pii_name(c)])


def is_pii_name(name: str) -> bool:
    """column name contains name/email/phone, case-insensitive."""
    low = name.lower()
    return any(t in low for t in PII_TOKENS)


def column_stats(df: DataFrame) -> dict[str, dict]:
    """Rows, non-null distinct counts (of texts by digest) and integer min/max (p values returned)."""
    fields = df.schema.fields
    ints = [f.name for f in fields if isinstance(f.dataType, _INTS)]
    agg = df.agg(F.count(F.lit(1)).alias("__rows"),
                 *[F.min(c).alias(f"{c}__min") for c in ints], *[F.max(c).alias(f"{c}__max") for c in ints]).first()
    nun = {r["column"]: r["unique_values"] for r in cardinality(df, df.columns).collect()}
    out = {}
    for f in fields:
        out[f.name] = {"rows": agg["__rows"], "nunique": nun.get(f.name, 0),
                       "min": agg[f"{f.name}__min"] if f.name in ints else None,
                       "max": agg[f"{f.name}__max"] if f.name in ints else None}
    return out


def plan_encoding(df: DataFrame, pii_first: bool = False, protect=(), mode: str = "reference") -> list[dict]:
    """F8 rules as a plan: one dict per input column (action, notes, categories...)."""
    stats = column_stats(df)
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    small = [c for c in strings if 2 < stats[c]["nunique"] <= ONEHOT_MAX or stats[c]["nunique"] == 2]
    cats = {}
    if small:
        for r in value_frequency(df, small, drop_null=True).select("column", "value").collect():  # <= 50 per column
            cats.setdefault(r["column"], []).append(r["value"])
    plan = []
    for f in df.schema.fields:
        c, dt, st = f.name, f.dataType, stats[f.name]
        item = {"column": c, "dtype_before": dt.simpleString(), "dtype_after": None, "action": None, "notes": None}
        if pii_first and c not in protect and is_pii_name(c):
            item.update(action="drop", notes="PII")
        elif isinstance(dt, T.BooleanType):
            item.update(action="cast_to_uint8", dtype_after="tinyint")
        elif isinstance(dt, T.StringType):
            nu = st["nunique"]
            if nu == 2:
                lo, hi = sorted(cats[c])
                item.update(action="binary_encode", dtype_after="tinyint", low=lo, high=hi)
            elif nu <= ONEHOT_MAX:
                item.update(action="one_hot_encode", dtype_after="one_hot_encoded", categories=sorted(cats.get(c, [])))
            else:
                item.update(action="hashing_trick", dtype_after="smallint")
        elif isinstance(dt, _INTS):
            item.update(action="safe_cast", dtype_after=smallest_int_type(st["min"], st["max"]))
        elif c not in protect and st["rows"] and (st["nunique"] / st["rows"] >= ID_LIKE_RATIO or st["nunique"] == 1) \
                and not (mode == "id_like_only" and isinstance(dt, (T.FloatType, T.DoubleType))):
            item.update(action="drop", notes="quasi-constant or constant")
        elif not pii_first and c not in protect and is_pii_name(c):
            item.update(action="drop", notes="PII")
        else:
            item.update(action="no_action", dtype_after=dt.simpleString())
        plan.append(item)
    return plan


def apply_encoding(df: DataFrame, plan: list[dict]) -> DataFrame:
    out = []
    for item in plan:
        c, a = F.col(item["column"]), item["action"]
        name = item["column"]
        if a == "cast_to_uint8":
            out.append(cast_bool(c).alias(name))
        elif a == "binary_encode":
            out.append(binary_encode(c, item["low"], item["high"]).alias(name))
        elif a == "one_hot_encode":
            out.extend(one_hot_columns(c, name, item["categories"]))
        elif a == "hashing_trick":
            out.append(hash_trick(c).alias(f"hash_{name}_{HASH_BUCKETS}"))
        elif a == "safe_cast":
            out.append(c.cast(item["dtype_after"]).alias(name))
        elif a == "drop":
            continue
        else:
            out.append(c.alias(name))
    return df.select(*out)


def auto_cast_and_encode(df: DataFrame, pii_first: bool = False, protect=(), mode: str = "reference"):
    """F8: ordered rule cascade applied in one projection; returns (frame, report)."""
    plan = plan_encoding(df, pii_first, protect, mode)
    return apply_encoding(df, plan), encoding_report(df.sparkSession, plan)


def encoding_report(spark, plan: list[dict]) -> DataFrame:
    """per column dtype_before, dtype_after, action, notes (one row per input column)."""
    rows = [(p["column"], p["dtype_before"], p["dtype_after"], p["action"], p["notes"]) for p in plan]
    return spark.createDataFrame(rows, "column string, dtype_before string, dtype_after string, action string, notes string")


def target_encode_label(df: DataFrame, target: str, output: str | None = None) -> DataFrame:
    """label-encode a non-numeric target by sorted distinct values (never one-hot); any number of them."""
    codes = dictionary(df, [target]).select(F.col("value").alias("_value"), F.col("code").cast("int").alias(output or f"{target}_label"))
    return df.join(codes, F.col(f"`{target}`").cast("string") == F.col("_value"), "left").drop("_value")


def categories(df: DataFrame, col: str) -> list[str]:
    """the sorted values of a column to be one-hot encoded; more than the one-hot rule's 50 are an error."""
    rows = df.select(F.col(f"`{col}`").cast("string")).dropna().distinct().limit(ONEHOT_MAX + 1).collect()
    if len(rows) > ONEHOT_MAX:
        raise ValueError(f"{col} has more than {ONEHOT_MAX} values: hash it instead")
    return sorted(r[0] for r in rows)


def type_suggest(df: DataFrame, cols: list[str] | None = None, threshold: float = 1.0) -> DataFrame:
    """suggest a type per string column from the share of values each cast accepts."""
    cols = list(cols if cols is not None else [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)])
    freq = value_frequency(df, cols, drop_null=True)
    v = F.col("value")
    stats = freq.groupBy("column").agg(
        F.sum("n").alias("non_null"),
        F.count(F.lit(1)).alias("distinct_values"),
        F.sum(F.when(v.try_cast("double").isNotNull(), F.col("n")).otherwise(0)).alias("numeric_n"),
        F.sum(F.when(v.rlike(DATE_LIKE) & F.try_to_timestamp(v).isNotNull(), F.col("n")).otherwise(0)).alias("timestamp_n"))
    num_share = F.try_divide(F.col("numeric_n").cast("double"), F.col("non_null").cast("double"))
    ts_share = F.try_divide(F.col("timestamp_n").cast("double"), F.col("non_null").cast("double"))
    return stats.select(
        "column", F.col("non_null").cast("long").alias("non_null"), F.col("distinct_values").cast("long").alias("distinct_values"),
        num_share.alias("numeric_share"), ts_share.alias("timestamp_share"),
        F.when(F.col("distinct_values") == 2, F.lit("boolean"))
        .when(num_share >= threshold, F.lit("number"))
        .when(ts_share >= threshold, F.lit("timestamp"))
        .otherwise(F.lit("string")).alias("suggested_type"))
