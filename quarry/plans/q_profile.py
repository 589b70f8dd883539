"""Queries for scans (A1, A7) and profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import profile as P
from quarry.operators import sketches as SK
from quarry.operators.freq import distinct_counts, value_frequency
from quarry.operators.ordered import lag1_autocorr
from quarry.plans.catalog import register, rounded
from quarry.plans.fixtures import LINEITEM_NULLS_SQL as LN, LINEITEM_NULLS_TYPES as LT, lineitem_nulls
from quarry.plans.sqlgen import (bool_profile_sql, categorical_profile_sql, datetime_profile_sql,
                                 numeric_profile_sql, q, r6, top_values_sql)
from quarry.session import materialize
from quarry.sources.tables import dataset_columns, load, read_table

NUMERIC = [c for c, t in LT.items() if t in ("bigint", "int", "double")]
CATEG = [c for c, t in LT.items() if t == "string"]
from quarry.plans.fixtures import LINEITEM_ORDER as ORDER  # noqa: E402  (unique row order)


@register("read_table", """SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n,
  round(sum(o_totalprice), 2) AS total_price FROM orders GROUP BY o_orderpriority""")
def q_read_table(spark, sf):
    df = read_table(spark, f"{sf}/orders.parquet")
    return df.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"),
                                             F.round(F.sum("o_totalprice"), 2).alias("total_price"))


_LI_SCHEMA = [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
              ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
              ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")]


@register("dataset_columns", "\nUNION ALL\n".join(
    f"SELECT {i} AS position, '{c}' AS column_name, '{t}' AS dtype, (SELECT count(*) FROM lineitem) AS n_rows, "
    f"{len(_LI_SCHEMA)} AS n_cols" for i, (c, t) in enumerate(_LI_SCHEMA)))
def q_dataset_columns(spark, sf):
    return dataset_columns(load(spark, sf, "lineitem"))


@register("value_frequency", f"""SELECT col AS "column", v AS value, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT 'l_returnflag' AS col, l_returnflag AS v FROM {LN} UNION ALL
  SELECT 'l_linestatus', l_linestatus FROM {LN} UNION ALL
  SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR) FROM {LN}) GROUP BY col, v""")
def q_value_frequency(spark, sf):
    return value_frequency(lineitem_nulls(spark, sf), ["l_returnflag", "l_linestatus", "l_linenumber"])


@register("top_values", f"""SELECT col AS "column", v AS value, CAST(n AS BIGINT) AS n, CAST(rank AS INTEGER) AS rank FROM (
  SELECT col, v, n, row_number() OVER (PARTITION BY col ORDER BY n DESC, v ASC NULLS LAST) AS rank FROM (
    SELECT col, v, count(*) AS n FROM (
      SELECT 'l_returnflag' AS col, l_returnflag AS v FROM {LN} UNION ALL
      SELECT 'l_suppkey', CAST(l_suppkey AS VARCHAR) FROM {LN}) GROUP BY col, v)) WHERE rank <= 10""")
def q_top_values(spark, sf):
    return P.top_values(lineitem_nulls(spark, sf), ["l_returnflag", "l_suppkey"])


@register("binary_columns", f"""SELECT col AS "column", count(*) = 2 AS is_binary FROM (
  {' UNION ALL '.join(f"SELECT DISTINCT '{c}' AS col, CAST({c} AS VARCHAR) AS v FROM {LN}" for c in LT)}) GROUP BY col""")
def q_binary_columns(spark, sf):
    return P.binary_columns(lineitem_nulls(spark, sf))


@register("basic_profile", f"""SELECT s.position, s."column", s.dtype, b.is_binary FROM (
  {' UNION ALL '.join(f"SELECT {i} AS position, '{c}' AS \"column\", '{t}' AS dtype" for i, (c, t) in enumerate(LT.items()))}) s
  LEFT JOIN (SELECT col AS "column", count(*) = 2 AS is_binary FROM (
  {' UNION ALL '.join(f"SELECT DISTINCT '{c}' AS col, CAST({c} AS VARCHAR) AS v FROM {LN}" for c in LT)}) GROUP BY col) b
  ON s."column" = b."column" """)
def q_basic_profile(spark, sf):
    return P.basic_profile(lineitem_nulls(spark, sf))


@register("head_n", """SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 10""")
def q_head_n(spark, sf):
    return P.head_n(load(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], 10)


@register("profile_bool", bool_profile_sql(LN, ["l_is_discounted"]))
def q_profile_bool(spark, sf):
    return rounded(P.bool_profile(lineitem_nulls(spark, sf), ["l_is_discounted"]))


@register("profile_numeric", numeric_profile_sql(LN, {c: LT[c] for c in NUMERIC}))
def q_profile_numeric(spark, sf):
    return rounded(P.numeric_profile(lineitem_nulls(spark, sf), NUMERIC).drop("min", "max"))


@register("profile_categorical", categorical_profile_sql(LN, {c: LT[c] for c in CATEG}))
def q_profile_categorical(spark, sf):
    return rounded(P.categorical_profile(lineitem_nulls(spark, sf), CATEG))


@register("lowercase_consistent", """SELECT 'p_type' AS "column",
  count(DISTINCT lower(p_type)) = count(DISTINCT p_type) AS lowercase_consistent FROM part""")
def q_lowercase_consistent(spark, sf):
    return P.categorical_profile(load(spark, sf, "part"), ["p_type"]).select("column", "lowercase_consistent")


@register("avg_str_length", """SELECT 'text' AS "column", round(avg(length(text)), 6) AS avg_str_length FROM documents""")
def q_avg_str_length(spark, sf):
    return rounded(P.categorical_profile(load(spark, sf, "documents"), ["text"]).select("column", "avg_str_length"))


@register("profile_datetime", datetime_profile_sql(LN, {"l_shipdate": "timestamp_ntz"}, ORDER))
def q_profile_datetime(spark, sf):
    return rounded(P.datetime_profile(lineitem_nulls(spark, sf), ["l_shipdate"], ORDER))


@register("autocorr_lag1", f"""SELECT 'value' AS "column", {r6('''(SELECT CASE WHEN count(nx) >= 2 THEN corr(x, nx) END
  FROM (SELECT x, lead(x) OVER (ORDER BY event_id) AS nx FROM (SELECT value AS x, event_id FROM events WHERE value IS NOT NULL)))''')} AS autocorrelation_lag1""")
def q_autocorr(spark, sf):
    return rounded(lag1_autocorr(load(spark, sf, "events"), "value", ["event_id"], column_name="value"))


def _feature_profile_sql():
    num = [c for c in NUMERIC if c != "l_linestatus"]
    return f"""SELECT * FROM (
  SELECT *, 'bool' AS kind FROM ({bool_profile_sql(LN, ["l_is_discounted"])})
  UNION ALL BY NAME SELECT *, 'numeric' AS kind FROM ({numeric_profile_sql(LN, {c: LT[c] for c in num})})
  UNION ALL BY NAME SELECT *, 'categorical' AS kind FROM ({categorical_profile_sql(LN, {"l_returnflag": "string"})})
  UNION ALL BY NAME SELECT *, 'datetime' AS kind FROM ({datetime_profile_sql(LN, {"l_shipdate": "timestamp_ntz"}, ORDER)}))"""


@register("feature_profile", _feature_profile_sql())
def q_feature_profile(spark, sf):
    return rounded(P.feature_profile(lineitem_nulls(spark, sf), target="l_linestatus", order=ORDER))


@register("target_profile_numeric", f"""SELECT p."column", 'double' AS dtype, p.missing_percent, p.is_constant AS constant_value,
  p.mean, p.median, p.std_dev, p.q1, p.q3, round(p.q3 - p.q1, 6) AS iqr, p.skewness, p.kurtosis, p.min, p.max,
  round(p.max - p.min, 6) AS range, p.outlier_percent
  FROM ({numeric_profile_sql(LN, {"l_quantity": "double"}, with_minmax=True)}) p""")
def q_target_numeric(spark, sf):
    return rounded(P.target_profile_numeric(lineitem_nulls(spark, sf), "l_quantity"))


@register("target_profile_class", f"""WITH f AS (SELECT l_returnflag AS v, count(*) AS n FROM {LN} GROUP BY 1),
  nn AS (SELECT * FROM f WHERE v IS NOT NULL),
  r AS (SELECT v, n, row_number() OVER (ORDER BY n DESC, v ASC) AS rk FROM nn),
  t AS (SELECT sum(n) AS total FROM nn), a AS (SELECT sum(n) AS n_rows FROM f)
SELECT 'l_returnflag' AS "column", 'string' AS dtype,
  {r6('CAST(a.n_rows - t.total AS DOUBLE) * 100 / a.n_rows')} AS missing_percent,
  (SELECT count(*) FROM nn) = 1 AS constant_value, CAST((SELECT count(*) FROM nn) AS BIGINT) AS num_classes,
  (SELECT v FROM r WHERE rk = 1) AS most_frequent_class,
  {r6('CAST((SELECT n FROM r WHERE rk = 1) AS DOUBLE) * 100 / t.total')} AS most_frequent_class_percent,
  (SELECT string_agg(v || ':' || printf('%.2f', CAST(n AS DOUBLE) * 100 / t.total) || '%', '|' ORDER BY rk) FROM r) AS class_distribution,
  CASE WHEN (SELECT count(*) FROM nn) > 1 THEN {r6('(SELECT -sum((n / t.total) * log2(n / t.total)) FROM nn)')} ELSE 0.0 END AS entropy,
  round_even(CAST((SELECT n FROM r WHERE rk = 1) AS DOUBLE) / (SELECT n FROM r WHERE rk = 2), 2) AS class_imbalance_ratio
FROM t, a""")
def q_target_class(spark, sf):
    return rounded(P.target_profile_class(lineitem_nulls(spark, sf), "l_returnflag"))


@register("null_report", f"""SELECT * FROM (SELECT col AS "column", CAST(nulls AS BIGINT) AS null_count,
  CAST(sum(nulls) OVER () AS BIGINT) AS total_nulls FROM (
  {' UNION ALL '.join(f"SELECT '{c}' AS col, count(*) - count({c}) AS nulls FROM {LN}" for c in LT)})) WHERE null_count > 0""")
def q_null_report(spark, sf):
    return P.null_report(lineitem_nulls(spark, sf))


@register("missing_overall_pct", f"""SELECT CAST(nulls AS BIGINT) AS null_cells, CAST(n AS BIGINT) AS rows,
  round_even(CAST(nulls AS DOUBLE) * 100 / (n * {len(LT)}), 2) AS missing_percent FROM (
  SELECT {' + '.join(f'(count(*) - count({c}))' for c in LT)} AS nulls, count(*) AS n FROM {LN})""")
def q_missing_overall(spark, sf):
    return P.missing_overall_pct(lineitem_nulls(spark, sf))


@register("dtype_counts", f"""SELECT dtype, CAST(count(*) AS BIGINT) AS n_columns, CAST(sum(n) AS BIGINT) AS n_values FROM (
  {' UNION ALL '.join(f"SELECT '{t}' AS dtype, count({c}) AS n FROM {LN}" for c, t in LT.items())}) GROUP BY dtype""")
def q_dtype_counts(spark, sf):
    return P.dtype_counts(lineitem_nulls(spark, sf))


_SKETCHED = ["l_extendedprice", "l_quantity", "l_partkey"]


@register("sketch_merge", "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", (SELECT CAST(count(DISTINCT date_trunc('month', l_shipdate)) AS BIGINT) FROM {LN}) AS parts, CAST(count(*) AS BIGINT) AS rows,
  CAST(count({c}) AS BIGINT) AS n, {r6(f'avg({c})')} AS mean, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, true AS ranks_within, true AS distinct_within FROM {LN}"""
    for c in _SKETCHED))
def q_sketch_merge(spark, sf):
    """C17: monthly sketches, merged; whether their quantiles and distinct counts are within the stated errors of the exact ones."""
    li = lineitem_nulls(spark, sf)
    probs = {"p05": 0.05, "q1": 0.25, "median": 0.5, "q3": 0.75, "p95": 0.95}
    monthly = materialize(SK.sketch_table(li.withColumn("month", F.date_trunc("month", F.col("l_shipdate").cast("timestamp"))), _SKETCHED, ["month"]), "sketches")
    prof = materialize(SK.sketch_profile(SK.merge_sketches(monthly), probs), "sketch-profile")  # one row per column
    parts = monthly.groupBy("column").agg(F.count(F.lit(1)).alias("parts"))
    ranks = SK.rank_check(li, prof, probs).groupBy("column").agg(F.bool_and("within").alias("ranks_within"))
    exact = distinct_counts(li, _SKETCHED)
    near = (F.abs(prof["unique_values"] / exact["unique_values"] - 1) <= SK.distinct_error()).alias("distinct_within")
    out = prof.join(exact, "column").join(ranks, "column").join(parts, "column")
    return rounded(out.select("column", "parts", "rows", "n", "mean", "min", "max", "ranks_within", near))


@register("approx_profile")
def q_approx_profile(spark, sf):
    return rounded(P.approx_profile(lineitem_nulls(spark, sf), NUMERIC))
