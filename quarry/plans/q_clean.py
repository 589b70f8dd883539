"""Queries for missing values (B16, E1-E8) and encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import clean as C
from quarry.operators import encode as E
from quarry.plans.catalog import register, rounded
from quarry.plans.fixtures import (CONVERSATIONS_GAPS_SQL as CG, EVENTS_NAN_SQL, LINEITEM_NULLS_SQL as LN, LINEITEM_ORDER,
                                   conversations_gaps, events_nan, lineitem_nulls)
from quarry.sources.tables import load

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
KEYS_SQL = ", ".join(KEYS)


def _li(spark, sf):
    return lineitem_nulls(spark, sf).select(*KEYS, "l_quantity", "l_discount", "l_returnflag")


@register("drop_null_rows", f"SELECT {KEYS_SQL}, l_quantity, l_discount, l_returnflag FROM {LN} "
          "WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL AND l_returnflag IS NOT NULL")
def q_drop_null_rows(spark, sf):
    return C.drop_null_rows(_li(spark, sf))


@register("fill_mean", f"""SELECT {KEYS_SQL},
  round(coalesce(l_quantity, (SELECT avg(l_quantity) FROM {LN})), 6) AS l_quantity,
  round(coalesce(l_discount, (SELECT avg(l_discount) FROM {LN})), 6) AS l_discount, l_returnflag FROM {LN}""")
def q_fill_mean(spark, sf):
    return rounded(C.fill_mean(_li(spark, sf), ["l_quantity", "l_discount"]))


@register("fill_median", f"""SELECT {KEYS_SQL},
  round(coalesce(l_quantity, (SELECT quantile_cont(l_quantity, 0.5) FROM {LN})), 6) AS l_quantity,
  round(coalesce(l_discount, (SELECT quantile_cont(l_discount, 0.5) FROM {LN})), 6) AS l_discount, l_returnflag FROM {LN}""")
def q_fill_median(spark, sf):
    return rounded(C.fill_median(_li(spark, sf), ["l_quantity", "l_discount"]))


def _mode(col):
    return (f"(SELECT v FROM (SELECT {col} AS v, count(*) AS n FROM {LN} WHERE {col} IS NOT NULL GROUP BY 1) "
            f"ORDER BY n DESC, v ASC LIMIT 1)")


@register("fill_mode", f"""SELECT {KEYS_SQL}, coalesce(l_quantity, {_mode('l_quantity')}) AS l_quantity,
  coalesce(l_discount, {_mode('l_discount')}) AS l_discount, coalesce(l_returnflag, {_mode('l_returnflag')}) AS l_returnflag
  FROM {LN}""")
def q_fill_mode(spark, sf):
    return C.fill_mode(_li(spark, sf))


@register("ffill", f"""SELECT conv_id, turn, role,
  last_value(role_gap IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS role_gap,
  last_value(len_gap IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS len_gap
  FROM {CG}""")
def q_ffill(spark, sf):
    return C.ffill(conversations_gaps(spark, sf), ["role_gap", "len_gap"], ["turn"], keys=["conv_id"])


@register("bfill", f"""SELECT conv_id, turn, role,
  first_value(role_gap IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS role_gap,
  first_value(len_gap IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS len_gap
  FROM {CG}""")
def q_bfill(spark, sf):
    return C.bfill(conversations_gaps(spark, sf), ["role_gap", "len_gap"], ["turn"], keys=["conv_id"])


@register("ffill_keyless", f"""SELECT {KEYS_SQL},
  last_value(l_quantity IGNORE NULLS) OVER (ORDER BY {', '.join(LINEITEM_ORDER)} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l_quantity
  FROM {LN}""")
def q_ffill_keyless(spark, sf):
    li = lineitem_nulls(spark, sf).select(*LINEITEM_ORDER, "l_quantity")
    return C.ffill(li, ["l_quantity"], LINEITEM_ORDER).select(*KEYS, "l_quantity")


@register("fill_constant", f"""SELECT {KEYS_SQL}, coalesce(l_quantity, 0) AS l_quantity, coalesce(l_discount, 0) AS l_discount,
  l_returnflag FROM {LN}""")
def q_fill_constant(spark, sf):
    return C.fill_constant(_li(spark, sf), 0)


@register("handle_null", f"""SELECT {KEYS_SQL},
  round(coalesce(l_quantity, (SELECT quantile_cont(l_quantity, 0.5) FROM {LN})), 6) AS l_quantity,
  round(coalesce(l_discount, (SELECT quantile_cont(l_discount, 0.5) FROM {LN})), 6) AS l_discount, l_returnflag FROM {LN}""")
def q_handle_null(spark, sf):
    return rounded(C.handle_null(_li(spark, sf), "median"))


@register("nan_inf_to_null", f"""SELECT event_id, CASE WHEN isnan(value) OR isinf(value) THEN NULL ELSE value END AS value
  FROM {EVENTS_NAN_SQL}""")
def q_nan_inf(spark, sf):
    return C.nan_inf_to_null(events_nan(spark, sf)).select("event_id", "value")


# ---------------------------------------------------------------------------
# encoding
# ---------------------------------------------------------------------------

@register("cast_bool", f"SELECT {KEYS_SQL}, CAST(l_is_discounted AS TINYINT) AS l_is_discounted FROM {LN}")
def q_cast_bool(spark, sf):
    li = lineitem_nulls(spark, sf)
    return li.select(*KEYS, E.cast_bool(F.col("l_is_discounted")).alias("l_is_discounted"))


@register("binary_encode", f"""SELECT {KEYS_SQL}, CAST(CASE WHEN l_linestatus = (SELECT max(l_linestatus) FROM lineitem) THEN 1
  WHEN l_linestatus = (SELECT min(l_linestatus) FROM lineitem) THEN 0 END AS TINYINT) AS l_linestatus FROM lineitem""")
def q_binary_encode(spark, sf):
    li = load(spark, sf, "lineitem")
    plan = [p for p in E.plan_encoding(li.select("l_linestatus")) if p["action"] == "binary_encode"][0]
    return li.select(*KEYS, E.binary_encode(F.col("l_linestatus"), plan["low"], plan["high"]).alias("l_linestatus"))


def _long(df, key, cols):
    return df.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
                                               for c in cols])).alias("kv")).select(key, "kv.column", "kv.value")


@register("one_hot", """WITH cats AS (SELECT DISTINCT c_mktsegment AS v FROM customer WHERE c_mktsegment IS NOT NULL),
k AS (SELECT v FROM cats WHERE v > (SELECT min(v) FROM cats))
SELECT c_custkey, 'c_mktsegment___' || k.v AS "column", CAST(coalesce(c_mktsegment = k.v, false) AS DOUBLE) AS value
FROM customer, k""")
def q_one_hot(spark, sf):
    cu = load(spark, sf, "customer")
    cats = E.categories(cu, "c_mktsegment")
    wide = cu.select("c_custkey", *E.one_hot_columns(F.col("c_mktsegment"), "c_mktsegment", cats))
    return _long(wide, "c_custkey", [c for c in wide.columns if c != "c_custkey"])


@register("hash_trick", """SELECT p_partkey, CAST(CAST(('0x' || right(md5(coalesce(p_name, 'nan')), 8)) AS BIGINT) % 32 AS SMALLINT)
  AS hash_p_name_32 FROM part""")
def q_hash_trick(spark, sf):
    pa = load(spark, sf, "part")
    return pa.select("p_partkey", E.hash_trick(F.col("p_name")).alias("hash_p_name_32"))


def _int_type_sql(col, table):
    lo, hi = f"(SELECT min({col}) FROM {table})", f"(SELECT max({col}) FROM {table})"
    return (f"CASE WHEN {lo} >= -128 AND {hi} <= 127 THEN 'tinyint' WHEN {lo} >= -32768 AND {hi} <= 32767 THEN 'smallint' "
            f"WHEN {lo} >= -2147483648 AND {hi} <= 2147483647 THEN 'int' ELSE 'bigint' END")


@register("int_downcast", f"""SELECT 'c_custkey' AS "column", {_int_type_sql('c_custkey', 'customer')} AS dtype_after
UNION ALL SELECT 'c_nationkey', {_int_type_sql('c_nationkey', 'customer')}""")
def q_int_downcast(spark, sf):
    cu = load(spark, sf, "customer").select("c_custkey", "c_nationkey")
    plan = E.plan_encoding(cu)
    out = E.apply_encoding(cu, plan)
    return out.agg(F.lit(1)).select(F.inline(F.array(*[F.struct(F.lit(f.name).alias("column"),
                                                                  F.lit(f.dataType.simpleString()).alias("dtype_after"))
                                                         for f in out.schema.fields])))


@register("drop_constant_or_idlike", """SELECT 'o_totalprice' AS "column",
  CASE WHEN count(DISTINCT o_totalprice) * 1.0 / count(*) >= 0.9 OR count(DISTINCT o_totalprice) = 1 THEN 'drop' ELSE 'no_action' END AS action FROM orders
UNION ALL SELECT 'o_orderdate', CASE WHEN count(DISTINCT o_orderdate) * 1.0 / count(*) >= 0.9 OR count(DISTINCT o_orderdate) = 1
  THEN 'drop' ELSE 'no_action' END FROM orders""")
def q_drop_constant(spark, sf):
    o = load(spark, sf, "orders").select("o_totalprice", "o_orderdate")
    plan = E.plan_encoding(o)
    return E.encoding_report(spark, plan).select("column", "action")


_CUST_PLAN_SQL = f"""SELECT 'c_custkey' AS "column", 'bigint' AS dtype_before, {_int_type_sql('c_custkey', 'customer')} AS dtype_after,
  'safe_cast' AS action, CAST(NULL AS VARCHAR) AS notes
UNION ALL SELECT 'c_name', 'string', CASE WHEN (SELECT count(DISTINCT c_name) FROM customer) = 2 THEN 'tinyint'
  WHEN (SELECT count(DISTINCT c_name) FROM customer) <= 50 THEN 'one_hot_encoded' ELSE 'smallint' END,
  CASE WHEN (SELECT count(DISTINCT c_name) FROM customer) = 2 THEN 'binary_encode'
  WHEN (SELECT count(DISTINCT c_name) FROM customer) <= 50 THEN 'one_hot_encode' ELSE 'hashing_trick' END, NULL
UNION ALL SELECT 'c_nationkey', 'int', {_int_type_sql('c_nationkey', 'customer')}, 'safe_cast', NULL
UNION ALL SELECT 'c_acctbal', 'double',
  CASE WHEN (SELECT count(DISTINCT c_acctbal) * 1.0 / count(*) >= 0.9 OR count(DISTINCT c_acctbal) = 1 FROM customer) THEN NULL ELSE 'double' END,
  CASE WHEN (SELECT count(DISTINCT c_acctbal) * 1.0 / count(*) >= 0.9 OR count(DISTINCT c_acctbal) = 1 FROM customer) THEN 'drop' ELSE 'no_action' END,
  CASE WHEN (SELECT count(DISTINCT c_acctbal) * 1.0 / count(*) >= 0.9 OR count(DISTINCT c_acctbal) = 1 FROM customer) THEN 'quasi-constant or constant' END
UNION ALL SELECT 'c_mktsegment', 'string', CASE WHEN (SELECT count(DISTINCT c_mktsegment) FROM customer) = 2 THEN 'tinyint'
  WHEN (SELECT count(DISTINCT c_mktsegment) FROM customer) <= 50 THEN 'one_hot_encoded' ELSE 'smallint' END,
  CASE WHEN (SELECT count(DISTINCT c_mktsegment) FROM customer) = 2 THEN 'binary_encode'
  WHEN (SELECT count(DISTINCT c_mktsegment) FROM customer) <= 50 THEN 'one_hot_encode' ELSE 'hashing_trick' END, NULL"""


@register("encoding_report", _CUST_PLAN_SQL)
def q_encoding_report(spark, sf):
    _, report = E.auto_cast_and_encode(load(spark, sf, "customer"))
    return report


@register("auto_cast_and_encode", """WITH cats AS (SELECT DISTINCT c_mktsegment AS v FROM customer WHERE c_mktsegment IS NOT NULL),
k AS (SELECT v FROM cats WHERE v > (SELECT min(v) FROM cats))
SELECT c_custkey, 'c_custkey' AS "column", CAST(c_custkey AS DOUBLE) AS value FROM customer
UNION ALL SELECT c_custkey, 'hash_c_name_32', CAST(CAST(('0x' || right(md5(coalesce(c_name, 'nan')), 8)) AS BIGINT) % 32 AS DOUBLE) FROM customer
UNION ALL SELECT c_custkey, 'c_nationkey', CAST(c_nationkey AS DOUBLE) FROM customer
UNION ALL SELECT c_custkey, 'c_mktsegment___' || k.v, CAST(coalesce(c_mktsegment = k.v, false) AS DOUBLE) FROM customer, k""")
def q_auto_cast(spark, sf):
    cu = load(spark, sf, "customer")
    out, _ = E.auto_cast_and_encode(cu)
    keyed = out.withColumn("__key", F.col("c_custkey").cast("bigint"))
    long = _long(keyed, "__key", [c for c in out.columns])
    return long.withColumnRenamed("__key", "c_custkey")


@register("target_encode_label", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag,
  CAST(CASE WHEN l_returnflag IS NOT NULL THEN dense_rank() OVER (PARTITION BY l_returnflag IS NULL ORDER BY l_returnflag) - 1 END AS INTEGER)
  AS l_returnflag_label FROM lineitem""")
def q_target_label(spark, sf):
    li = load(spark, sf, "lineitem").select(*KEYS, "l_returnflag")
    return E.target_encode_label(li, "l_returnflag")


_TS_INPUT = """(SELECT o_orderstatus AS status_txt, CAST(o_custkey AS VARCHAR) AS cust_txt,
  CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date_txt FROM orders)"""


@register("type_suggest", "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", CAST(count({c}) AS BIGINT) AS non_null, CAST(count(DISTINCT {c}) AS BIGINT) AS distinct_values,
  round(CAST(count(TRY_CAST({c} AS DOUBLE)) AS DOUBLE) / count({c}), 6) AS numeric_share,
  round(CAST(count_if(regexp_matches({c}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') AND TRY_CAST({c} AS TIMESTAMP) IS NOT NULL) AS DOUBLE) / count({c}), 6) AS timestamp_share,
  CASE WHEN count(DISTINCT {c}) = 2 THEN 'boolean' WHEN count(TRY_CAST({c} AS DOUBLE)) = count({c}) THEN 'number'
  WHEN count_if(regexp_matches({c}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') AND TRY_CAST({c} AS TIMESTAMP) IS NOT NULL) = count({c}) THEN 'timestamp' ELSE 'string' END AS suggested_type FROM {_TS_INPUT}"""
    for c in ("status_txt", "cust_txt", "date_txt")))
def q_type_suggest(spark, sf):
    o = load(spark, sf, "orders")
    df = o.select(F.col("o_orderstatus").alias("status_txt"), F.col("o_custkey").cast("string").alias("cust_txt"),
                  F.col("o_orderdate").cast("date").cast("string").alias("date_txt"))
    return rounded(E.type_suggest(df))
