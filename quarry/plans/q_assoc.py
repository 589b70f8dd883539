"""Queries for association statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import assoc as A
from quarry.plans.catalog import register, rounded
from quarry.plans.fixtures import LINEITEM_NULLS_SQL as LN, lineitem_nulls
from quarry.plans.sqlgen import pearson_sql, stable_mi_sql
from quarry.sources.tables import load

CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@register("pearson_mean_imputed", pearson_sql(LN, CORR_COLS))
def q_pearson(spark, sf):
    return A.pearson_mean_imputed(lineitem_nulls(spark, sf), CORR_COLS)


@register("target_correlation", f"""SELECT col_a AS feature, CASE WHEN col_a = 'l_extendedprice' THEN 1.0 ELSE corr END AS corr
  FROM ({pearson_sql(LN, CORR_COLS)}) WHERE col_b = 'l_extendedprice'""")
def q_target_corr(spark, sf):
    return A.target_correlation(A.pearson_mean_imputed(lineitem_nulls(spark, sf), CORR_COLS), "l_extendedprice")


@register("pcc_sketch")
def q_pcc_sketch(spark, sf):
    li = lineitem_nulls(spark, sf).withColumn("_row", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    return A.pcc_sketch(li, CORR_COLS, target="l_extendedprice", id_col="_row")


_EDGES10 = ("list_slice(list_filter(e, lambda x, i: i = 1 OR x - e[i - 1] > 1e-8), 2, "
            "len(list_filter(e, lambda x, i: i = 1 OR x - e[i - 1] > 1e-8)) - 1)")


@register("quantile_binning", f"""WITH e AS (SELECT quantile_cont(o_totalprice, [{', '.join(f'{i}/10' for i in range(11))}]) AS e FROM orders)
SELECT o_orderkey, o_totalprice, CAST(len(list_filter({_EDGES10}, lambda x: x <= o_totalprice)) AS INTEGER) AS o_totalprice_bin
FROM orders, e""")
def q_quantile_binning(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return A.quantile_binning(o, "o_totalprice", 10)


@register("contingency", f"""SELECT l_returnflag AS x, l_linestatus AS y, CAST(count(*) AS BIGINT) AS n FROM {LN} GROUP BY 1, 2""")
def q_contingency(spark, sf):
    return A.contingency(lineitem_nulls(spark, sf), "l_returnflag", "l_linestatus")


@register("histogram_mi", f"""WITH c AS (SELECT l_linestatus AS x, l_returnflag AS y, count(*) AS n FROM {LN} WHERE l_returnflag IS NOT NULL GROUP BY 1, 2),
nx AS (SELECT x, sum(n) AS nx FROM c GROUP BY 1), ny AS (SELECT y, sum(n) AS ny FROM c GROUP BY 1),
t AS (SELECT count(*) AS total_n FROM {LN})
SELECT round(sum((CAST(n AS DOUBLE) / total_n) * log2(CAST(n AS DOUBLE) * total_n / (nx * ny))), 6) AS mi
FROM c JOIN nx USING (x) JOIN ny USING (y), t""")
def q_histogram_mi(spark, sf):
    return rounded(A.histogram_mi(lineitem_nulls(spark, sf), "l_linestatus", "l_returnflag"))


_ORDERS_MI = "(SELECT o_orderpriority, 'c' || CAST(o_custkey % 97 AS VARCHAR) AS o_cust_bucket, o_orderstatus FROM orders)"


def _orders_mi(spark, sf):
    o = load(spark, sf, "orders")
    return o.select("o_orderpriority", F.concat(F.lit("c"), F.pmod("o_custkey", F.lit(97)).cast("string")).alias("o_cust_bucket"),
                    "o_orderstatus")


@register("onehot_mi", stable_mi_sql(_ORDERS_MI, "o_orderstatus", {"o_orderpriority": "onehot", "o_cust_bucket": "onehot"}, False))
def q_onehot_mi(spark, sf):
    return A.stable_mi(_orders_mi(spark, sf), "o_orderstatus")


_LOWCARD = f"(SELECT l_is_discounted, l_linenumber % 5 AS l_line_mod5, l_returnflag FROM {LN})"


@register("lowcard_mi", stable_mi_sql(_LOWCARD, "l_returnflag", {"l_is_discounted": "lowcard", "l_line_mod5": "lowcard"}, False))
def q_lowcard_mi(spark, sf):
    li = lineitem_nulls(spark, sf)
    return A.stable_mi(li.select("l_is_discounted", F.pmod("l_linenumber", F.lit(5)).alias("l_line_mod5"), "l_returnflag"),
                       "l_returnflag")


_NUMERIC_MI = f"(SELECT l_quantity, l_extendedprice, l_discount, l_returnflag FROM {LN})"


@register("numeric_mi", stable_mi_sql(_NUMERIC_MI, "l_returnflag",
                                      {"l_quantity": "numeric", "l_extendedprice": "numeric", "l_discount": "numeric"}, False,
                                      per_run=True))
def q_numeric_mi(spark, sf):
    li = lineitem_nulls(spark, sf).select("l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
    return rounded(A.stable_mi(li, "l_returnflag", per_run=True))


_STABLE = f"(SELECT l_quantity, l_tax, l_linestatus, l_is_discounted, l_extendedprice FROM {LN})"


@register("stable_mi", stable_mi_sql(_STABLE, "l_extendedprice",
                                     {"l_quantity": "numeric", "l_tax": "numeric", "l_linestatus": "onehot",
                                      "l_is_discounted": "lowcard"}, True))
def q_stable_mi(spark, sf):
    li = lineitem_nulls(spark, sf).select("l_quantity", "l_tax", "l_linestatus", "l_is_discounted", "l_extendedprice")
    return A.stable_mi(li, "l_extendedprice")
