"""Queries for model fitting (J1, J3-J7, J9-J12) and permutation importance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import automl as J
from quarry.operators import evaluate as V
from quarry.operators import profile as P
from quarry.operators import sample as S
from quarry.plans import registry_data as R
from quarry.plans.catalog import register, rounded
from quarry.plans.fixtures import LINEITEM_NULLS_SQL as LN, LINEITEM_NULLS_TYPES as LT, lineitem_nulls
from quarry.plans.sqlgen import categorical_profile_sql, numeric_profile_sql
from quarry.sources.tables import load


def orders_ml(spark, sf):
    o = load(spark, sf, "orders")
    return o.select("o_orderkey", "o_totalprice", "o_orderpriority",
                    F.dayofyear("o_orderdate").cast("double").alias("o_dayofyear"), "o_orderstatus")


@register("automl_fit")
def q_automl_fit(spark, sf):
    _, board, _ = J.automl_fit(orders_ml(spark, sf), "o_orderstatus", "multiclass", families=("LR", "RF", "GBM"),
                               id_cols=["o_orderkey"])
    return board


@register("predict")
def q_predict(spark, sf):
    data = J._prep(orders_ml(spark, sf), "o_orderstatus", "multiclass")
    split = S.split_random(data, ["o_orderkey"])
    stages, _ = J.feature_pipeline(data, "o_orderstatus", "multiclass")
    from pyspark.ml import Pipeline
    model = Pipeline(stages=stages + [J.make_estimator("LR", "multiclass")]).fit(split.filter(F.col("split") == "train"))
    out = J.predict(model, split.filter(F.col("split") == "test"), proba=True)
    return out.select("o_orderkey", "prediction", "probability")


@register("bagged_stack")
def q_bagged_stack(spark, sf):
    return J.bagged_stack(orders_ml(spark, sf), "o_orderstatus", "multiclass", "o_orderkey", families=("LR", "RF", "GBM"), folds=5, iterations=5)


@register("feature_importance")
def q_feature_importance(spark, sf):
    data = J._prep(orders_ml(spark, sf), "o_orderstatus", "multiclass")
    stages, _ = J.feature_pipeline(data, "o_orderstatus", "multiclass")
    from pyspark.ml import Pipeline
    split = S.split_random(data, ["o_orderkey"])
    model = Pipeline(stages=stages + [J.make_estimator("LR", "multiclass")]).fit(split.filter(F.col("split") == "train"))
    test = split.filter(F.col("split") == "test").drop("split")

    def acc(scored):
        return scored.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]

    return J_perm(model, test, acc)


def J_perm(model, test, metric):
    return V.permutation_importance(model, test, ["o_totalprice", "o_dayofyear"], "o_orderkey", metric)


_TRAIT_COLS = [c for c in LT if c != "l_linestatus"]


@register("select_models", f"""WITH t AS (SELECT count(*) AS n_rows, {len(_TRAIT_COLS)} AS n_cols,
  ({' + '.join(f'(count(*) - count({c})) * 100.0 / count(*)' for c in _TRAIT_COLS)}) / {len(_TRAIT_COLS)} AS missing_pct,
  {sum(1 for c in _TRAIT_COLS if LT[c] == 'string')} AS n_categorical FROM {LN}),
s AS ({' UNION ALL '.join(f"SELECT '{f}' AS family, {b} + CASE WHEN {cond} THEN {bonus} ELSE 0.0 END AS score FROM t" for f, b, cond, bonus in J.FAMILY_RULES)})
SELECT family, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, family) AS rank FROM s) WHERE rank <= 3""")
def q_select_models(spark, sf):
    return rounded(J.select_models(J.frame_traits(lineitem_nulls(spark, sf), "l_linestatus")))


_HP_USER = """(SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice / 1e6 END AS learning_rate,
  CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_custkey % 128 + 1 AS INT) END AS batch_size,
  CASE WHEN o_orderkey % 5 = 0 THEN 'SGD' END AS optimizer FROM orders)"""


@register("hyperparam_merge", f"""SELECT o_orderkey, round(coalesce(learning_rate, 0.001), 9) AS learning_rate, coalesce(batch_size, 32) AS batch_size,
  coalesce(optimizer, 'Adam') AS optimizer, CAST(0.2 AS DOUBLE) AS dropout_rate, 3 AS epochs, 10 AS max_iterations, CAST(1.0 AS DOUBLE) AS target_accuracy FROM {_HP_USER}""")
def q_hyperparam_merge(spark, sf):
    o = load(spark, sf, "orders")
    m = lambda k: F.pmod("o_orderkey", F.lit(k))
    user = o.select("o_orderkey", F.when(m(3) == 0, F.col("o_totalprice") / 1e6).alias("learning_rate"),
                    F.when(m(4) == 0, (F.pmod("o_custkey", F.lit(128)) + 1).cast("int")).alias("batch_size"),
                    F.when(m(5) == 0, F.lit("SGD")).alias("optimizer"))
    out = J.hyperparam_merge(user)
    return out.select("o_orderkey", F.round("learning_rate", 9).alias("learning_rate"), "batch_size", "optimizer",
                      F.col("dropout_rate").cast("double").alias("dropout_rate"), "epochs", "max_iterations",
                      F.col("target_accuracy").cast("double").alias("target_accuracy"))


@register("hyperparam_schedule", f"""SELECT run_id, iteration, l_partkey, l_suppkey,
  CASE WHEN iteration = 0 OR coalesce(best, 0) < 0.5 THEN 'base' WHEN best < 0.8 THEN 'explore' ELSE 'refine' END AS tier FROM (
  SELECT *, max(accuracy) OVER (PARTITION BY run_id ORDER BY iteration, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best
  FROM {R.duck(lambda e: R.epochs_sql(e))})""")
def q_hyperparam_schedule(spark, sf):
    e = R.epochs(spark, sf).select("run_id", "iteration", "accuracy", "l_partkey", "l_suppkey")
    from quarry.operators.ordered import segmented_scan
    b = segmented_scan(e, ["run_id"], ["iteration", "l_partkey", "l_suppkey"], {"best": ("cummax", "accuracy")})
    s = J.hyperparam_schedule(F.col("iteration"), F.coalesce("best", F.lit(0.0)), F.col("run_id"))
    return b.select("run_id", "iteration", "l_partkey", "l_suppkey", s["tier"].alias("tier"))


_NUMC = {c: LT[c] for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")}
_CATC = {"l_returnflag": "string"}


def _advice_sql(rules):
    prof = f"""(SELECT "column", missing_percent, outlier_percent, skewness, is_constant, NULL AS high_cardinality, NULL AS lowercase_consistent
  FROM ({numeric_profile_sql(LN, _NUMC)}) UNION ALL SELECT "column", missing_percent, NULL, NULL, is_constant, high_cardinality, lowercase_consistent
  FROM ({categorical_profile_sql(LN, _CATC)}))"""
    parts = [f"SELECT \"column\", '{i}' AS issue, '{a}' AS action, '{r}' AS reason FROM {prof} WHERE coalesce({c}, false)"
             for i, c, a, r in rules]
    return "\nUNION ALL\n".join(parts)


def _profile_for_advice(spark, sf):
    li = lineitem_nulls(spark, sf)
    num = P.numeric_profile(li, list(_NUMC))
    cat = P.categorical_profile(li, list(_CATC))
    return rounded(num.unionByName(cat, allowMissingColumns=True))


@register("preprocess_recommend", _advice_sql(J.ADVICE_RULES))
def q_preprocess_recommend(spark, sf):
    return J.preprocess_recommend(_profile_for_advice(spark, sf))


_RULESETS = [J.ADVICE_RULES,
             [(i, c.replace("> 5", "> 10"), a, r) for i, c, a, r in J.ADVICE_RULES],
             [(i, c.replace("> 5", "> 1"), a if i != "outliers" else "robust_scale", r) for i, c, a, r in J.ADVICE_RULES]]


@register("vote", f"""WITH p AS ({' UNION ALL '.join(f'SELECT "column", action FROM ({_advice_sql(rs)})' for rs in _RULESETS)}),
c AS (SELECT "column", action, count(*) AS votes FROM p GROUP BY 1, 2)
SELECT "column", action, CAST(votes AS BIGINT) AS votes FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY votes DESC, action) AS r FROM c) WHERE r = 1""")
def q_vote(spark, sf):
    from quarry.session import materialize
    prof = materialize(_profile_for_advice(spark, sf), "profile")  # one row per column, reused by 3 rule sets
    plans = None
    for rs in _RULESETS:
        p = J.preprocess_recommend(prof, rs, materialized=True).select("column", "action")
        plans = p if plans is None else plans.unionByName(p)
    return J.vote(plans)


_PLAN = [("l_quantity", "impute_median"), ("l_discount", "impute_median"), ("l_extendedprice", "clip_iqr"), ("l_returnflag", "lowercase")]


@register("apply_recommendations", f"""WITH q AS (SELECT quantile_cont(l_quantity, 0.5) AS mq, quantile_cont(l_discount, 0.5) AS md,
  quantile_cont(l_extendedprice, 0.25) AS e1, quantile_cont(l_extendedprice, 0.75) AS e3 FROM {LN})
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(coalesce(l_quantity, mq), 6) AS l_quantity, round(coalesce(l_discount, md), 6) AS l_discount,
  round(least(greatest(l_extendedprice, e1 - 1.5 * (e3 - e1)), e3 + 1.5 * (e3 - e1)), 6) AS l_extendedprice, lower(l_returnflag) AS l_returnflag FROM {LN}, q""")
def q_apply(spark, sf):
    li = lineitem_nulls(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount",
                                          "l_extendedprice", "l_returnflag")
    return rounded(J.apply_recommendations(li, _PLAN))


@register("end_to_end")
def q_end_to_end(spark, sf, sample_pct: float | None = None):
    """J12 over the whole table of orders."""
    return J.end_to_end(orders_ml(spark, sf), "o_orderstatus", "o_orderkey", sample_pct=sample_pct)


@register("benchmark_loop", """SELECT o_orderpriority AS dataset, 'LR' AS model, CAST(count(*) AS BIGINT) AS n_rows, 'completed' AS status, true AS scored
FROM orders GROUP BY o_orderpriority""")
def q_benchmark_loop(spark, sf):
    """K7: the whole pipeline on the orders of each priority."""
    o = orders_ml(spark, sf).withColumnRenamed("o_orderpriority", "dataset")
    board = J.benchmark_loop(o, "dataset", lambda rows: J.end_to_end(rows, "o_orderstatus", "o_orderkey", families=["LR"]))
    sizes = o.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_rows"))
    return board.join(sizes, "dataset").select("dataset", "model", "n_rows", "status", F.col("score_test").between(0, 1).alias("scored"))
