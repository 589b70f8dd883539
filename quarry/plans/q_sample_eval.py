"""Queries for sampling/splitting (G1-G10) and model evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import evaluate as V
from quarry.operators import profile as P
from quarry.operators import sample as S
from quarry.plans import registry_data as R
from quarry.plans.catalog import register, rounded
from quarry.plans.fixtures import LINEITEM_NULLS_SQL as LN, lineitem_nulls
from quarry.plans.sqlgen import numeric_profile_sql
from quarry.sources.tables import load


def hsql(*cols: str, seed: int = 42) -> str:
    parts = ", ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    return f"CAST(('0x' || substr(md5(concat_ws('|', {parts}, '{seed}')), 1, 15)) AS BIGINT)"


def _orders(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")


@register("sample_pct", f"SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice FROM orders WHERE {hsql('o_orderkey')} < {25 * 2**60 // 100}")
def q_sample_pct(spark, sf):
    return S.sample_pct(_orders(spark, sf), 25, ["o_orderkey"])


@register("stratified_sample", f"""SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {hsql('o_orderkey')}) AS rn,
  count(*) OVER (PARTITION BY o_orderstatus) AS n_c FROM orders) WHERE rn <= ceil(n_c * 0.25)""")
def q_stratified(spark, sf):
    return S.stratified_sample(_orders(spark, sf), "o_orderstatus", 25, ["o_orderkey"])


def _split_sql(test_size, strat=None, fn="ceil"):
    part = f"PARTITION BY {strat}" if strat else ""
    return f"""SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice,
  CASE WHEN rn <= {fn}(n_c * {test_size}) THEN 'test' ELSE 'train' END AS split FROM (
  SELECT *, row_number() OVER ({part} ORDER BY {hsql('o_orderkey')}) AS rn, count(*) OVER ({part}) AS n_c FROM orders)"""


@register("split_random", _split_sql(0.2))
def q_split_random(spark, sf):
    return S.split_random(_orders(spark, sf), ["o_orderkey"], 0.2)


@register("split_70_30", _split_sql(0.3))
def q_split_70_30(spark, sf):
    return S.split_random(_orders(spark, sf), ["o_orderkey"], 0.3)


@register("split_stratified", _split_sql(0.2, "o_orderstatus", "round"))
def q_split_stratified(spark, sf):
    return S.split_stratified(_orders(spark, sf), "o_orderstatus", ["o_orderkey"], 0.2)


@register("split_column", """SELECT 'Subset' AS split_column,
  CAST(count_if(lower(Subset) IN ('train', 'training')) AS BIGINT) AS train_count,
  CAST(count_if(lower(Subset) IN ('test', 'testing')) AS BIGINT) AS test_count,
  count_if(lower(Subset) IN ('train', 'training')) > 0 AND count_if(lower(Subset) IN ('test', 'testing')) > 0 AS valid
FROM (SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'Test' WHEN o_orderkey % 5 = 1 THEN 'validation' ELSE 'TRAINING' END AS Subset FROM orders)""")
def q_split_column(spark, sf):
    o = load(spark, sf, "orders")
    m = F.pmod("o_orderkey", F.lit(5))
    df = o.select("o_orderkey", F.when(m == 0, "Test").when(m == 1, "validation").otherwise("TRAINING").alias("Subset"))
    return S.split_column(df)


@register("split_sizes", """SELECT CAST(count(*) AS BIGINT) AS total_rows, CAST(floor(count(*) * 0.8) AS BIGINT) AS train_rows,
  CAST(count(*) - floor(count(*) * 0.8) AS BIGINT) AS test_rows FROM lineitem""")
def q_split_sizes(spark, sf):
    return S.split_sizes(load(spark, sf, "lineitem"))


@register("split_distribution", f"""WITH s AS ({_split_sql(0.2)}),
c AS (SELECT split, o_orderpriority AS class, count(*) AS n FROM s GROUP BY 1, 2),
z AS (SELECT split, sum(n) AS split_rows FROM c GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY n DESC, class ASC) AS rank FROM c)
SELECT r.split, CAST(z.split_rows AS BIGINT) AS split_rows, round(z.split_rows * 100.0 / (SELECT count(*) FROM orders), 6) AS split_percent,
  CAST(rank AS INTEGER) AS rank, class, CAST(n AS BIGINT) AS n FROM r JOIN z USING (split) WHERE rank <= 5""")
def q_split_distribution(spark, sf):
    s = S.split_random(_orders(spark, sf), ["o_orderkey"], 0.2)
    return rounded(S.split_distribution(s, "o_orderpriority"))


_REP_COLS = {"l_quantity": "double", "l_extendedprice": "double", "l_discount": "double"}
_SAMPLED = f"(SELECT * FROM {LN} WHERE {hsql('l_orderkey', 'l_linenumber', 'l_partkey', 'l_suppkey')} < {25 * 2**60 // 100})"


@register("representativeness", f"""WITH p AS ({numeric_profile_sql(LN, _REP_COLS)}), s AS ({numeric_profile_sql(_SAMPLED, _REP_COLS)}),
g AS (SELECT p."column", abs(s.mean - p.mean) / greatest(abs(p.std_dev), 1e-12) AS mg,
  abs(s.median - p.median) / greatest(abs(p.std_dev), 1e-12) AS dg FROM p LEFT JOIN s USING ("column"))
SELECT "column", round(mg, 6) AS mean_gap, round(dg, 6) AS median_gap, coalesce(mg <= 0.1 AND dg <= 0.1, false) AS is_representative,
  CASE WHEN mg <= 0.1 AND dg <= 0.1 THEN 'within tolerance' WHEN mg > 0.1 THEN 'mean shifted' ELSE 'median shifted' END AS reason FROM g""")
def q_representativeness(spark, sf):
    li = lineitem_nulls(spark, sf)
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    pop = rounded(P.numeric_profile(li, list(_REP_COLS)))
    smp = rounded(P.numeric_profile(S.sample_pct(li, 25, keys), list(_REP_COLS)))
    return rounded(S.representativeness(pop, smp))


# ---------------------------------------------------------------------------
# evaluation over predictions = labels x documents
# ---------------------------------------------------------------------------

PRED = R.duck(lambda e: R.predictions_sql(e))


@register("confusion_matrix", f"SELECT y_true, y_pred, CAST(count(*) AS BIGINT) AS n FROM {PRED} GROUP BY 1, 2")
def q_confusion(spark, sf):
    return V.confusion_matrix(R.predictions(spark, sf))


_PRF_SQL = f"""WITH p AS {PRED}, cm AS (SELECT y_true, y_pred, count(*) AS n FROM p GROUP BY 1, 2),
cls AS (SELECT y_true AS class FROM cm UNION SELECT y_pred FROM cm),
tp AS (SELECT y_true AS class, n AS tp FROM cm WHERE y_true = y_pred),
sup AS (SELECT y_true AS class, sum(n) AS support FROM cm GROUP BY 1),
prd AS (SELECT y_pred AS class, sum(n) AS predicted FROM cm GROUP BY 1),
j AS (SELECT class, coalesce(tp, 0) AS tp, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted
  FROM cls LEFT JOIN tp USING (class) LEFT JOIN sup USING (class) LEFT JOIN prd USING (class)),
m AS (SELECT *, CASE WHEN predicted > 0 THEN CAST(tp AS DOUBLE) / predicted ELSE 0.0 END AS prec,
  CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0.0 END AS rec FROM j),
f AS (SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END AS f1 FROM m)"""


@register("per_class_prf", _PRF_SQL + """
SELECT class, CAST(tp AS BIGINT) AS tp, CAST(predicted - tp AS BIGINT) AS fp, CAST(support - tp AS BIGINT) AS fn,
  CAST(support AS BIGINT) AS support, round(prec, 6) AS "precision", round(rec, 6) AS recall, round(f1, 6) AS f1 FROM f""")
def q_per_class(spark, sf):
    return rounded(V.per_class_prf(R.predictions(spark, sf)))


@register("macro_prf", _PRF_SQL + """
SELECT round(avg(prec), 6) AS macro_precision, round(avg(rec), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1 FROM f""")
def q_macro(spark, sf):
    return rounded(V.macro_prf(V.per_class_prf(R.predictions(spark, sf))))


@register("weighted_prf", _PRF_SQL + """
SELECT round(sum(prec * support) / sum(support), 6) AS weighted_precision, round(sum(rec * support) / sum(support), 6) AS weighted_recall,
  round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM f""")
def q_weighted(spark, sf):
    return rounded(V.weighted_prf(V.per_class_prf(R.predictions(spark, sf))))


@register("accuracy", f"SELECT round(coalesce(avg(CAST(y_true = y_pred AS DOUBLE)), 0.0), 6) AS accuracy, CAST(count(*) AS BIGINT) AS n FROM {PRED}")
def q_accuracy(spark, sf):
    return rounded(V.accuracy(R.predictions(spark, sf)))


@register("log_loss", f"""SELECT round(avg(-ln(least(greatest(CASE WHEN y_true = '1' THEN score ELSE 1 - score END, 1e-15), 1 - 1e-15))), 6)
  AS log_loss FROM {PRED}""")
def q_log_loss(spark, sf):
    p = R.predictions(spark, sf)
    p = p.withColumn("p_true", F.when(F.col("y_true") == "1", F.col("score")).otherwise(1 - F.col("score")))
    return rounded(V.log_loss(p))


@register("roc_auc", f"""WITH p AS {PRED}, pos AS (SELECT score FROM p WHERE y_true = '1'), neg AS (SELECT score FROM p WHERE y_true <> '1')
SELECT round(sum(CASE WHEN pos.score > neg.score THEN 1.0 WHEN pos.score = neg.score THEN 0.5 ELSE 0.0 END)
  / ((SELECT count(*) FROM pos) * (SELECT count(*) FROM neg)), 6) AS roc_auc FROM pos, neg""")
def q_roc_auc(spark, sf):
    return rounded(V.roc_auc(R.predictions(spark, sf)))


@register("regression_metrics", f"""SELECT round(avg(abs(y_pred_num - y_true_num)), 6) AS mae, round(avg(power(y_pred_num - y_true_num, 2)), 6) AS mse,
  round(sqrt(avg(power(y_pred_num - y_true_num, 2))), 6) AS rmse,
  round(1 - sum(power(y_pred_num - y_true_num, 2)) / sum(power(y_true_num - (SELECT avg(y_true_num) FROM {PRED}), 2)), 6) AS r2 FROM {PRED}""")
def q_regression(spark, sf):
    return rounded(V.regression_metrics(R.predictions(spark, sf), "y_true_num", "y_pred_num"))


@register("evaluation_dispatch", _PRF_SQL + """
SELECT 'accuracy' AS metric, round((SELECT avg(CAST(y_true = y_pred AS DOUBLE)) FROM p), 6) AS value
UNION ALL SELECT 'precision_macro', round(avg(prec), 6) FROM f UNION ALL SELECT 'recall_macro', round(avg(rec), 6) FROM f
UNION ALL SELECT 'f1_macro', round(avg(f1), 6) FROM f
UNION ALL SELECT 'precision_weighted', round(sum(prec * support) / sum(support), 6) FROM f
UNION ALL SELECT 'recall_weighted', round(sum(rec * support) / sum(support), 6) FROM f
UNION ALL SELECT 'f1_weighted', round(sum(f1 * support) / sum(support), 6) FROM f
UNION ALL SELECT 'roc_auc', round((SELECT sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END)
  / ((SELECT count(*) FROM p WHERE y_true = '1') * (SELECT count(*) FROM p WHERE y_true <> '1'))
  FROM p a JOIN p b ON a.y_true = '1' AND b.y_true <> '1'), 6)""")
def q_dispatch(spark, sf):
    return rounded(V.evaluation_dispatch(R.predictions(spark, sf), "binary"))


_SCORED = f"""(SELECT m.model, p.id, p.y_true,
  CASE WHEN p.y_pred_num * 3000 > m.thr THEN '1' ELSE '0' END AS y_pred,
  CASE WHEN {hsql('p.id')} % 2 = 0 THEN 'test' ELSE 'val' END AS split
  FROM {PRED} p, (SELECT 'len_1000' AS model, 1000 AS thr UNION ALL SELECT 'len_1500', 1500 UNION ALL SELECT 'len_2500', 2500) m)"""


def _scored(spark, sf):
    p = R.predictions(spark, sf)
    models = F.array(*[F.struct(F.lit(n).alias("model"), F.lit(t).alias("thr"))
                       for n, t in (("len_1000", 1000), ("len_1500", 1500), ("len_2500", 2500))])
    return (p.select("id", "y_true", "y_pred_num", F.explode(models).alias("m"))
            .select(F.col("m.model").alias("model"), "id", "y_true",
                    F.when(F.col("y_pred_num") * 3000 > F.col("m.thr"), "1").otherwise("0").alias("y_pred"),
                    F.when(F.pmod(S.hash_key(["id"]), F.lit(2)) == 0, "test").otherwise("val").alias("split")))


@register("leaderboard", f"""SELECT model, round(avg(CASE WHEN split = 'test' THEN CAST(y_true = y_pred AS DOUBLE) END), 6) AS score_test,
  round(avg(CASE WHEN split = 'val' THEN CAST(y_true = y_pred AS DOUBLE) END), 6) AS score_val,
  CAST(row_number() OVER (ORDER BY avg(CASE WHEN split = 'test' THEN CAST(y_true = y_pred AS DOUBLE) END) DESC NULLS LAST, model) AS INTEGER) AS rank
  FROM {_SCORED} GROUP BY model""")
def q_leaderboard(spark, sf):
    return rounded(V.leaderboard(_scored(spark, sf)))


EPOCHS = R.duck(lambda e: R.epochs_sql(e))


@register("weighted_avg_loss", f"""SELECT run_id, round(sum(loss * batch_size) / CAST(sum(batch_size) AS DOUBLE), 6) AS avg_loss
  FROM {EPOCHS} GROUP BY run_id""")
def q_weighted_loss(spark, sf):
    return rounded(V.weighted_avg_loss(R.epochs(spark, sf), group="run_id"))


@register("inference_speed", f"""SELECT run_id, round(CAST(sum((iteration + 1) * 37) AS DOUBLE) / sum(batch_size), 6) AS ms_per_sample,
  round(sum(batch_size) * 1000.0 / sum((iteration + 1) * 37), 6) AS samples_per_sec FROM {EPOCHS} GROUP BY run_id""")
def q_inference_speed(spark, sf):
    t = R.epochs(spark, sf).select("run_id", ((F.col("iteration") + 1) * 37).alias("elapsed_ms"), F.col("batch_size").alias("samples"))
    return rounded(V.inference_speed(t, group="run_id"))


@register("stability_pct", f"""SELECT run_id, round(coalesce(avg(CAST(accuracy IS NOT NULL AS DOUBLE)) * 100.0, 100.0), 6) AS stability_pct
  FROM {EPOCHS} GROUP BY run_id""")
def q_stability(spark, sf):
    e = R.epochs(spark, sf).withColumn("success", F.col("accuracy").isNotNull())
    return rounded(V.stability_pct(e))
