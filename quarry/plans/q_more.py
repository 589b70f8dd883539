"""Queries for the complete profile (C13), the extension surface, and parts of B7, B13, F7, H13, I7, L17, L18, L21, M8 and M18."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import checks as H
from quarry.operators import encode as E
from quarry.operators import evaluate as V
from quarry.operators import extend as X
from quarry.operators import profile as P
from quarry.operators import registry as G
from quarry.operators import telemetry as M
from quarry.plans import registry_data as R
from quarry.plans.catalog import register, rounded
from quarry.plans.fixtures import LINEITEM_NULLS_SQL as LN, lineitem_nulls
from quarry.plans.q_registry import DS, MODELS, PROG, RUNS, _STATE_SQL
from quarry.plans.sqlgen import categorical_profile_sql, numeric_profile_sql, pearson_sql, q, r6, stable_mi_sql
from quarry.sources.tables import load

# --------------------------------------------------------------------------- C13
_CP = "(SELECT o_orderkey, o_custkey % 1000 AS o_bucket, o_totalprice, o_orderpriority, o_orderstatus FROM orders)"
_CP_NUM = {"o_orderkey": "bigint", "o_bucket": "bigint", "o_totalprice": "double"}
_NUM_METRICS = ["mean", "std_dev", "median", "q1", "q3", "skewness", "kurtosis", "missing_percent", "zero_percent", "outlier_percent"]
_CAT_METRICS = ["entropy", "missing_percent", "avg_str_length"]


def _melt_sql(section: str, sql: str, metrics: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{section}' AS section, {q('column')} AS name, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM ({sql})" for m in metrics)


def _complete_sql() -> str:
    classes = f"SELECT o_orderstatus AS v, count(*) AS n FROM {_CP} WHERE o_orderstatus IS NOT NULL GROUP BY 1"
    return f"""SELECT * FROM ({_melt_sql('features', numeric_profile_sql(_CP, _CP_NUM), _NUM_METRICS)}
UNION ALL {_melt_sql('features', categorical_profile_sql(_CP, {'o_orderpriority': 'string'}), _CAT_METRICS)}
UNION ALL SELECT 'target', 'o_orderstatus', 'num_classes', CAST((SELECT count(*) FROM ({classes})) AS DOUBLE)
UNION ALL SELECT 'target', 'o_orderstatus', 'entropy', {r6(f'(SELECT -sum((n / t) * log2(n / t)) FROM (SELECT CAST(n AS DOUBLE) AS n, sum(n) OVER () AS t FROM ({classes})))')}
UNION ALL SELECT 'correlation', col_a || '|' || col_b, 'corr', corr FROM ({pearson_sql(_CP, list(_CP_NUM))})
UNION ALL SELECT 'mutual_information', feature, 'avg_mi', avg_mi FROM ({stable_mi_sql(_CP, 'o_orderstatus', {c: 'numeric' for c in _CP_NUM} | {'o_orderpriority': 'onehot'}, False)})) WHERE value IS NOT NULL"""


@register("complete_profile", _complete_sql())
def q_complete_profile(spark, sf):
    """Features, target, correlation and mutual information of one table, as one long report."""
    o = load(spark, sf, "orders").select("o_orderkey", F.pmod("o_custkey", F.lit(1000)).alias("o_bucket"), "o_totalprice", "o_orderpriority", "o_orderstatus")
    report = P.complete_profile(o, "o_orderstatus")

    def melt(section: str, df: DataFrame, name, metrics: list[str]) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics if m in df.columns])
        return df.select(F.lit(section).alias("section"), name.alias("name"), F.explode(pairs).alias("p")).select("section", "name", "p.*")

    parts = [melt("features", report["features"], F.col("column"), sorted({*_NUM_METRICS, *_CAT_METRICS})),
             melt("target", report["target"], F.col("column"), ["num_classes", "entropy"]),
             melt("correlation", report["correlation"], F.concat_ws("|", "col_a", "col_b"), ["corr"]),
             melt("mutual_information", report["mutual_information"], F.col("feature"), ["avg_mi"])]
    return rounded(reduce(DataFrame.unionByName, parts).where(F.col("value").isNotNull()))


# --------------------------------------------------------------------------- extension surface
_METRICS = [X.Metric("range", lambda c: F.max(c.cast("double")) - F.min(c.cast("double"))),
            X.Metric("positive_share", lambda c: F.avg((c > 0).cast("double"))),
            X.Metric("longest", lambda c: F.max(F.char_length(c)), ("categorical",))]


@register("extra_metrics", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", 'range' AS metric, round(CAST(max({c}) AS DOUBLE) - CAST(min({c}) AS DOUBLE), 6) AS value FROM {LN}
UNION ALL SELECT '{c}', 'positive_share', {r6(f'avg(CAST({c} > 0 AS DOUBLE))')} FROM {LN}""" for c in ("l_quantity", "l_tax"))
    + f""" UNION ALL SELECT 'l_returnflag', 'longest', CAST(max(length(l_returnflag)) AS DOUBLE) FROM {LN}""")
def q_extra_metrics(spark, sf):
    """Profile metrics that a caller adds as Column expressions."""
    return rounded(X.metric_profile(lineitem_nulls(spark, sf), ["l_quantity", "l_tax", "l_returnflag"], _METRICS))


# --------------------------------------------------------------------------- B7, B13, F7, H13
@register("lift_config", f"""SELECT id AS run, status AS state, CAST(total_epochs AS VARCHAR) AS epochs,
  CASE WHEN current_epoch > 0 THEN CAST(current_epoch * 8 AS VARCHAR) END AS batch_size FROM {RUNS}""")
def q_lift_config(spark, sf):
    """Renamed columns, and fields of a run's JSON configuration."""
    config = F.to_json(F.struct(F.col("total_epochs").alias("epochs"), F.struct(F.when(F.col("current_epoch") > 0, F.col("current_epoch") * 8).alias("batch_size")).alias("hyperparameters")))
    runs = R.runs(spark, sf).withColumn("config", config)
    return G.rename_project(runs, {"id": "run", "status": "state"}, {"epochs": "config.epochs", "batch_size": "config.hyperparameters.batch_size"})


@register("column_set_compare", """SELECT 'orders' AS a, 'lineitem' AS b, count(*) AS n_rows, false AS equal, false AS same_set, 6 AS n_only_in_a, 11 AS n_only_in_b FROM orders""")
def q_column_set_compare(spark, sf):
    """Whether two tables have the same columns in the same order, beside the rows of the first."""
    a, b = load(spark, sf, "orders"), load(spark, sf, "lineitem")
    r = H.column_set_compare(a.columns, b.columns)
    return a.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit("orders").alias("a"), F.lit("lineitem").alias("b"), "n_rows", F.lit(r["equal"]).alias("equal"), F.lit(r["same_set"]).alias("same_set"),
        F.lit(len(r["only_in_a"])).alias("n_only_in_a"), F.lit(len(r["only_in_b"])).alias("n_only_in_b"))


@register("drop_pii", "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def q_drop_pii(spark, sf):
    return E.drop_pii(load(spark, sf, "customer"))


@register("guess_target", """SELECT 'label' AS target, CAST(quality AS INTEGER) AS label, CAST(count(*) AS BIGINT) AS n FROM labels GROUP BY quality""")
def q_guess_target(spark, sf):
    """The column that a table's names suggest as the target, and its values."""
    df = load(spark, sf, "labels").select("doc_id", F.col("quality").cast("int").alias("label"), "toxic")
    target = H.guess_target_column(df.columns)
    return df.groupBy(F.col(target).alias("label")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(target).alias("target"), "label", "n")


# --------------------------------------------------------------------------- F10
@register("dictionary_codes", "SELECT o_custkey AS key, CAST(dense_rank() OVER (ORDER BY CAST(o_custkey AS VARCHAR)) - 1 AS INTEGER) AS code, o_orderkey FROM orders")
def q_dictionary_codes(spark, sf):
    """F10 on a column of many values: dense codes by rank, with no list of values on the driver."""
    o = load(spark, sf, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey")
    return E.target_encode_label(o, "key", "code")


# --------------------------------------------------------------------------- I7
_OVR = """(SELECT o_orderkey AS id, o_orderstatus AS y_true, c AS "class", CASE c WHEN 'F' THEN (o_custkey * 7) % 101 + CASE WHEN o_orderstatus = 'F' THEN 20 ELSE 0 END
  WHEN 'O' THEN (o_orderkey * 13) % 97 ELSE o_custkey % 50 END AS score FROM orders, (VALUES ('F'), ('O'), ('P')) v(c))"""


@register("roc_auc_weighted", f"""WITH g AS (SELECT "class", score, count_if(y_true = "class") AS pos, count_if(y_true <> "class") AS neg FROM {_OVR} GROUP BY ALL),
r AS (SELECT *, sum(neg) OVER (PARTITION BY "class" ORDER BY score) - neg AS below FROM g),
a AS (SELECT "class", sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)) AS auc, sum(pos) AS p FROM r GROUP BY "class")
SELECT round(sum(auc * p) / sum(p), 6) AS roc_auc_weighted FROM a WHERE p > 0""")
def q_roc_auc_weighted(spark, sf):
    o, hit = load(spark, sf, "orders"), F.when(F.col("o_orderstatus") == "F", 20).otherwise(0)
    by_class = {"F": F.pmod(F.col("o_custkey") * 7, F.lit(101)) + hit, "O": F.pmod(F.col("o_orderkey") * 13, F.lit(97)), "P": F.pmod(F.col("o_custkey"), F.lit(50))}
    pairs = F.array(*[F.struct(F.lit(c).alias("class"), s.cast("double").alias("score")) for c, s in by_class.items()])
    scores = o.select(F.col("o_orderstatus").alias("y_true"), F.explode(pairs).alias("p")).select("y_true", "p.*")
    return rounded(V.roc_auc_weighted(scores))


# --------------------------------------------------------------------------- L17, L18, L21
@register("migrate_datasets", f"""SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, lower(CASE WHEN c_nationkey % 2 = 0 THEN 'Vision' ELSE 'tabular' END) AS domain,
  CASE WHEN c_custkey % 3 = 0 THEN 'draft' ELSE 'ready' END AS readiness, '/old/' || CAST(c_custkey AS VARCHAR) AS file_path, CAST(c_custkey % 500 AS INTEGER) AS total_samples FROM customer""")
def q_migrate_datasets(spark, sf):
    c = load(spark, sf, "customer")
    raw = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.pmod("c_nationkey", F.lit(2)) == 0, "Vision").alias("domain"),
                   F.when(F.pmod("c_custkey", F.lit(3)) != 0, "ready").alias("status"),
                   F.concat(F.lit("/old/"), F.col("c_custkey").cast("string")).alias("path"), F.pmod("c_custkey", F.lit(500)).alias("size"))
    return G.migrate_datasets(raw)


@register("migrate_jobs", f"""SELECT CAST(o.o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'training' ELSE 'automl' END AS job_type,
  CASE WHEN o_orderkey % 5 = 0 THEN 'pending' ELSE 'running' END AS status, m.id AS model_id
FROM orders o LEFT JOIN {MODELS} m ON m.id = 'm_' || CAST(o.o_custkey AS VARCHAR)""")
def q_migrate_jobs(spark, sf):
    o = load(spark, sf, "orders")
    raw = o.select(F.col("o_orderkey").alias("id"), F.when(F.pmod("o_orderkey", F.lit(4)) != 0, "automl").alias("job_type"),
                   F.when(F.pmod("o_orderkey", F.lit(5)) != 0, "running").alias("status"), F.concat(F.lit("m_"), F.col("o_custkey").cast("string")).alias("model_id"))
    return G.migrate_jobs(raw, R.models(spark, sf))


@register("add_metric_columns", f"SELECT id, status, CAST(NULL AS DOUBLE) AS auc, CAST(NULL AS INTEGER) AS best_epoch FROM {RUNS}")
def q_add_metric_columns(spark, sf):
    return G.add_metric_columns(R.runs(spark, sf).select("id", "status"), {"auc": "double", "best_epoch": "int", "status": "string"})


@register("dataset_tasks", f"""SELECT id, coalesce(file_size, 0) AS size, CASE WHEN domain = 'vision' THEN 'classification' || CASE WHEN has_annotations THEN ',detection' ELSE '' END
  ELSE 'classification,regression' END AS tasks FROM {DS}""")
def q_dataset_tasks(spark, sf):
    """L21 with the tasks a dataset supports."""
    tasks = F.when(F.col("domain") == "vision", F.array_compact(F.array(F.lit("classification"), F.when(F.col("has_annotations"), "detection"))))
    out = G.dataset_record(R.datasets(spark, sf), tasks.otherwise(F.array(F.lit("classification"), F.lit("regression"))))
    return out.select("id", "size", F.array_join("tasks", ",").alias("tasks"))


# --------------------------------------------------------------------------- M8, M18
@register("append_epoch_hyperparameters", f"""SELECT run_id, array_to_string(list(CAST(batch_size AS VARCHAR) ORDER BY iteration, accuracy NULLS FIRST, loss, "precision", recall, f1_score, ts, batch_size), ',') AS batch_sizes
FROM {R.duck(lambda e: R.epochs_sql(e))} GROUP BY run_id""")
def q_append_epoch_hyperparameters(spark, sf):
    """M8: what each iteration ran with stays beside its metrics."""
    e = R.epochs(spark, sf).withColumn("hyperparameters", F.struct("batch_size"))
    return M.append_epoch(e).select("run_id", F.array_join(F.transform("epoch_metrics", lambda s: s["hyperparameters"]["batch_size"].cast("string")), ",").alias("batch_sizes"))


@register("failure_texts", f"""WITH f AS (SELECT job_id, min(CASE WHEN status = 'failed' THEN stage END) AS failed_stage, CAST(count_if(status = 'completed') AS BIGINT) AS completed_stages
  FROM {_STATE_SQL} GROUP BY job_id), t AS (SELECT job_id, stage, arg_max('event ' || CAST(event_id AS VARCHAR) || ' failed', (ts, event_id)) AS error_message FROM {PROG} WHERE event = 'error' GROUP BY job_id, stage)
SELECT f.job_id, f.failed_stage, f.completed_stages, t.error_message FROM f LEFT JOIN t ON t.job_id = f.job_id AND t.stage = f.failed_stage WHERE f.failed_stage IS NOT NULL""")
def q_failure_texts(spark, sf):
    """M18 with the text of the error."""
    ev = R.progress(spark, sf).withColumn("message", F.concat(F.lit("event "), F.col("event_id").cast("string"), F.lit(" failed")))
    return M.failure_summary(ev, message="message")
