"""Queries for registry (B, L), benchmarking (K), telemetry (M) and scalar functions (N)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import scalar as N
from quarry.operators import constraints as CON
from quarry.operators import registry as G
from quarry.operators import scores as K
from quarry.operators import telemetry as M
from quarry.plans import registry_data as R
from quarry.plans.catalog import register, rounded
from quarry.plans.q_checks import metrics_map
from quarry.sources.tables import load

DS, MODELS, RUNS, JOBS = (R.duck(lambda e: R.datasets_sql(e)), R.duck(lambda e: R.models_sql(e)),
                          R.duck(lambda e: R.runs_sql(e)), R.duck(lambda e: R.jobs_sql(e)))
EPOCHS, PROG, LOGS, SCORES = (R.duck(lambda e: R.epochs_sql(e)), R.duck(lambda e: R.progress_sql(e)),
                              R.duck(lambda e: R.logs_sql(e)), R.duck(lambda e: R.scores_sql(e)))
NOW_SQL = "TIMESTAMP '2025-01-01 00:00:00'"


def now_col():
    return F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")


# --------------------------------------------------------------------------- B
@register("list_datasets", f"SELECT id, name, created_at FROM {DS} WHERE domain = 'tabular' AND readiness = 'ready' AND name ILIKE '%price%'")
def q_list_datasets(spark, sf):
    return G.list_filtered(R.datasets(spark, sf), {"domain": "tabular", "readiness": "ready"}, "PRICE").select("id", "name", "created_at")


@register("list_models", f"SELECT id, name, created_at FROM {MODELS} WHERE task = 'classification' AND status = 'ready' AND name ILIKE '%green%'")
def q_list_models(spark, sf):
    return G.list_filtered(R.models(spark, sf), {"task": "classification", "status": "ready"}, "Green").select("id", "name", "created_at")


@register("list_jobs", f"SELECT id, status, created_at FROM {JOBS} WHERE status = 'pending'")
def q_list_jobs(spark, sf):
    return G.list_filtered(R.jobs(spark, sf), {"status": "pending"}).select("id", "status", "created_at")


@register("list_runs", f"SELECT id, model_id, created_at FROM {RUNS} WHERE model_id = 'm_7'")
def q_list_runs(spark, sf):
    return G.list_filtered(R.runs(spark, sf), {"model_id": "m_7"}).select("id", "model_id", "created_at")


@register("get_by_id", f"SELECT id, name, domain, readiness FROM {DS} WHERE id = 'ds_42'")
def q_get_by_id(spark, sf):
    return G.get_by_id(R.datasets(spark, sf), "ds_42").select("id", "name", "domain", "readiness")


@register("tag_search", f"SELECT id, tags_csv FROM {DS} WHERE list_contains(split(tags_csv, ','), 'regression')")
def q_tag_search(spark, sf):
    ds = R.datasets(spark, sf).withColumn("tags", F.split("tags_csv", ","))
    return G.tag_search(ds, "regression").select("id", "tags_csv")


@register("rename_project", f"SELECT id, file_path AS path, total_samples AS size, domain FROM {DS}")
def q_rename(spark, sf):
    return R.datasets(spark, sf).select("id", F.col("file_path").alias("path"), F.col("total_samples").alias("size"), "domain")


@register("coalesce_defaults", f"""SELECT id, coalesce(file_size, 0) AS size, coalesce(file_path, '') AS path,
  coalesce(tags_csv, '') AS tags FROM {DS}""")
def q_coalesce_defaults(spark, sf):
    ds = R.datasets(spark, sf).withColumn("tags", F.split("tags_csv", ",")).select("id", "file_size", "file_path", "tags")
    out = G.coalesce_defaults(ds)
    return out.select("id", "size", "path", F.array_join("tags", ",").alias("tags"))


@register("recent_activity", f"""SELECT * FROM (SELECT * FROM (SELECT 'dataset' AS kind, id, name, created_at FROM {DS} ORDER BY created_at DESC, id LIMIT 3)
  UNION ALL SELECT * FROM (SELECT 'model', id, name, created_at FROM {MODELS} ORDER BY created_at DESC, id LIMIT 3))
  ORDER BY created_at DESC, kind, id LIMIT 5""")
def q_recent(spark, sf):
    return G.recent_activity(R.datasets(spark, sf), R.models(spark, sf))


@register("class_set_compare", """WITH a AS (SELECT DISTINCT p_size AS class FROM part WHERE p_brand = 'Brand#11'),
b AS (SELECT DISTINCT p_size AS class FROM part WHERE p_brand = 'Brand#12')
SELECT coalesce(a.class, b.class) AS class, a.class IS NOT NULL AS in_a, b.class IS NOT NULL AS in_b FROM a FULL JOIN b ON a.class = b.class""")
def q_class_set(spark, sf):
    pa = load(spark, sf, "part")
    return G.class_set_compare(pa.filter(F.col("p_brand") == "Brand#11"), pa.filter(F.col("p_brand") == "Brand#12"), "p_size")


@register("distinct_ids", """SELECT DISTINCT TRY_CAST(CASE WHEN event_id % 9 = 0 THEN 'bad' || CAST(user_id AS VARCHAR) ELSE CAST(user_id AS VARCHAR) END AS BIGINT) AS id
  FROM events WHERE TRY_CAST(CASE WHEN event_id % 9 = 0 THEN 'bad' ELSE CAST(user_id AS VARCHAR) END AS BIGINT) IS NOT NULL""")
def q_distinct_ids(spark, sf):
    ev = load(spark, sf, "events")
    txt = F.when(F.pmod("event_id", F.lit(9)) == 0, F.concat(F.lit("bad"), F.col("user_id").cast("string"))).otherwise(
        F.col("user_id").cast("string"))
    return G.distinct_ids(ev.select(txt.alias("task_id_text")), "task_id_text")


# --------------------------------------------------------------------------- L
@register("active_runs", f"""SELECT r.id, r.status, r.model_id, m.name AS model_name, m.task, r.dataset_id, d.name AS dataset_name
  FROM {RUNS} r JOIN {MODELS} m ON r.model_id = m.id LEFT JOIN {DS} d ON r.dataset_id = d.id WHERE r.status IN ('running', 'queued')""")
def q_active_runs(spark, sf):
    return G.active_runs(R.runs(spark, sf), R.models(spark, sf), R.datasets(spark, sf)).select(
        "id", "status", "model_id", "model_name", "task", "dataset_id", "dataset_name")


@register("model_statistics", f"""SELECT m.id, m.name, m.task, m.framework, m.status, CAST(count(r.id) AS BIGINT) AS total_runs,
  CAST(count(CASE WHEN r.status = 'completed' THEN 1 END) AS BIGINT) AS successful_runs,
  CAST(count(CASE WHEN r.status = 'failed' THEN 1 END) AS BIGINT) AS failed_runs,
  max(r.final_accuracy) AS best_accuracy, min(r.final_loss) AS best_loss
  FROM {MODELS} m LEFT JOIN {RUNS} r ON m.id = r.model_id GROUP BY m.id, m.name, m.task, m.framework, m.status""")
def q_model_stats(spark, sf):
    return G.model_statistics(R.models(spark, sf), R.runs(spark, sf))


@register("next_run_number", f"""SELECT id, model_id, CAST(row_number() OVER (PARTITION BY model_id ORDER BY created_at, id) AS INTEGER) AS run_number
  FROM {RUNS}""")
def q_next_run_number(spark, sf):
    return G.next_run_number(R.runs(spark, sf).select("id", "model_id", "created_at")).select("id", "model_id", "run_number")


@register("training_history", f"""SELECT id, model_id, status, created_at, coalesce(CAST(duration_seconds AS BIGINT),
  CAST(epoch(completed_at) - epoch(started_at) AS BIGINT),
  CASE WHEN status IN ('running', 'pending') THEN CAST(epoch({NOW_SQL}) - epoch(started_at) AS BIGINT) END) AS duration FROM {RUNS}""")
def q_training_history(spark, sf):
    return G.training_history(R.runs(spark, sf), now_col())


@register("latest_run_per_model", f"""SELECT model_id, id, status, created_at FROM (SELECT model_id, id, status, created_at,
  row_number() OVER (PARTITION BY model_id ORDER BY created_at DESC, id DESC) AS rn FROM {RUNS}) WHERE rn = 1""")
def q_latest_run(spark, sf):
    return G.latest_per_key(R.runs(spark, sf).select("model_id", "id", "status", "created_at"), "model_id")


@register("latest_job_per_model", f"""SELECT model_id, id, status, created_at FROM (SELECT model_id, id, status, created_at,
  row_number() OVER (PARTITION BY model_id ORDER BY created_at DESC, id DESC) AS rn FROM {JOBS}) WHERE rn = 1""")
def q_latest_job(spark, sf):
    return G.latest_per_key(R.jobs(spark, sf).select("model_id", "id", "status", "created_at"), "model_id")


@register("dashboard_counts", f"""SELECT (SELECT CAST(count_if(readiness = 'ready') AS BIGINT) FROM {DS}) AS ready_datasets,
  (SELECT CAST(count(*) AS BIGINT) FROM {MODELS}) AS total_models,
  (SELECT CAST(count_if(status IN ('training', 'queued')) AS BIGINT) FROM {MODELS}) AS training_models""")
def q_dashboard(spark, sf):
    return G.dashboard_counts(R.datasets(spark, sf), R.models(spark, sf))


_STATE_SQL = f"""(SELECT job_id, stage, CASE arg_max(event, (ts, event_id)) WHEN 'start' THEN 'running' WHEN 'complete' THEN 'completed'
  ELSE 'failed' END AS status FROM {PROG} GROUP BY job_id, stage)"""


@register("stage_state", f"SELECT * FROM {_STATE_SQL}")
def q_stage_state(spark, sf):
    return M.stage_state(R.progress(spark, sf))


_STAGE_NAMES = ["Type Conversion", "Data Sampling", "Profile Generation (Sampled)", "Preprocessing Insights Generation",
                "Preprocessing Code Execution", "Profile Generation (Preprocessed)", "Model Recommendation", "Model Training"]


@register("stage_template_merge", f"""WITH t AS (SELECT * FROM (VALUES {', '.join(f"({i + 1}, '{n}')" for i, n in enumerate(_STAGE_NAMES))}) v(stage, name)),
j AS (SELECT DISTINCT job_id FROM {PROG})
SELECT j.job_id, CAST(t.stage AS INTEGER) AS stage, t.name, coalesce(s.status, 'pending') AS status
FROM j CROSS JOIN t LEFT JOIN {_STATE_SQL} s ON s.job_id = j.job_id AND s.stage = t.stage""")
def q_stage_template(spark, sf):
    return G.stage_template_merge(R.progress(spark, sf))


@register("job_model_summary", f"""SELECT j.id, j.job_type, j.status, j.model_id, j.created_at, m.status AS model_status
  FROM {JOBS} j LEFT JOIN {MODELS} m ON j.model_id = m.id""")
def q_job_model(spark, sf):
    return G.job_model_summary(R.jobs(spark, sf), R.models(spark, sf))


@register("waiting_jobs", f"SELECT count(*) FILTER (WHERE status IN ('queued', 'pending')) AS waiting_jobs FROM {JOBS}")
def q_waiting_jobs(spark, sf):
    return G.waiting_jobs(R.jobs(spark, sf))


@register("pending_job_triage", f"""SELECT j.id, j.status, j.attempts, CASE WHEN j.attempts >= j.max_attempts THEN 'fail'
  WHEN d.id IS NULL THEN 'skip_missing_dataset' WHEN j.job_type = 'automl' AND j.dataset_path IS NULL THEN 'skip_no_path' ELSE 'submit' END AS decision,
  CASE WHEN NOT (j.attempts >= j.max_attempts) AND d.id IS NOT NULL AND NOT (j.job_type = 'automl' AND j.dataset_path IS NULL)
    THEN j.attempts + 1 ELSE j.attempts END AS attempts_after
  FROM {JOBS} j LEFT JOIN {DS} d ON j.dataset_id = d.id WHERE j.status IN ('pending', 'queued')""")
def q_triage(spark, sf):
    return G.pending_job_triage(R.jobs(spark, sf), R.datasets(spark, sf))


@register("cascade_delete", f"""SELECT r.id, r.model_id FROM {RUNS} r WHERE r.model_id NOT IN (SELECT id FROM {MODELS} WHERE status = 'failed')""")
def q_cascade(spark, sf):
    mo = R.models(spark, sf)
    runs_left, _ = G.cascade_delete_model(mo.filter(F.col("status") == "failed"), R.runs(spark, sf), R.jobs(spark, sf))
    return runs_left.select("id", "model_id")


RUN_LOGS = R.duck(lambda e: R.training_logs_sql(e))
VERSIONS = R.duck(lambda e: R.versions_sql(e))


def _registry(spark, sf):
    return {"datasets": R.datasets(spark, sf), "models": R.models(spark, sf), "training_runs": R.runs(spark, sf),
            "training_logs": R.training_logs(spark, sf), "model_versions": R.versions(spark, sf), "jobs": R.jobs(spark, sf)}


@register("cascade_graph", f"""WITH dd AS (SELECT id FROM {DS} WHERE readiness = 'error'), dm AS (SELECT id FROM {MODELS} WHERE status = 'failed'),
dr AS (SELECT id FROM {RUNS} WHERE model_id IN (SELECT id FROM dm))
SELECT 'datasets' AS "table", id, NULL AS model_id, NULL AS dataset_id, NULL AS training_run_id FROM {DS} WHERE id NOT IN (SELECT id FROM dd)
UNION ALL SELECT 'models', id, NULL, CASE WHEN dataset_id NOT IN (SELECT id FROM dd) THEN dataset_id END, NULL FROM {MODELS} WHERE id NOT IN (SELECT id FROM dm)
UNION ALL SELECT 'training_runs', id, model_id, CASE WHEN dataset_id NOT IN (SELECT id FROM dd) THEN dataset_id END, NULL FROM {RUNS} WHERE id NOT IN (SELECT id FROM dr)
UNION ALL SELECT 'training_logs', id, NULL, NULL, training_run_id FROM {RUN_LOGS} WHERE training_run_id NOT IN (SELECT id FROM dr)
UNION ALL SELECT 'model_versions', id, model_id, NULL, CASE WHEN training_run_id NOT IN (SELECT id FROM dr) THEN training_run_id END FROM {VERSIONS}
  WHERE model_id NOT IN (SELECT id FROM dm)
UNION ALL SELECT 'jobs', id, model_id, dataset_id, NULL FROM {JOBS} WHERE model_id NOT IN (SELECT id FROM dm) AND dataset_id NOT IN (SELECT id FROM dd)""")
def q_cascade_graph(spark, sf):
    """What failed models and broken datasets leave of all six tables, keys as they are afterwards."""
    t = _registry(spark, sf)
    left = CON.delete(t, {"datasets": t["datasets"].filter(F.col("readiness") == "error"), "models": t["models"].filter(F.col("status") == "failed")})
    refs = ["model_id", "dataset_id", "training_run_id"]
    parts = [df.select(F.lit(name).alias("table"), "id", *[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in refs]) for name, df in left.items()]
    return reduce(DataFrame.unionByName, parts)


@register("registry_constraints", f"""SELECT 'datasets' AS "table", 'domain' AS rule, id FROM {DS} WHERE domain NOT IN ('vision', 'tabular')
UNION ALL SELECT 'datasets', 'readiness', id FROM {DS} WHERE readiness NOT IN ('draft', 'processing', 'ready', 'failed')
UNION ALL SELECT 'datasets', 'total_samples', id FROM {DS} WHERE total_samples < 0
UNION ALL SELECT 'datasets', 'file_size', id FROM {DS} WHERE file_size <= 0
UNION ALL SELECT 'models', 'task', id FROM {MODELS} WHERE task NOT IN ('classification', 'regression', 'clustering', 'detection', 'unknown')
UNION ALL SELECT 'models', 'framework', id FROM {MODELS} WHERE framework NOT IN ('pytorch', 'tensorflow', 'sklearn')
UNION ALL SELECT 'models', 'status', id FROM {MODELS} WHERE status NOT IN ('draft', 'queued', 'training', 'ready', 'active', 'failed')
UNION ALL SELECT 'models', 'accuracy', id FROM {MODELS} WHERE accuracy < 0 OR accuracy > 100
UNION ALL SELECT 'models', 'fk_dataset', id FROM {MODELS} WHERE dataset_id NOT IN (SELECT id FROM {DS})
UNION ALL SELECT 'training_runs', 'status', id FROM {RUNS} WHERE status NOT IN ('pending', 'queued', 'running', 'completed', 'failed', 'stopped')
UNION ALL SELECT 'training_runs', 'epochs', id FROM {RUNS} WHERE current_epoch < 0 OR current_epoch > total_epochs
UNION ALL SELECT 'training_runs', 'fk_model', id FROM {RUNS} WHERE model_id NOT IN (SELECT id FROM {MODELS})
UNION ALL SELECT 'training_runs', 'fk_dataset', id FROM {RUNS} WHERE dataset_id NOT IN (SELECT id FROM {DS})
UNION ALL SELECT 'training_logs', 'log_level', id FROM {RUN_LOGS} WHERE log_level NOT IN ('DEBUG', 'INFO', 'WARNING', 'ERROR', 'CRITICAL')
UNION ALL SELECT 'training_logs', 'fk_run', id FROM {RUN_LOGS} WHERE training_run_id NOT IN (SELECT id FROM {RUNS})
UNION ALL SELECT 'model_versions', 'unique_model_version', id FROM (SELECT id, count(*) OVER (PARTITION BY model_id, version) AS n FROM {VERSIONS}) WHERE n > 1
UNION ALL SELECT 'model_versions', 'fk_model', id FROM {VERSIONS} WHERE model_id NOT IN (SELECT id FROM {MODELS})
UNION ALL SELECT 'model_versions', 'fk_run', id FROM {VERSIONS} WHERE training_run_id NOT IN (SELECT id FROM {RUNS})
UNION ALL SELECT 'jobs', 'status', id FROM {JOBS} WHERE status NOT IN ('pending', 'running', 'completed', 'failed')
UNION ALL SELECT 'jobs', 'fk_model', id FROM {JOBS} WHERE model_id NOT IN (SELECT id FROM {MODELS})
UNION ALL SELECT 'jobs', 'fk_dataset', id FROM {JOBS} WHERE dataset_id NOT IN (SELECT id FROM {DS})""")
def q_registry_constraints(spark, sf):
    """Every CHECK, UNIQUE and foreign key of all six tables."""
    return CON.violations(_registry(spark, sf))


@register("upsert", f"""SELECT j.id, coalesce(u.status, j.status) AS status, j.attempts FROM {JOBS} j LEFT JOIN
  (SELECT id, CASE WHEN attempts >= max_attempts THEN 'failed' END AS status FROM {JOBS} WHERE status = 'pending') u ON j.id = u.id""")
def q_upsert(spark, sf):
    jb = R.jobs(spark, sf)
    upd = jb.filter(F.col("status") == "pending").select(
        "id", F.when(F.col("attempts") >= F.col("max_attempts"), F.lit("failed")).alias("status"))
    return G.upsert(jb.select("id", "status", "attempts"), upd)


@register("migrate_models", f"""WITH raw AS (SELECT 'legacy_' || CAST(o_orderkey AS VARCHAR) AS id,
  CASE WHEN o_orderkey % 4 = 0 THEN 'unknown set' ELSE (SELECT name FROM {DS} d WHERE d.id = 'ds_' || CAST(o_custkey AS VARCHAR)) END AS dataset_name FROM orders),
d AS (SELECT name AS dataset_name, min(id) AS dataset_id FROM {DS} GROUP BY name)
SELECT raw.id, raw.dataset_name, d.dataset_id FROM raw LEFT JOIN d USING (dataset_name)""")
def q_migrate(spark, sf):
    o = load(spark, sf, "orders")
    ds = R.datasets(spark, sf)
    raw = (o.join(ds.select(F.col("id").alias("_ds"), F.col("name").alias("_n")),
                  F.concat(F.lit("ds_"), F.col("o_custkey").cast("string")) == F.col("_ds"), "left")
           .select(F.concat(F.lit("legacy_"), F.col("o_orderkey").cast("string")).alias("id"),
                   F.when(F.pmod("o_orderkey", F.lit(4)) == 0, F.lit("unknown set")).otherwise(F.col("_n")).alias("dataset_name")))
    return G.migrate_models(raw, ds).select("id", "dataset_name", "dataset_id")


_RK = "(accuracy, -iteration, -l_partkey, -l_suppkey)"
_BEST_SQL = f"""(SELECT run_id, arg_max(iteration, {_RK}) AS iteration, max(accuracy) AS accuracy,
  arg_max("precision", {_RK}) AS "precision", arg_max(recall, {_RK}) AS recall,
  arg_max(f1_score, {_RK}) AS f1_score FROM {EPOCHS} WHERE accuracy IS NOT NULL GROUP BY run_id)"""
_TIE = ["l_partkey", "l_suppkey"]


@register("best_epoch", f"SELECT * FROM {_BEST_SQL}")
def q_best_epoch(spark, sf):
    return G.best_epoch(R.epochs(spark, sf), tie=_TIE)


@register("best_epoch_backfill", f"""SELECT r.id, r.model_id, b.iteration AS best_iteration, b."precision", b.recall, b.f1_score
  FROM {RUNS} r JOIN {_BEST_SQL} b ON b.run_id = r.id WHERE r.status = 'completed'""")
def q_backfill(spark, sf):
    b = G.best_epoch(R.epochs(spark, sf), tie=_TIE)
    r = R.runs(spark, sf).filter(F.col("status") == "completed").select("id", "model_id")
    return r.join(b, r.id == b.run_id).select("id", "model_id", F.col("iteration").alias("best_iteration"),
                                              "precision", "recall", "f1_score")


def _viol_sql():
    e = G.ENUMS
    lst = lambda k: ", ".join(f"'{v}'" for v in e[k])
    return f"""SELECT 'datasets' AS "table", 'domain' AS rule, id FROM {DS} WHERE domain NOT IN ({lst('datasets.domain')})
UNION ALL SELECT 'datasets', 'readiness', id FROM {DS} WHERE readiness NOT IN ({lst('datasets.readiness')})
UNION ALL SELECT 'datasets', 'total_samples', id FROM {DS} WHERE total_samples < 0
UNION ALL SELECT 'datasets', 'file_size', id FROM {DS} WHERE file_size IS NOT NULL AND file_size <= 0
UNION ALL SELECT 'models', 'task', id FROM {MODELS} WHERE task NOT IN ({lst('models.task')})
UNION ALL SELECT 'models', 'framework', id FROM {MODELS} WHERE framework NOT IN ({lst('models.framework')})
UNION ALL SELECT 'models', 'status', id FROM {MODELS} WHERE status NOT IN ({lst('models.status')})
UNION ALL SELECT 'models', 'accuracy', id FROM {MODELS} WHERE accuracy IS NOT NULL AND (accuracy < 0 OR accuracy > 100)
UNION ALL SELECT 'models', 'fk_dataset', id FROM {MODELS} m WHERE dataset_id IS NOT NULL AND dataset_id NOT IN (SELECT id FROM {DS})
UNION ALL SELECT 'training_runs', 'status', id FROM {RUNS} WHERE status NOT IN ({lst('training_runs.status')})
UNION ALL SELECT 'training_runs', 'epochs', id FROM {RUNS} WHERE current_epoch < 0 OR (total_epochs IS NOT NULL AND current_epoch > total_epochs)
UNION ALL SELECT 'training_runs', 'fk_model', id FROM {RUNS} WHERE model_id NOT IN (SELECT id FROM {MODELS})"""


@register("validate_registry", _viol_sql())
def q_validate_registry(spark, sf):
    return G.validate_registry(R.datasets(spark, sf), R.models(spark, sf), R.runs(spark, sf))


@register("dataset_record", f"""SELECT id, name, array_to_string(list_filter(list_transform(split(tags_text, ','), lambda t: trim(t)), lambda t: t <> ''), ',') AS tags,
  coalesce(file_size, 0) AS size, coalesce(description, 'Dataset ' || name) AS description FROM {DS}""")
def q_dataset_record(spark, sf):
    out = G.dataset_record(R.datasets(spark, sf))
    return out.withColumn("tags", F.array_join("tags", ","))


_VERS = f"""(SELECT model_id, 'v' || CAST(run_key % 5 AS VARCHAR) AS version, run_key % 11 = 0 AS is_current, created_at FROM {RUNS})"""


@register("current_version", f"""WITH v AS {_VERS},
f AS (SELECT model_id, arg_max(version, (created_at, version)) AS cv FROM v WHERE is_current GROUP BY model_id),
l AS (SELECT model_id, arg_max(version, (created_at, version)) AS lv FROM v GROUP BY model_id)
SELECT l.model_id, coalesce(f.cv, l.lv) AS version FROM l LEFT JOIN f USING (model_id)""")
def q_current_version(spark, sf):
    r = R.runs(spark, sf)
    v = r.select("model_id", F.concat(F.lit("v"), F.pmod("run_key", F.lit(5)).cast("string")).alias("version"),
                 (F.pmod("run_key", F.lit(11)) == 0).alias("is_current"), "created_at")
    return G.current_version(v)


@register("validation_state", f"""SELECT id, CASE WHEN file_path IS NOT NULL THEN 'ready' ELSE 'error' END AS readiness,
  CASE WHEN file_path IS NOT NULL THEN description ELSE concat_ws(' | ', description, 'missing data file') END AS description FROM {DS}""")
def q_validation_state(spark, sf):
    return G.validation_state(R.datasets(spark, sf), F.col("file_path").isNotNull(), F.lit("missing data file"))


# --------------------------------------------------------------------------- K
@register("flatten_tasks", f"""SELECT event_key, task_id FROM (
  SELECT seq AS event_key, unnest(CASE WHEN starts_with(trim(tasks_json), '[') THEN from_json(tasks_json, '[{{"task_id":"BIGINT","id":"BIGINT"}}]')
    ELSE [from_json(tasks_json, '{{"task_id":"BIGINT","id":"BIGINT"}}')] END) AS t FROM {SCORES})
  WHERE coalesce(t.task_id, t.id) IS NOT NULL""".replace("event_key, task_id FROM", "event_key, coalesce(t.task_id, t.id) AS task_id FROM", 1))
def q_flatten_tasks(spark, sf):
    s = R.scores(spark, sf).withColumnRenamed("seq", "event_key")
    return K.flatten_tasks(s, keep=["event_key"])


def _wide_sql():
    cols = ", ".join(f"arg_max(v, seq) FILTER (WHERE function = '{k}') AS {n}" for k, n in K.METRICS.items())
    return f"""(SELECT run_id, {cols} FROM (SELECT run_id, function, TRY_CAST(value AS DOUBLE) AS v, seq, dataset FROM {SCORES})
  WHERE run_id IS NOT NULL AND v IS NOT NULL AND function IN ({', '.join(f"'{k}'" for k in K.METRICS)}) GROUP BY run_id)"""


@register("runs_wide", f"SELECT * FROM {_wide_sql()}")
def q_runs_wide(spark, sf):
    return K.runs_wide(R.scores(spark, sf))


def _comp_sql(alias="w"):
    num = " + ".join(f"coalesce({alias}.{m} * {w}, 0.0)" for m, w in K.WEIGHTS.items())
    den = " + ".join(f"CASE WHEN {alias}.{m} IS NOT NULL THEN {w} ELSE 0.0 END" for m, w in K.WEIGHTS.items())
    return f"CASE WHEN ({den}) > 0 THEN ({num}) / ({den}) END"


@register("composite_score", f"SELECT run_id, round({_comp_sql()}, 6) AS score FROM {_wide_sql()} w")
def q_composite(spark, sf):
    w = K.runs_wide(R.scores(spark, sf))
    return rounded(w.select("run_id", K.composite_score(w).alias("score")))


_RUN_DS = f"(SELECT run_id, min(dataset) AS dataset FROM {SCORES} WHERE run_id IS NOT NULL GROUP BY run_id)"


@register("best_run", f"""SELECT dataset, arg_max(run_id, (score, -run_id)) AS run_id, round(max(score), 6) AS score FROM (
  SELECT d.dataset, w.run_id, {_comp_sql()} AS score FROM {_wide_sql()} w JOIN {_RUN_DS} d USING (run_id)) WHERE score IS NOT NULL GROUP BY dataset""")
def q_best_run(spark, sf):
    s = R.scores(spark, sf)
    ds = s.filter(F.col("run_id").isNotNull()).groupBy("run_id").agg(F.min("dataset").alias("dataset"))
    w = K.runs_wide(s).join(ds, "run_id")
    return rounded(K.best_run(w))


@register("merge_runs", f"""SELECT f.run_id, f.task_id, w.accuracy, w.auc, w.f1, w.rmse FROM
  (SELECT run_id, arg_min(task_id, seq) AS task_id FROM {SCORES} WHERE run_id IS NOT NULL GROUP BY run_id) f LEFT JOIN {_wide_sql()} w USING (run_id)""")
def q_merge_runs(spark, sf):
    s = R.scores(spark, sf).filter(F.col("run_id").isNotNull())
    return K.merge_runs(s)


@register("best_per_metric", f"""SELECT d.dataset, max(accuracy) AS best_accuracy, max(auc) AS best_auc, max(f1) AS best_f1, min(rmse) AS best_rmse
  FROM {_wide_sql()} w JOIN {_RUN_DS} d USING (run_id) GROUP BY d.dataset""")
def q_best_per_metric(spark, sf):
    s = R.scores(spark, sf)
    ds = s.filter(F.col("run_id").isNotNull()).groupBy("run_id").agg(F.min("dataset").alias("dataset"))
    return K.best_per_metric(K.runs_wide(s).join(ds, "run_id"))


_WANTED = ["House Price 1", "DS_10", "mnist digits 2"]


@register("dataset_selection", f"""SELECT DISTINCT id, name FROM {DS} WHERE lower(name) IN ({', '.join(f"'{w.lower()}'" for w in _WANTED)})
  OR lower(id) IN ({', '.join(f"'{w.lower()}'" for w in _WANTED)})""")
def q_dataset_selection(spark, sf):
    return K.dataset_selection(R.datasets(spark, sf).select("id", "name"), _WANTED)


# --------------------------------------------------------------------------- M
_LINE = r"^\[([^\]]+)\]\s*(?:\[([^\]]*)\])?\s*(.*)$"


def _parsed_sql(lines: str) -> str:
    return f"""(SELECT job_id, line_no,
  CASE WHEN regexp_matches(trim(line), '{_LINE}') THEN coalesce(TRY_CAST(regexp_extract(trim(line), '{_LINE}', 1) AS TIMESTAMP), file_time) ELSE file_time END AS timestamp,
  CASE WHEN regexp_matches(trim(line), '{_LINE}') AND regexp_extract(trim(line), '{_LINE}', 2) <> ''
    THEN regexp_extract(trim(line), '{_LINE}', 2) ELSE 'INFO' END AS level,
  CASE WHEN regexp_matches(trim(line), '{_LINE}') THEN regexp_extract(trim(line), '{_LINE}', 3) ELSE trim(line) END AS message
  FROM {lines} WHERE trim(line) <> '')"""


_PARSED_SQL = _parsed_sql(LOGS)


@register("parse_logs", f"SELECT * FROM {_PARSED_SQL}")
def q_parse_logs(spark, sf):
    return M.parse_logs(R.logs(spark, sf))


_LAST_LINES = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY line_no DESC) AS rn FROM {LOGS}) WHERE rn <= 3)"


@register("tail_logs", f"SELECT job_id, line_no, timestamp, level, message FROM {_parsed_sql(_LAST_LINES)}")
def q_tail_logs(spark, sf):
    return M.parse_logs(M.tail_logs(R.logs(spark, sf), 3))  # the last raw lines; blank ones among them drop out afterwards


@register("log_filter", f"SELECT * FROM {_PARSED_SQL} WHERE job_id = 7 AND level = 'ERROR'")
def q_log_filter(spark, sf):
    return M.log_filter(M.parse_logs(R.logs(spark, sf)), 7, "ERROR")


@register("progress", f"""SELECT id, round(current_iteration * 100.0 / total_iterations, 6) AS progress,
  round(CASE WHEN current_iteration % 2 = 0 THEN (current_iteration % 8 + 1) * 100.0 / 8 ELSE (current_iteration % 8) * 100.0 / 8 END, 6) AS stage_progress
  FROM {JOBS}""")
def q_progress(spark, sf):
    j = R.jobs(spark, sf)
    stage = F.pmod("current_iteration", F.lit(8)) + 1
    return rounded(j.select("id", M.progress_pct(F.col("current_iteration"), F.col("total_iterations")).alias("progress"),
                            M.stage_progress(stage, F.pmod("current_iteration", F.lit(2)) == 0).alias("stage_progress")))


@register("best_so_far", f"""SELECT run_id, iteration, accuracy, loss,
  max(accuracy) OVER (PARTITION BY run_id ORDER BY iteration, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_accuracy,
  min(loss) OVER (PARTITION BY run_id ORDER BY iteration, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_loss FROM {EPOCHS}""")
def q_best_so_far(spark, sf):
    e = R.epochs(spark, sf).select("run_id", "iteration", "accuracy", "loss", "l_partkey", "l_suppkey")
    return M.segmented_scan(e, ["run_id"], ["iteration", "l_partkey", "l_suppkey"],
                            {"best_accuracy": ("cummax", "accuracy"), "best_loss": ("cummin", "loss")}).drop("l_partkey", "l_suppkey")


@register("training_curve", f"""SELECT run_id, iteration, accuracy FROM {EPOCHS} WHERE iteration > 0
  AND run_id IN (SELECT run_id FROM {EPOCHS} WHERE iteration > 0 GROUP BY run_id HAVING count(*) >= 2)""")
def q_training_curve(spark, sf):
    return M.training_curve(R.epochs(spark, sf)).select("run_id", "iteration", "accuracy")


@register("append_epoch", f"""SELECT run_id, CAST(count(*) AS INTEGER) AS n_epochs,
  array_to_string(list(CAST(iteration AS VARCHAR) ORDER BY iteration, accuracy NULLS FIRST, loss, "precision", recall, f1_score), ',') AS iterations FROM {EPOCHS} GROUP BY run_id""")
def q_append_epoch(spark, sf):
    a = M.append_epoch(R.epochs(spark, sf))
    return a.select("run_id", F.size("epoch_metrics").alias("n_epochs"),
                    F.array_join(F.transform("epoch_metrics", lambda s: s["iteration"].cast("string")), ",").alias("iterations"))


@register("eta_progress", f"""SELECT id, CASE WHEN current_epoch <= 0 THEN 0 ELSE greatest(0, CAST(floor((epoch({NOW_SQL}) - epoch(created_at))
  / (current_epoch * 10.0) * 100.0) AS BIGINT) - CAST(epoch({NOW_SQL}) - epoch(created_at) AS BIGINT)) END AS eta_seconds FROM {RUNS}""")
def q_eta_progress(spark, sf):
    r = R.runs(spark, sf)
    elapsed = N.seconds_between(F.col("created_at"), now_col())
    return r.select("id", M.eta_progress(elapsed, F.col("current_epoch") * 10.0).alias("eta_seconds"))


@register("eta_stages", f"""SELECT id, CASE WHEN current_epoch % 8 > 0 THEN CAST(floor((CAST(coalesce(duration_seconds, 0) AS DOUBLE) / (current_epoch % 8)) * (8 - current_epoch % 8)) AS BIGINT) END AS eta_seconds FROM {RUNS}""")
def q_eta_stages(spark, sf):
    r = R.runs(spark, sf)
    return r.select("id", M.eta_stages(F.coalesce("duration_seconds", F.lit(0)), F.pmod("current_epoch", F.lit(8))).alias("eta_seconds"))


def _fmt_sql(x, style):
    h, m, s = f"({x} // 3600)", f"(({x} % 3600) // 60)", f"({x} % 60)"
    if style == "short":
        return (f"CASE WHEN {x} < 60 THEN {x} || 's' WHEN {x} < 3600 THEN ({x} // 60) || 'm ' || {s} || 's' "
                f"ELSE {h} || 'h ' || {m} || 'm' END")
    return f"CASE WHEN {h} > 0 THEN {h} || 'h ' || {m} || 'm ' || {s} || 's' WHEN {m} > 0 THEN {m} || 'm ' || {s} || 's' ELSE {s} || 's' END"


@register("format_duration", f"""SELECT id, duration_seconds, CASE WHEN duration_seconds IS NULL THEN NULL ELSE {_fmt_sql('duration_seconds', 'long')} END AS long_text,
  CASE WHEN duration_seconds IS NULL THEN NULL ELSE {_fmt_sql('duration_seconds', 'short')} END AS short_text,
  CASE WHEN coalesce(duration_seconds, 0) = 0 THEN 'N/A' ELSE {_fmt_sql('duration_seconds', 'long')} END AS ui_text FROM {RUNS}""")
def q_format_duration(spark, sf):
    d = F.col("duration_seconds")
    return R.runs(spark, sf).select("id", "duration_seconds", N.format_duration(d).alias("long_text"),
                                    N.format_duration(d, "short").alias("short_text"), N.format_duration_ui(d).alias("ui_text"))


@register("parse_duration", f"""SELECT id, CASE WHEN duration_seconds IS NULL THEN NULL ELSE
  coalesce(TRY_CAST(nullif(regexp_extract({_fmt_sql('duration_seconds', 'long')}, '(\\d+)h', 1), '') AS BIGINT), 0) * 3600
  + coalesce(TRY_CAST(nullif(regexp_extract({_fmt_sql('duration_seconds', 'long')}, '(\\d+)m', 1), '') AS BIGINT), 0) * 60
  + coalesce(TRY_CAST(nullif(regexp_extract({_fmt_sql('duration_seconds', 'long')}, '(\\d+)s', 1), '') AS BIGINT), 0) END AS seconds FROM {RUNS}""")
def q_parse_duration(spark, sf):
    r = R.runs(spark, sf)
    txt = N.format_duration(F.col("duration_seconds"))
    return r.select("id", F.when(F.col("duration_seconds").isNotNull(), N.parse_duration(txt)).alias("seconds"))


@register("avg_time_per_iteration", f"""SELECT id, CASE WHEN coalesce(duration_seconds, 0) <> 0 AND coalesce(current_epoch, 0) > 0 THEN
  CASE WHEN CAST(duration_seconds AS DOUBLE) / current_epoch < 60 THEN printf('%.1f', CASE WHEN (CAST(duration_seconds AS DOUBLE) / current_epoch) * 10 - floor((CAST(duration_seconds AS DOUBLE) / current_epoch) * 10) = 0.5 THEN (floor((CAST(duration_seconds AS DOUBLE) / current_epoch) * 10) + 1) / 10 ELSE (CAST(duration_seconds AS DOUBLE) / current_epoch) END) || 's'
       WHEN CAST(duration_seconds AS DOUBLE) / current_epoch < 3600 THEN printf('%.1f', CASE WHEN (CAST(duration_seconds AS DOUBLE) / current_epoch / 60) * 10 - floor((CAST(duration_seconds AS DOUBLE) / current_epoch / 60) * 10) = 0.5 THEN (floor((CAST(duration_seconds AS DOUBLE) / current_epoch / 60) * 10) + 1) / 10 ELSE (CAST(duration_seconds AS DOUBLE) / current_epoch / 60) END) || 'm'
       ELSE printf('%.1f', CASE WHEN (CAST(duration_seconds AS DOUBLE) / current_epoch / 3600) * 10 - floor((CAST(duration_seconds AS DOUBLE) / current_epoch / 3600) * 10) = 0.5 THEN (floor((CAST(duration_seconds AS DOUBLE) / current_epoch / 3600) * 10) + 1) / 10 ELSE (CAST(duration_seconds AS DOUBLE) / current_epoch / 3600) END) || 'h' END ELSE 'N/A' END AS avg_time FROM {RUNS}""")
def q_avg_time(spark, sf):
    return R.runs(spark, sf).select("id", N.avg_time_per_iteration(F.col("duration_seconds"), F.col("current_epoch")).alias("avg_time"))


@register("stage_durations", f"""WITH p AS (SELECT job_id, stage, min(CASE WHEN event = 'start' THEN ts END) AS started,
  max(CASE WHEN event = 'complete' THEN ts END) AS completed FROM {PROG} GROUP BY job_id, stage),
s AS (SELECT job_id, stage, CASE WHEN completed >= started THEN (epoch_us(completed) - epoch_us(started)) / 1e6 END AS seconds FROM p)
SELECT job_id, stage, round(seconds, 6) AS seconds, round(seconds * 100.0 / sum(seconds) OVER (PARTITION BY job_id), 6) AS percent FROM s""")
def q_stage_durations(spark, sf):
    return rounded(M.stage_durations(R.progress(spark, sf)))


@register("job_status", f"""SELECT job_id, CASE WHEN count_if(status = 'failed') > 0 THEN 'failed' WHEN count_if(status = 'completed') >= 8 THEN 'completed'
  ELSE 'running' END AS job_status, CAST(count_if(status = 'completed') AS BIGINT) AS completed_stages FROM {_STATE_SQL} GROUP BY job_id""")
def q_job_status(spark, sf):
    return M.job_status(R.progress(spark, sf))


@register("normalize_metric", f"""SELECT id, round(CASE WHEN coalesce(m_accuracy, m_acc) > 1 THEN coalesce(m_accuracy, m_acc) / 100.0 ELSE coalesce(m_accuracy, m_acc) END, 6) AS accuracy,
  round(CASE WHEN (CASE WHEN coalesce(m_accuracy, m_acc) <= 1 THEN coalesce(m_accuracy, m_acc) * 100.0 ELSE coalesce(m_accuracy, m_acc) END) > 1
    THEN (CASE WHEN coalesce(m_accuracy, m_acc) <= 1 THEN coalesce(m_accuracy, m_acc) * 100.0 ELSE coalesce(m_accuracy, m_acc) END) / 100.0
    ELSE (CASE WHEN coalesce(m_accuracy, m_acc) <= 1 THEN coalesce(m_accuracy, m_acc) * 100.0 ELSE coalesce(m_accuracy, m_acc) END) END, 6) AS accuracy_legacy
  FROM {MODELS}""")
def q_normalize_metric(spark, sf):
    mo = R.models(spark, sf)
    mm = metrics_map()
    return rounded(mo.select("id", M.normalize_metric(mm, ["accuracy", "acc"]).alias("accuracy"),
                             M.normalize_metric(mm, ["accuracy", "acc"], legacy=True).alias("accuracy_legacy")))


@register("final_summary", f"""SELECT r.id AS run_id, r.duration_seconds, e.iterations, e.final_accuracy, e.best_accuracy, e.final_loss, e.best_loss
  FROM (SELECT id, duration_seconds FROM {RUNS} WHERE status = 'completed') r LEFT JOIN
  (SELECT run_id, max(iteration) AS iterations, arg_max_null(accuracy, (iteration, l_partkey, l_suppkey)) AS final_accuracy, max(accuracy) AS best_accuracy,
   arg_max_null(loss, (iteration, l_partkey, l_suppkey)) AS final_loss, min(loss) AS best_loss FROM {EPOCHS} GROUP BY run_id) e ON e.run_id = r.id""")
def q_final_summary(spark, sf):
    return M.final_summary(R.epochs(spark, sf), R.runs(spark, sf), order=["iteration", "l_partkey", "l_suppkey"])


@register("failure_summary", f"""SELECT job_id, min(CASE WHEN status = 'failed' THEN stage END) AS failed_stage,
  CAST(count_if(status = 'completed') AS BIGINT) AS completed_stages FROM {_STATE_SQL} GROUP BY job_id HAVING min(CASE WHEN status = 'failed' THEN stage END) IS NOT NULL""")
def q_failure_summary(spark, sf):
    return M.failure_summary(R.progress(spark, sf))


# --------------------------------------------------------------------------- N
@register("scalar_functions", f"""SELECT id, CASE WHEN file_size >= 1000 THEN printf('%.1f', CASE WHEN (file_size / 1000.0) * 10 - floor((file_size / 1000.0) * 10) = 0.5 THEN (floor((file_size / 1000.0) * 10) + 1) / 10 ELSE (file_size / 1000.0) END) || 'K' ELSE CAST(file_size AS VARCHAR) END AS size_text,
  upper(substr(domain, 1, 1)) || substr(domain, 2) AS domain_text,
  coalesce(strftime(created_at, '%b %-d, %Y'), 'N/A') AS created_text,
  coalesce(list_filter(split(tags_csv, ','), lambda t: t <> 'regression')[1], 'Unknown') AS first_other_tag,
  CASE WHEN length(name) <= 8 THEN '***' ELSE substr(name, 1, 8) || '...' || right(name, 4) END AS masked_name,
  regexp_replace('postgresql://user' || CAST(total_samples AS VARCHAR) || ':secret@db:5432/x', '^([^:/]+://[^:@/]+):[^@]*@', '\\1:***@') AS masked_url,
  CASE WHEN total_samples / 10.0 <= 1 THEN total_samples / 10.0 * 100.0 ELSE total_samples / 10.0 END AS pct,
  CASE WHEN total_samples / 10.0 > 1 THEN total_samples / 1000.0 ELSE total_samples / 10.0 END AS ratio
  FROM {DS}""")
def q_scalar(spark, sf):
    ds = R.datasets(spark, sf)
    x = F.col("total_samples") / 10.0
    return rounded(ds.select(
        "id", N.abbrev_number(F.col("file_size")).alias("size_text"), N.capitalize(F.col("domain")).alias("domain_text"),
        N.format_date(F.col("created_at")).alias("created_text"),
        N.first_other_tag(F.split("tags_csv", ","), F.lit("regression")).alias("first_other_tag"),
        N.mask_secret(F.col("name")).alias("masked_name"),
        N.mask_url_password(F.concat(F.lit("postgresql://user"), F.col("total_samples").cast("string"),
                                     F.lit(":secret@db:5432/x"))).alias("masked_url"),
        N.to_percent(x).alias("pct"), N.to_ratio(x).alias("ratio")))


@register("json_field", "SELECT event_id, coalesce(json_extract_string(props, '$.k'), '0') AS k FROM events")
def q_json_field(spark, sf):
    return load(spark, sf, "events").select("event_id", N.json_field(F.col("props"), "$.k", "0").alias("k"))
