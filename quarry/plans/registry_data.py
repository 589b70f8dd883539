"""Registry, telemetry and prediction tables derived from the driver tables.

Each derivation is one SQL template rendered for Spark (``spark.sql`` with
DataFrame parameters) and for DuckDB (the oracle), so both engines see the
same rows. customer -> datasets, part -> models, orders -> training_runs and
jobs, lineitem -> epoch metrics, events -> progress events and log lines,
labels + documents -> predictions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.sources.tables import load

# Fixed vocabulary used to derive dataset names and descriptions.
TOPICS = ["flower classification", "house price", "mnist digits", "object detection", "credit fraud",
          "sales forecast", "customer segments", "weather station", "pet images", "defect inspection",
          "sentiment reviews", "energy consumption"]
DESCRIPTIONS = ["classify each record", "predict a continuous value", "detect and locate items", "raw export"]


def _case(expr: str, values: list[str]) -> str:
    n = len(values)
    whens = " ".join(f"WHEN {expr} % {n} = {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {whens} END"


def addsec(ts: str, n: str, engine: str) -> str:
    if engine == "spark":  # day-time interval arithmetic on TIMESTAMP_NTZ is time-zone free
        return f"({ts} + make_dt_interval(0, 0, 0, CAST({n} AS BIGINT)))"
    return f"({ts} + to_seconds(CAST({n} AS BIGINT)))"


def base_ts(engine: str) -> str:
    return "TIMESTAMP_NTZ '2024-01-01 00:00:00'" if engine == "spark" else "TIMESTAMP '2024-01-01 00:00:00'"


def datasets_sql(engine: str, customer: str = "customer") -> str:
    t0 = base_ts(engine)
    return f"""SELECT 'ds_' || CAST(c_custkey AS STRING) AS id,
  {_case('c_custkey', TOPICS)} || ' ' || CAST(c_custkey AS STRING) AS name,
  CASE WHEN c_nationkey % 3 = 0 THEN 'vision' ELSE 'tabular' END AS domain,
  CASE WHEN c_custkey % 50 = 0 THEN 'error' ELSE {_case('c_custkey', ['draft', 'processing', 'ready', 'failed'])} END AS readiness,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE {_case('c_nationkey', DESCRIPTIONS)} || ' for ' || lower(c_mktsegment) END AS description,
  CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE '/data/ds_' || CAST(c_custkey AS STRING) || '.csv' END AS file_path,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(c_custkey * 1000 + c_nationkey AS BIGINT) END AS file_size,
  CAST(c_nationkey * 100 + c_custkey % 100 AS INT) AS total_samples,
  ' ' || lower(c_mktsegment) || ' ,' || CASE WHEN c_nationkey % 3 = 0 THEN 'vision' ELSE 'tabular' END || ',, ' AS tags_text,
  CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE
    CASE WHEN c_custkey % 4 = 0 THEN 'regression' ELSE lower(c_mktsegment) END || ',' ||
    CASE WHEN c_custkey % 4 = 1 THEN 'classification' ELSE 'data' END END AS tags_csv,
  CAST(c_custkey % 4 AS INT) AS n_classes,
  c_custkey % 7 = 0 AS has_annotations,
  c_custkey % 13 = 0 AS has_masks,
  CAST(c_nationkey * 5 AS INT) AS target_unique_values,
  CASE WHEN c_acctbal > 5000 THEN 'float64' ELSE 'int64' END AS target_dtype,
  {addsec(t0, 'c_custkey * 3600', engine)} AS created_at
FROM {customer}"""


def models_sql(engine: str, part: str = "part") -> str:
    t0 = base_ts(engine)
    return f"""SELECT 'm_' || CAST(p_partkey AS STRING) AS id, p_name AS name,
  {_case('p_partkey', ['classification', 'regression', 'clustering', 'detection', 'unknown'])} AS task,
  CASE WHEN p_partkey % 40 = 0 THEN 'autogluon' ELSE {_case('p_size', ['pytorch', 'tensorflow', 'sklearn'])} END AS framework,
  {_case('p_partkey', ['draft', 'queued', 'training', 'ready', 'active', 'failed'])} AS status,
  CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE round(p_retailprice / 25.0, 2) END AS accuracy,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE round(p_retailprice / 1000.0, 6) END AS loss,
  'ds_' || CAST((p_partkey * 7) % 1601 + 1 AS STRING) AS dataset_id,
  lower(p_brand) AS brand_tag,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE round((p_retailprice % 100) / 100.0, 4) END AS m_accuracy,
  CASE WHEN p_partkey % 7 = 0 THEN round((p_retailprice % 100) / 100.0, 4) END AS m_acc,
  CASE WHEN p_partkey % 5 = 1 THEN round(CAST(p_size AS DOUBLE) / 50, 4) END AS m_r2,
  CASE WHEN p_partkey % 2 = 0 THEN round(p_retailprice / 700.0, 4) END AS m_loss,
  {addsec(t0, 'p_partkey * 60', engine)} AS created_at
FROM {part}"""


def runs_sql(engine: str, orders: str = "orders") -> str:
    created = addsec("o_orderdate", "o_orderkey % 86400", engine)
    started = addsec(created, "60", engine)
    completed = addsec(started, "CAST(floor(o_totalprice) AS BIGINT) % 7200", engine)
    status = _case('o_orderkey', ['pending', 'queued', 'running', 'completed', 'failed', 'stopped'])
    return f"""SELECT 'r_' || CAST(o_orderkey AS STRING) AS id, o_orderkey AS run_key,
  'm_' || CAST(o_custkey % 199 + 1 AS STRING) AS model_id,
  'ds_' || CAST(o_custkey AS STRING) AS dataset_id,
  {status} AS status,
  CAST(o_orderkey % 10 AS INT) AS current_epoch, CAST(10 AS INT) AS total_epochs,
  CASE WHEN o_orderkey % 6 IN (3, 4) THEN round(o_totalprice / 4000.0, 2) END AS final_accuracy,
  CASE WHEN o_orderkey % 6 IN (3, 4) THEN round(1000.0 / o_totalprice, 6) END AS final_loss,
  CASE WHEN o_orderkey % 6 = 3 AND o_orderkey % 4 <> 0 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) % 7200 AS INT) END AS duration_seconds,
  {created} AS created_at,
  CASE WHEN o_orderkey % 6 IN (0, 1) THEN NULL ELSE {started} END AS started_at,
  CASE WHEN o_orderkey % 6 IN (3, 4, 5) THEN {completed} END AS completed_at,
  CASE WHEN o_orderkey % 6 = 4 THEN 'stage failed: ' || o_orderpriority END AS error_message,
  CAST(o_orderkey % 8 + 1 AS INT) AS failed_stage
FROM {orders}"""


def jobs_sql(engine: str, orders: str = "orders") -> str:
    created = addsec("o_orderdate", "o_orderkey % 43200", engine)
    return f"""SELECT 'j_' || CAST(o_orderkey AS STRING) AS id,
  CASE WHEN o_orderkey % 3 = 0 THEN 'automl' ELSE 'training' END AS job_type,
  {_case('o_orderkey', ['pending', 'queued', 'running', 'completed', 'failed', 'stopped', 'pending'])} AS status,
  CAST(o_orderkey % 5 AS INT) AS attempts, CAST(3 AS INT) AS max_attempts,
  'm_' || CAST(o_custkey % 199 + 1 AS STRING) AS model_id,
  'ds_' || CAST(o_custkey + (o_orderkey % 2) * 100000 AS STRING) AS dataset_id,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE '/data/' || CAST(o_custkey AS STRING) || '.csv' END AS dataset_path,
  CAST(o_orderkey % 11 AS INT) AS current_iteration, CAST(10 AS INT) AS total_iterations,
  {created} AS created_at
FROM {orders}"""


def epochs_sql(engine: str, lineitem: str = "lineitem") -> str:
    """One row per (run, iteration) from lineitem lines of the run's order."""
    ts = addsec("l_shipdate", "l_linenumber * 60", engine)
    qt = "`" if engine == "spark" else '"'
    return f"""SELECT 'r_' || CAST(l_orderkey AS STRING) AS run_id, l_orderkey AS run_key,
  CAST(l_linenumber - 1 AS INT) AS iteration,
  CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE round(0.5 + l_discount * 4 + l_tax, 4) END AS accuracy,
  round(2.0 - l_discount * 10 - l_tax * 5, 4) AS loss,
  round(0.4 + l_tax * 5, 4) AS {qt}precision{qt}, round(0.45 + l_discount * 5, 4) AS recall,
  round(0.42 + (l_tax + l_discount) * 3, 4) AS f1_score,
  CAST(l_quantity AS INT) AS batch_size,
  {ts} AS ts, l_partkey, l_suppkey
FROM {lineitem}"""


def training_logs_sql(engine: str, lineitem: str = "lineitem") -> str:
    """One log row per line of the run's order; levels drift now and then, and some runs are unknown."""
    return f"""SELECT 'l_' || CAST(l_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING) || '_' || CAST(l_partkey AS STRING) || '_' || CAST(l_suppkey AS STRING) AS id,
  'r_' || CAST(l_orderkey + CASE WHEN l_partkey % 97 = 0 THEN 1000000000 ELSE 0 END AS STRING) AS training_run_id,
  CASE WHEN l_suppkey % 29 = 0 THEN 'TRACE' ELSE {_case('l_partkey', ['DEBUG', 'INFO', 'WARNING', 'ERROR', 'CRITICAL'])} END AS log_level,
  CAST(l_linenumber AS INT) AS epoch
FROM {lineitem}"""


def versions_sql(engine: str, orders: str = "orders") -> str:
    """One version per training run; a model's versions repeat."""
    return f"""SELECT 'v_' || CAST(o_orderkey AS STRING) AS id, 'm_' || CAST(o_custkey % 199 + 1 AS STRING) AS model_id,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 'r_' || CAST(o_orderkey AS STRING) END AS training_run_id,
  'v' || CAST(o_orderkey % 1009 AS STRING) AS version, o_orderkey % 11 = 0 AS is_current
FROM {orders}"""


def progress_sql(engine: str, events: str = "events") -> str:
    """events -> stage events: user = job, event_id orders them, type -> stage/event."""
    return f"""SELECT event_id, user_id AS job_id,
  CAST(event_id % 8 + 1 AS INT) AS stage,
  CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 2 = 0 THEN 'start' ELSE 'complete' END AS event,
  round(value / 50.0, 4) AS accuracy, round(1.0 / (value + 1.0), 4) AS loss, ts
FROM {events}"""


def logs_sql(engine: str, events: str = "events") -> str:
    """events -> raw log lines: full, one-bracket, plain and blank variants."""
    if engine == "spark":
        tstxt = "date_format(ts, 'yyyy-MM-dd HH:mm:ss')"
    else:
        tstxt = "strftime(ts, '%Y-%m-%d %H:%M:%S')"
    return f"""SELECT user_id AS job_id, event_id AS line_no,
  CASE WHEN event_id % 13 = 0 THEN '   '
       WHEN event_id % 11 = 0 THEN 'plain message ' || event_type
       WHEN event_id % 7 = 0 THEN '[' || {tstxt} || '] ' || event_type || ' happened'
       ELSE '[' || {tstxt} || '] [' || upper(CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'view' THEN 'debug' ELSE 'info' END)
            || '] ' || event_type || ' ' || props END AS line,
  ts AS file_time
FROM {events}"""


def predictions_sql(engine: str) -> str:
    """labels x documents: true quality vs a length rule, score from the text length."""
    return """SELECT l.doc_id AS id, CAST(l.quality AS STRING) AS y_true,
  CASE WHEN d.n_chars > 1500 THEN '1' ELSE '0' END AS y_pred,
  round(1.0 / (1.0 + exp(-(CAST(d.n_chars AS DOUBLE) - 1500) / 1000)), 6) AS score,
  CAST(l.quality AS DOUBLE) AS y_true_num, round(CAST(d.n_chars AS DOUBLE) / 3000, 6) AS y_pred_num,
  l.toxic AS toxic
FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""


def spark_table(spark: SparkSession, sf: str, builder, source: str) -> DataFrame:
    text = builder("spark", "__SRC__").replace("{", "{{").replace("}", "}}").replace("__SRC__", "{src}")
    return spark.sql(text, src=load(spark, sf, source))


def datasets(spark, sf):
    return spark_table(spark, sf, lambda e, t: datasets_sql(e, t), "customer")


def models(spark, sf):
    return spark_table(spark, sf, lambda e, t: models_sql(e, t), "part")


def runs(spark, sf):
    return spark_table(spark, sf, lambda e, t: runs_sql(e, t), "orders")


def jobs(spark, sf):
    return spark_table(spark, sf, lambda e, t: jobs_sql(e, t), "orders")


def training_logs(spark, sf):
    return spark_table(spark, sf, lambda e, t: training_logs_sql(e, t), "lineitem")


def versions(spark, sf):
    return spark_table(spark, sf, lambda e, t: versions_sql(e, t), "orders")


def epochs(spark, sf):
    return spark_table(spark, sf, lambda e, t: epochs_sql(e, t), "lineitem")


def progress(spark, sf):
    return spark_table(spark, sf, lambda e, t: progress_sql(e, t), "events")


def logs(spark, sf):
    return spark_table(spark, sf, lambda e, t: logs_sql(e, t), "events")


def predictions(spark, sf):
    return spark.sql(predictions_sql("spark").replace("labels l", "{labels} l").replace("documents d", "{documents} d"),
                     labels=load(spark, sf, "labels"), documents=load(spark, sf, "documents"))


def duck(builder) -> str:
    """DuckDB text of a derived table, as a parenthesised subquery."""
    return "(" + builder("duckdb") + ")"


def scores_sql(engine: str, events: str = "events") -> str:
    """events -> benchmark score rows (run, task, metric function, value text, seq)."""
    fn = ("CASE event_type WHEN 'click' THEN 'predictive_accuracy' WHEN 'view' THEN 'area_under_roc_curve' "
          "WHEN 'purchase' THEN 'f_measure' WHEN 'signup' THEN 'root_mean_squared_error' ELSE 'usercpu_time' END")
    return f"""SELECT CASE WHEN event_id % 97 = 0 THEN NULL ELSE user_id END AS run_id,
  CAST(user_id % 7 + (event_id % 3) * 10 AS BIGINT) AS task_id,
  'ds_' || CAST(user_id % 5 AS STRING) AS dataset,
  {fn} AS function,
  CASE WHEN event_id % 17 = 0 THEN 'n/a' ELSE CAST(round(value / 50.0, 4) AS STRING) END AS value,
  event_id AS seq,
  CASE WHEN event_id % 3 = 0 THEN '{{"task_id": ' || CAST(user_id AS STRING) || '}}'
       WHEN event_id % 3 = 1 THEN '[{{"id": ' || CAST(user_id AS STRING) || '}}, {{"task_id": ' || CAST(user_id + 1000 AS STRING) || '}}]'
       ELSE '{{"id": ' || CAST(event_id AS STRING) || '}}' END AS tasks_json
FROM {events}"""


def scores(spark, sf):
    return spark_table(spark, sf, lambda e, t: scores_sql(e, t), "events")


def spark_stream_table(spark: SparkSession, source: DataFrame, builder) -> DataFrame:
    """The same derivation over a (streaming) source DataFrame."""
    text = builder("spark", "__SRC__").replace("{", "{{").replace("}", "}}").replace("__SRC__", "{src}")
    return spark.sql(text, src=source)
