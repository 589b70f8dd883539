"""Streaming queries (M19, M20, M5 stream): run availableNow over the driver tables, return the sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.plans import registry_data as R
from quarry.plans.catalog import register
from quarry.plans.q_registry import _PARSED_SQL, PROG
from quarry.streaming import stateful as SF
from quarry.streaming import streams as ST
from quarry.sources.tables import load


def _events_stream(spark, sf):
    schema = load(spark, sf, "events").schema
    return ST.file_stream(spark, sf, schema, pattern="events.parquet")


@register("log_stream", f"SELECT * FROM {_PARSED_SQL}")
def q_log_stream(spark, sf):
    ev = _events_stream(spark, sf)
    lines = R.spark_stream_table(spark, ev, lambda e, t: R.logs_sql(e, t))
    out = ST.run_available_now(ST.log_stream(lines), ST.stream_root(spark, "logs"))
    return spark.read.parquet(out)


@register("progress_stream", f"""SELECT job_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(stage, (ts, event_id)) AS stage,
  arg_max(event, (ts, event_id)) AS event, arg_max(accuracy, (ts, event_id)) AS accuracy, arg_max(loss, (ts, event_id)) AS loss,
  max(ts) AS ts, CAST(count(*) AS BIGINT) AS events FROM {PROG} GROUP BY job_id""")
def q_progress_stream(spark, sf):
    out, _ = _job_states(spark, sf)
    return SF.current(spark, out).select("job_id", "event_id", "stage", "event", "accuracy", "loss", "ts", "events")


def _job_states(spark, sf, batches=3):
    """The progress events as a stream of several micro-batches, each with events older than some that came before."""
    prog = R.progress(spark, sf)
    root = ST.stream_root(spark, "progress")
    files = SF.as_arrivals(prog, f"{root}/arrivals", batches)
    return SF.run_job_states(ST.file_stream(spark, f"{root}/arrivals", prog.schema, max_files=files), root), root


@register("stage_state_stream", f"""WITH last AS (SELECT job_id, stage, arg_max(event, (ts, event_id)) AS event FROM {PROG} GROUP BY job_id, stage)
SELECT job_id, CAST(count(*) AS INTEGER) AS stages, CAST(count_if(event = 'start') AS INTEGER) AS started, CAST(count_if(event = 'complete') AS INTEGER) AS completed,
  bool_or(event = 'error') AS failed FROM last GROUP BY job_id""")
def q_stage_state_stream(spark, sf):
    """M15 as a stream: the state of every job's stages after several micro-batches with late events."""
    out, _ = _job_states(spark, sf)
    return SF.current(spark, out).select("job_id", "stages", "started", "completed", "failed")


@register("best_so_far_stream", f"""SELECT run_id, iteration, l_partkey AS tie1, l_suppkey AS tie2, accuracy, loss,
  max(accuracy) OVER (PARTITION BY run_id ORDER BY iteration, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_accuracy,
  min(loss) OVER (PARTITION BY run_id ORDER BY iteration, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_loss
  FROM {R.duck(lambda e: R.epochs_sql(e))}""")
def q_best_so_far_stream(spark, sf):
    schema = load(spark, sf, "lineitem").schema
    li = ST.file_stream(spark, sf, schema, pattern="lineitem.parquet")
    ep = R.spark_stream_table(spark, li, lambda e, t: R.epochs_sql(e, t)).select(
        "run_id", "iteration", F.col("l_partkey").alias("tie1"), F.col("l_suppkey").alias("tie2"), "accuracy", "loss")
    out = ST.best_so_far_batches(ep, ST.stream_root(spark, "best"))
    return spark.read.parquet(out).drop("batch_id")
