"""Run telemetry (M1-M18): log parsing, progress, best-so-far, stage timing.

Per-run aggregates use ``max_by`` / conditional aggregates (partial
aggregation, hot runs combine map-side); running values use the segmented
scan; top-N per key uses ``row_number() <= N`` which Spark executes with a
partial WindowGroupLimit before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.ordered import segmented_scan

N_STAGES = 8
LOG_PATTERN = r"^\[([^\]]+)\]\s*(?:\[([^\]]*)\])?\s*(.*)$"


def parse_logs(lines: DataFrame, line: str = "line", file_time: str = "file_time") -> DataFrame:
    """M1: '[ts] [LEVEL] msg'; the level is the text up to its bracket, none -> INFO; a first bracket that is no time,
    or an unstructured line -> the file time; blanks dropped."""
    l = F.trim(F.col(line))
    structured = l.rlike(LOG_PATTERN)
    ts_txt = F.regexp_extract(l, LOG_PATTERN, 1)
    lvl = F.regexp_extract(l, LOG_PATTERN, 2)
    msg = F.regexp_extract(l, LOG_PATTERN, 3)
    return (lines.filter(l != "").select(
        *[c for c in lines.columns if c not in (line, file_time)],
        F.when(structured, F.coalesce(ts_txt.try_cast("timestamp_ntz"), F.col(file_time))).otherwise(F.col(file_time)).alias("timestamp"),
        F.when(structured & (lvl != ""), lvl).otherwise(F.lit("INFO")).alias("level"),
        F.when(structured, msg).otherwise(l).alias("message")))


def tail_logs(logs: DataFrame, n: int | None, key: str = "job_id", order: str = "line_no") -> DataFrame:
    """M2: most recent N raw lines per key (0 / NULL = all); parse them afterwards, which drops blank ones."""
    if not n:
        return logs
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return logs.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def log_filter(logs: DataFrame, key_value, level: str | None = None, key: str = "job_id") -> DataFrame:
    """M3: logs of one run in time order, optionally by level."""
    out = logs.filter(F.col(key) == F.lit(key_value))
    if level:
        out = out.filter(F.col("level") == level)
    return out.orderBy("timestamp", "line_no")


def progress_pct(iteration: Column, total: Column) -> Column:
    """M4: iteration / total x 100."""
    return F.try_divide(iteration.cast("double") * 100.0, total.cast("double"))


def stage_progress(stage: Column, done: Column) -> Column:
    """M4: stage start (k-1)/8 x 100, stage end k/8 x 100."""
    return F.when(done, stage * 100.0 / N_STAGES).otherwise((stage - 1) * 100.0 / N_STAGES)


def best_so_far(epochs: DataFrame, run: str = "run_id", order: str = "iteration") -> DataFrame:
    """M5: running max accuracy and min loss per run in iteration order."""
    return segmented_scan(epochs, [run], [order], {"best_accuracy": ("cummax", "accuracy"), "best_loss": ("cummin", "loss")})


def training_curve(epochs: DataFrame, run: str = "run_id") -> DataFrame:
    """M7: iterations > 0 only, runs with at least two such points."""
    e = epochs.filter(F.col("iteration") > 0)
    keep = e.groupBy(run).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= 2).select(run)
    return e.join(keep, run, "left_semi")


def append_epoch(epochs: DataFrame, run: str = "run_id") -> DataFrame:
    """M8 (batch): per-run epoch_metrics array sorted by iteration, with the iteration's hyperparameters where the table has them.

    An array holds the iterations of one run, which the training loop bounds.
    """
    item = F.struct(*["iteration", "accuracy", "loss", "precision", "recall", "f1_score", "ts"], *[c for c in ("hyperparameters",) if c in epochs.columns])
    return epochs.groupBy(run).agg(F.array_sort(F.collect_list(item)).alias("epoch_metrics"))


def eta_progress(elapsed: Column, progress: Column) -> Column:
    """M9: remaining = int(elapsed / progress% x 100) - elapsed, >= 0; 0 when progress = 0."""
    total = F.floor(F.try_divide(elapsed.cast("double"), progress.cast("double")) * 100.0)
    return F.when(F.coalesce(progress, F.lit(0)) <= 0, F.lit(0)).otherwise(F.greatest(F.lit(0), (total - elapsed).cast("long")))


def eta_stages(elapsed: Column, completed_stages: Column, total: int = N_STAGES) -> Column:
    """Average seconds per completed stage x remaining stages."""
    avg = F.try_divide(elapsed.cast("double"), completed_stages.cast("double"))
    return F.when(completed_stages > 0, (avg * (F.lit(total) - completed_stages)).cast("long")).otherwise(F.lit(None))


def stage_durations(events: DataFrame, job: str = "job_id") -> DataFrame:
    """Pair start/complete per (job, stage): seconds and share of the job total."""
    per = events.groupBy(job, "stage").agg(
        F.min(F.when(F.col("event") == "start", F.col("ts"))).alias("started"),
        F.max(F.when(F.col("event") == "complete", F.col("ts"))).alias("completed"))
    from quarry.functions.scalar import epoch_micros
    secs = (epoch_micros(F.col("completed")) - epoch_micros(F.col("started"))) / 1e6  # zone-free
    per = per.withColumn("seconds", F.when(F.col("completed") >= F.col("started"), secs))
    tot = per.groupBy(job).agg(F.sum("seconds").alias("_total"))
    return per.join(tot, job).select(job, "stage", "seconds",
                                     F.try_divide(F.col("seconds") * 100.0, F.col("_total")).alias("percent"))


def stage_state(events: DataFrame, job: str = "job_id") -> DataFrame:
    """Latest event per (job, stage) -> running / completed / failed."""
    latest = events.groupBy(job, "stage").agg(F.max_by("event", F.struct("ts", "event_id")).alias("last_event"))
    return latest.select(job, "stage", F.when(F.col("last_event") == "start", F.lit("running"))
                         .when(F.col("last_event") == "complete", F.lit("completed"))
                         .otherwise(F.lit("failed")).alias("status"))


def job_status(events: DataFrame, job: str = "job_id") -> DataFrame:
    """A job fails on any error event, completes when all 8 stages completed, else runs."""
    st = stage_state(events, job)
    return st.groupBy(job).agg(
        F.when(F.count_if(F.col("status") == "failed") > 0, F.lit("failed"))
        .when(F.count_if(F.col("status") == "completed") >= N_STAGES, F.lit("completed"))
        .otherwise(F.lit("running")).alias("job_status"),
        F.count_if(F.col("status") == "completed").alias("completed_stages"))


def normalize_metric(metrics: Column, aliases: list[str], legacy: bool = False) -> Column:
    """First present alias; ratios stay ratios (> 1 means percent); legacy = worker rule."""
    v = F.coalesce(*[metrics[a] for a in aliases])
    if legacy:
        pct = F.when(v <= 1, v * 100.0).otherwise(v)
        return F.when(pct > 1, pct / 100.0).otherwise(pct)
    return F.when(v > 1, v / 100.0).otherwise(v)


def final_summary(epochs: DataFrame, runs: DataFrame, run: str = "run_id", order: list[str] | None = None) -> DataFrame:
    """Per completed run: last iteration, final (last reported) and best accuracy/loss."""
    last = F.struct(*[F.col(c) for c in (order or ["iteration"])])
    agg = epochs.groupBy(run).agg(
        F.max("iteration").alias("iterations"),
        F.max_by("accuracy", last).alias("final_accuracy"), F.max("accuracy").alias("best_accuracy"),
        F.max_by("loss", last).alias("final_loss"), F.min("loss").alias("best_loss"))
    done = runs.filter(F.col("status") == "completed").select(F.col("id").alias(run), "duration_seconds")
    return done.join(agg, run, "left")


def failure_summary(events: DataFrame, job: str = "job_id", message: str | None = None) -> DataFrame:
    """Failed jobs: first failed stage, completed stage count and, from a column ``message``, the text of that stage's last error."""
    st = stage_state(events, job)
    out = st.groupBy(job).agg(
        F.min(F.when(F.col("status") == "failed", F.col("stage"))).alias("failed_stage"),
        F.count_if(F.col("status") == "completed").alias("completed_stages")).filter(F.col("failed_stage").isNotNull())
    if message is None:
        return out
    texts = events.filter(F.col("event") == "error").groupBy(job, F.col("stage").alias("failed_stage")).agg(
        F.max_by(message, F.struct("ts", "event_id")).alias("error_message"))
    return out.join(texts, [job, "failed_stage"], "left").select(job, "failed_stage", "completed_stages", "error_message")
