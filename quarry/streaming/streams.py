"""Structured Streaming variants of the telemetry operators.

Sources are file streams over parquet/text folders; sinks and checkpoints
live under the shared ``spark.checkpoint.dir`` (never a machine-local folder
on a cluster), so a restarted query resumes exactly once. Decisions (the
reference has no streaming semantics): event-time watermark of 10 minutes,
late rows dropped, duplicates removed with ``dropDuplicatesWithinWatermark``.
"""

from __future__ import annotations

import os
import uuid
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from quarry.operators.telemetry import parse_logs
from quarry.session import ensure_checkpoint_dir

WATERMARK = "10 minutes"


def stream_root(spark: SparkSession, name: str) -> str:
    """A fresh folder for one stream's sink and checkpoint under the shared checkpoint dir."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "streams", f"{name}-{uuid.uuid4().hex[:12]}")


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str | None = None,
                fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(folder)


def run_available_now(df: DataFrame, root: str, mode: str = "append", fmt: str = "parquet", batch_fn=None) -> str:
    """Run a streaming frame over everything available, then stop; returns the sink folder."""
    out, ckpt = os.path.join(root, "out"), os.path.join(root, "checkpoint")
    w = df.writeStream.outputMode(mode).option("checkpointLocation", ckpt).trigger(availableNow=True)
    if batch_fn is not None:
        q = w.foreachBatch(lambda b, i: batch_fn(b, i, out)).start()
    else:
        q = w.format(fmt).option("path", out).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return out


# --------------------------------------------------------------------------- M19
def log_stream(lines: DataFrame, job_col: str = "job_id") -> DataFrame:
    """Parsed log rows from a stream of raw lines (same parser as the batch M1)."""
    return parse_logs(lines)


# --------------------------------------------------------------------------- M20
def progress_stream(events: DataFrame, job: str = "job_id", event_id: str = "event_id", ts: str = "ts") -> DataFrame:
    """Current state per job = its latest event (by event time, then id), with dedup and watermark."""
    # watermarks need a zoned TIMESTAMP; NTZ event times are cast (session time zone UTC)
    ev = (events.withColumn("_event_time", F.col(ts).cast("timestamp"))
          .withWatermark("_event_time", WATERMARK).dropDuplicatesWithinWatermark([event_id]))
    return ev.groupBy(job).agg(
        F.max_by(F.struct(*[F.col(c) for c in events.columns if c != job]), F.struct(F.col(ts), F.col(event_id))).alias("s"),
        F.count(F.lit(1)).alias("events")).select(job, "s.*", "events")


# --------------------------------------------------------------------------- M5 stateful
_BEST_OUT = "run_id string, iteration int, tie1 long, tie2 long, accuracy double, loss double, best_accuracy double, best_loss double"
_BEST_STATE = "best_accuracy double, best_loss double"


def _best_state(key, pdfs: Iterator[pd.DataFrame], state):
    best_acc, best_loss = (state.get if state.exists else (None, None))
    for pdf in pdfs:
        pdf = pdf.sort_values(["iteration", "tie1", "tie2"])
        acc = pdf["accuracy"].astype("float64")
        loss = pdf["loss"].astype("float64")
        run_acc = acc.cummax().ffill()
        run_loss = loss.cummin().ffill()
        if best_acc is not None:
            run_acc = run_acc.fillna(best_acc).clip(lower=best_acc)
        if best_loss is not None:
            run_loss = run_loss.fillna(best_loss).clip(upper=best_loss)
        pdf = pdf.assign(best_accuracy=run_acc, best_loss=run_loss)
        if len(pdf):
            la, ll = pdf["best_accuracy"].iloc[-1], pdf["best_loss"].iloc[-1]
            best_acc = None if pd.isna(la) else float(la)
            best_loss = None if pd.isna(ll) else float(ll)
        yield pdf[["run_id", "iteration", "tie1", "tie2", "accuracy", "loss", "best_accuracy", "best_loss"]]
    state.update((best_acc, best_loss))


def best_so_far_stream(epochs: DataFrame) -> DataFrame:
    """M5 (stream): running best accuracy / loss per run kept in per-run state.

    Assumes iterations of a run arrive in order across micro-batches (as the
    training loop emits them); within a micro-batch rows are sorted.
    """
    return epochs.groupBy("run_id").applyInPandasWithState(
        _best_state, _BEST_OUT, _BEST_STATE, "append", GroupStateTimeout.NoTimeout)


# --------------------------------------------------------------------------- M5 batch-vectorised
def best_so_far_batches(epochs: DataFrame, root: str, order: list[str] | None = None) -> str:
    """M5 (stream, scalable form): per micro-batch a distributed segmented scan, then the running
    values are combined with a per-run state table from the previous batches.

    Exactly once: each batch writes ``out/batch_id=<id>`` and ``state/batch_id=<id>`` with
    overwrite, so a replayed batch rewrites the same folders; the state read is the latest
    batch id below the current one. Nothing is per key in Python.
    """
    from quarry.operators.ordered import segmented_scan
    order = order or ["iteration", "tie1", "tie2"]
    out_dir, state_dir = os.path.join(root, "out"), os.path.join(root, "state")

    def step(batch: DataFrame, batch_id: int, _out: str) -> None:
        spark = batch.sparkSession
        local = segmented_scan(batch, ["run_id"], order, {"b_acc": ("cummax", "accuracy"), "b_loss": ("cummin", "loss")})
        prev = _latest_state(spark, state_dir, batch_id)
        if prev is not None:
            local = local.join(prev, "run_id", "left")
        else:
            local = local.withColumn("s_acc", F.lit(None).cast("double")).withColumn("s_loss", F.lit(None).cast("double"))
        res = local.select(
            "run_id", *order, "accuracy", "loss",
            F.when(F.col("s_acc").isNull(), F.col("b_acc")).when(F.col("b_acc").isNull(), F.col("s_acc"))
            .otherwise(F.greatest("b_acc", "s_acc")).alias("best_accuracy"),
            F.when(F.col("s_loss").isNull(), F.col("b_loss")).when(F.col("b_loss").isNull(), F.col("s_loss"))
            .otherwise(F.least("b_loss", "s_loss")).alias("best_loss"))
        res.write.mode("overwrite").parquet(os.path.join(out_dir, f"batch_id={batch_id}"))
        written = spark.read.parquet(os.path.join(out_dir, f"batch_id={batch_id}"))
        new_state = written.groupBy("run_id").agg(F.max("best_accuracy").alias("s_acc"), F.min("best_loss").alias("s_loss"))
        if prev is not None:
            new_state = (prev.join(new_state.withColumnRenamed("s_acc", "n_acc").withColumnRenamed("s_loss", "n_loss"), "run_id", "full")
                         .select("run_id", F.greatest("s_acc", "n_acc").alias("s_acc"), F.least("s_loss", "n_loss").alias("s_loss")))
        new_state.write.mode("overwrite").parquet(os.path.join(state_dir, f"batch_id={batch_id}"))

    run_available_now(epochs, root, mode="append", batch_fn=step)
    return out_dir


def _latest_state(spark: SparkSession, state_dir: str, batch_id: int) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(state_dir)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    ids = []
    for st in fs.listStatus(path):
        name = st.getPath().getName()
        if name.startswith("batch_id="):
            bid = int(name.split("=", 1)[1])
            if bid < batch_id:
                ids.append(bid)
    if not ids:
        return None
    return spark.read.parquet(os.path.join(state_dir, f"batch_id={max(ids)}"))
