"""M15 / M20 with keyed state: the state of every job as its events arrive, in any order.

``transformWithState`` keeps one value per job in RocksDB, in the checkpoint
under the shared folder. A micro-batch reads and writes the state of the jobs
it has events of, and changelog checkpoints hold just these, so the state
written grows with the batch and not with all jobs. The sink gets the new state
of the same jobs in a folder of the batch's own, which a repeated batch writes
again; nothing that others read is rewritten. ``current`` reads the latest
state of each job from it.

The state is a maximum and a count, so late events change it as they would have
in time, and the result is that of a batch over all events.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarry.functions.scalar import epoch_micros
from quarry.streaming.streams import run_available_now

_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: Events as they come, and a job's state as it goes out; times are microseconds since 1970 by the event's clock.
EVENT = "job_id long, event_id long, stage int, event string, accuracy double, loss double, ts_us long"
OUT = ("job_id long, event_id long, stage int, event string, accuracy double, loss double, ts_us long, events long, "
       "stages int, started int, completed int, failed boolean, version long")
_STATE = ("event_id long, stage int, event string, accuracy double, loss double, ts_us long, events long, version long, "
          "stage_of array<int>, event_of array<string>, ts_of array<long>, id_of array<long>")
_LATEST = ["event_id", "stage", "event", "accuracy", "loss", "ts_us"]


def _value(v, kind=None):
    """A value for the state: None for what pandas shows as missing, and integers that it shows as floats beside these."""
    if v is None or (not isinstance(v, str) and pd.isna(v)):
        return None
    return kind(v) if kind else v


def _order(ts: int | None, event_id: int | None) -> tuple[int, int]:
    """Events by time, then id; those without come first."""
    return -2**63 if ts is None else ts, -2**63 if event_id is None else event_id


class JobState(StatefulProcessor):
    """The latest event of a job, how many came, and the latest event of each of its stages."""

    def __init__(self, ttl_ms: int | None = None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("job", _STATE, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest, events, version, stages = None, 0, 0, {}
        if self.state.exists():
            old = self.state.get()
            latest, events, version = tuple(old[:6]), old[6], old[7]
            stages = {s: (t, i, e) for s, e, t, i in zip(old[8], old[9], old[10], old[11], strict=True)}
        for pdf in rows:
            events += len(pdf)
            pdf = pdf.sort_values(["ts_us", "event_id"], na_position="first")
            end = {c: pdf[c].iloc[-1] for c in _LATEST}
            last = tuple(_value(end[c], kind) for c, kind in zip(_LATEST, (int, int, str, float, float, int), strict=True))
            if latest is None or _order(last[5], last[0]) > _order(latest[5], latest[0]):
                latest = last
            for s, e, t, i in pdf.drop_duplicates("stage", keep="last")[["stage", "event", "ts_us", "event_id"]].itertuples(index=False):
                s, own = _value(s, int), (_value(t, int), _value(i, int), _value(e, str))
                if s is not None and (s not in stages or _order(*own[:2]) > _order(*stages[s][:2])):
                    stages[s] = own
        order = sorted(stages)
        self.state.update((*latest, events, version + 1, order, [stages[s][2] for s in order], [stages[s][0] for s in order], [stages[s][1] for s in order]))
        now = [stages[s][2] for s in order]
        yield pd.DataFrame([(key[0], *latest, events, len(order), now.count("start"), now.count("complete"), "error" in now, version + 1)],
                           columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


@contextmanager
def _rocksdb(spark: SparkSession):
    """The settings of the state store while a query starts; it keeps them."""
    old = {k: spark.conf.get(k, None) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def job_states(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """A stream of the new state of every job that has events in a micro-batch.

    ``events`` has job_id, event_id, stage, event, accuracy, loss and ts (its time zone, if
    any, is the session's); events without a job are left out. With ``ttl_ms`` a job that has
    had no event for so long is forgotten.
    """
    rows = events.where("job_id is not null").select(
        F.col("job_id").cast("long").alias("job_id"), F.col("event_id").cast("long").alias("event_id"), F.col("stage").cast("int").alias("stage"), "event",
        F.col("accuracy").cast("double").alias("accuracy"), F.col("loss").cast("double").alias("loss"),
        epoch_micros(F.col("ts"), ntz=isinstance(events.schema["ts"].dataType, T.TimestampNTZType)).alias("ts_us"))
    return rows.groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=JobState(ttl_ms), outputStructType=OUT, outputMode="Update", timeMode="None" if ttl_ms is None else "ProcessingTime")


def write_batch(batch: DataFrame, batch_id: int, out: str) -> None:
    """The states of one micro-batch in a folder of its own."""
    batch.write.mode("overwrite").parquet(os.path.join(out, f"batch_id={batch_id}"))


def run_job_states(events: DataFrame, root: str, ttl_ms: int | None = None) -> str:
    """Run ``job_states`` over all that is there, in as many micro-batches as the source makes of it; returns the sink's folder."""
    with _rocksdb(events.sparkSession):
        return run_available_now(job_states(events, ttl_ms), root, mode="update", batch_fn=write_batch)


def current(spark: SparkSession, out: str) -> DataFrame:
    """The latest state of each job in a sink."""
    names = [c.split()[0] for c in OUT.split(", ")]
    rows = spark.read.schema(OUT + ", batch_id long").parquet(out)
    # versions fall back to 1 where a job was forgotten, so the batch decides first
    newest = rows.groupBy("job_id").agg(F.max_by(F.struct(*names[1:]), F.struct("batch_id", "version")).alias("s"))
    return newest.select("job_id", "s.*").withColumn(
        "ts", F.expr("timestampadd(MICROSECOND, ts_us, TIMESTAMP_NTZ'1970-01-01 00:00:00')")).drop("ts_us", "version")


def as_arrivals(events: DataFrame, folder: str, batches: int, key: str = "event_id") -> int:
    """Write a table as files that arrive in ``batches`` portions, whatever the order of its events; returns the files per portion.

    Portions are dealt by a hash of the key, so each of them holds events older than some that came before.
    """
    n = max(1, int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")) // batches)
    for i in range(batches):
        events.where(F.pmod(F.xxhash64(key), F.lit(batches)) == i).coalesce(n).write.mode("append").parquet(folder)
    return n
