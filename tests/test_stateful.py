"""Keyed stream state against its batch twin: several micro-batches, late events, state that grows with the batch."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quarry.streaming import stateful
from quarry.streaming.streams import file_stream, run_available_now, stream_root

EVENTS = "job_id long, event_id long, stage int, event string, accuracy double, loss double, ts timestamp_ntz"


def events(n_jobs, n, seed):
    rng = random.Random(seed)
    t0 = dt.datetime(2024, 3, 10, 1, 0)  # the hours around a change of clocks in some zones
    return [(rng.randrange(n_jobs), i, rng.choice([1, 2, 3, None]), rng.choice(["start", "complete", "error"]), rng.choice([None, rng.random()]), rng.random(),
             t0 + dt.timedelta(seconds=rng.randrange(7200))) for i in range(n)]


def plain(rows):
    out = {}
    for job in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == job), key=lambda r: (r[6], r[1]))
        stages = {r[2]: r[3] for r in own if r[2] is not None}
        now = list(stages.values())
        out[job] = (*own[-1][1:], len(own), len(now), now.count("start"), now.count("complete"), "error" in now)
    return out


def states(spark, out):
    rows = stateful.current(spark, out).collect()
    names = ["event_id", "stage", "event", "accuracy", "loss", "ts", "events", "stages", "started", "completed", "failed"]
    assert len({r["job_id"] for r in rows}) == len(rows)
    return {r["job_id"]: tuple(r[c] for c in names) for r in rows}


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles"])
def test_micro_batches_with_late_events_equal_the_batch(spark, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = events(25, 600, 3)
        root = stream_root(spark, "test-states")
        df = spark.createDataFrame(rows, EVENTS)
        files = stateful.as_arrivals(df, f"{root}/arrivals", 3)
        out = stateful.run_job_states(file_stream(spark, f"{root}/arrivals", df.schema, max_files=files), root)
        batches = [r[0] for r in spark.read.parquet(out).select("batch_id").distinct().collect()]
        assert len(batches) >= 3 and states(spark, out) == plain(rows)
        # every portion holds events older than some that came before it
        first = df.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == 0).agg(F.max("ts")).first()[0]
        assert df.where((F.pmod(F.xxhash64("event_id"), F.lit(3)) == 1) & (F.col("ts") < F.lit(str(first)).cast("timestamp_ntz"))).count() > 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_state_written_grows_with_the_batch_and_survives_a_restart(spark):
    rows = events(200, 1000, 4)
    root = stream_root(spark, "test-restart")
    schema = spark.createDataFrame([], EVENTS).schema
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{root}/arrivals")
    stateful.run_job_states(file_stream(spark, f"{root}/arrivals", schema), root)
    late = [(7, 5000, 2, "error", None, 0.5, dt.datetime(2020, 1, 1)), (None, 5001, 1, "start", None, 0.1, dt.datetime(2025, 1, 1)),
            (500, 5002, 1, "start", None, 0.1, dt.datetime(2025, 1, 1))]
    spark.createDataFrame(late, EVENTS).coalesce(1).write.mode("append").parquet(f"{root}/arrivals")
    progress = []
    with stateful._rocksdb(spark):
        stream = stateful.job_states(file_stream(spark, f"{root}/arrivals", schema))
        q = (stream.writeStream.outputMode("update").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
             .foreachBatch(lambda b, i: stateful.write_batch(b, i, f"{root}/out")).start())
        q.awaitTermination()
        progress = [p for p in q.recentProgress if p["numInputRows"]]
    want = plain(rows + [late[0], late[2]])
    assert states(spark, f"{root}/out") == want and want[7][-1] == plain(rows)[7][-1]  # the late event is counted, newer ones stand
    updated = [sum(o["numRowsUpdated"] for o in p["stateOperators"]) for p in progress]
    assert len(progress) == 1 and 0 < updated[0] <= 4, updated  # two jobs' state, not two hundred
    assert spark.read.parquet(f"{root}/out/batch_id=1").count() == 2


def test_a_repeated_batch_changes_nothing(spark):
    rows = events(10, 80, 5)
    root = stream_root(spark, "test-repeat")
    spark.createDataFrame(rows, EVENTS).coalesce(2).write.parquet(f"{root}/arrivals")
    schema = spark.createDataFrame([], EVENTS).schema

    def twice(batch, batch_id, out):
        stateful.write_batch(batch, batch_id, out)
        stateful.write_batch(batch, batch_id, out)

    with stateful._rocksdb(spark):
        out = run_available_now(stateful.job_states(file_stream(spark, f"{root}/arrivals", schema, max_files=1)), root, mode="update", batch_fn=twice)
    assert states(spark, out) == plain(rows)
