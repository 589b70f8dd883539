"""Extension surface, dictionary codes, bounded category lists and the benchmark loop."""

import datetime as dt
import random
import resource

import pytest
from pyspark.ml.classification import NaiveBayes
from pyspark.sql import functions as F

from quarry.operators import automl as J
from quarry.operators import encode as E
from quarry.operators import extend as X
from quarry.operators import telemetry as M


def test_stage_events_feed_durations_and_states(spark, tmpdir_path):
    now = [dt.datetime(2024, 5, 1)]

    def clock():
        now[0] += dt.timedelta(seconds=5)
        return now[0]

    log = X.StageEvents(spark, f"{tmpdir_path}/events", 7, every=2, clock=clock)
    with log.stage("load"):
        with log.stage("parse"):
            pass
    with pytest.raises(ZeroDivisionError), log.stage("fit"):
        1 / 0
    with pytest.raises(ValueError, match="unknown status"):
        log("fit", "paused")
    other = X.StageEvents(spark, f"{tmpdir_path}/events", 8, clock=clock)
    other("load", "start")
    other.flush()
    rows = log.table()
    mine = rows.where("job_id = 7").orderBy("event_id").collect()
    assert [(r["event_id"], r["stage"], r["name"], r["event"]) for r in mine] == [
        (1, 1, "load", "start"), (2, 2, "parse", "start"), (3, 2, "parse", "complete"), (4, 1, "load", "complete"), (5, 3, "fit", "start"), (6, 3, "fit", "error")]
    assert mine[-1]["message"] == "division by zero"
    seconds = {(r["job_id"], r["stage"]): r["seconds"] for r in M.stage_durations(rows).collect()}
    assert seconds[7, 1] == 15 and seconds[7, 2] == 5 and seconds[7, 3] is None
    states = {(r["job_id"], r["stage"]): r["status"] for r in M.stage_state(rows).collect()}
    assert states == {(7, 1): "completed", (7, 2): "completed", (7, 3): "failed", (8, 1): "running"}
    assert [tuple(r) for r in M.failure_summary(rows, message="message").collect()] == [(7, 3, 2, "division by zero")]


def test_registered_metrics_join_every_profile(spark):
    df = spark.createDataFrame([(1, "ab", None), (5, None, 2.0)], "n int, t string, x double")
    X.METRICS.clear()
    assert X.metric_profile(df).count() == 0
    X.register_metric("spread", lambda c: F.max(c) - F.min(c))
    X.register_metric("filled", lambda c: F.count(c), ("numeric", "categorical"))
    got = {(r["column"], r["metric"]): r["value"] for r in X.metric_profile(df).collect()}
    assert got == {("n", "spread"): 4, ("x", "spread"): 0, ("n", "filled"): 2, ("t", "filled"): 1, ("x", "filled"): 1}
    assert X.metric_profile(df, cols=["t"]).collect()[0]["value"] == 1
    with pytest.raises(ValueError, match="unknown column kinds"):
        X.register_metric("bad", F.max, ("number",))
    X.METRICS.clear()


def small(spark, n=240):
    rng = random.Random(1)
    rows = [(i, rng.gauss(0, 1), rng.choice("uvw"), f"name {rng.randrange(90)}", rng.choice(["g1", "g2", "g3"])) for i in range(n)]
    return spark.createDataFrame([(*r, "yes" if r[1] > 0 else "no") for r in rows], "id long, a double, c string, wide string, grp string, y string")


def test_own_estimator_and_events(spark, tmpdir_path):
    df = small(spark).withColumn("a", F.abs("a")).drop("grp")
    log = X.StageEvents(spark, f"{tmpdir_path}/events", 1)
    models, board, _ = J.automl_fit(df, "y", "binary", families=("LR",), id_cols=["id"], estimators={"mine": NaiveBayes()}, on_event=log)
    assert {r["model"] for r in board.collect()} == {"LR", "mine"} and set(models) == {"LR", "mine"}
    assert [(r["name"], r["event"]) for r in log.table().orderBy("event_id").collect()] == [
        (s, e) for s in ("split", "fit_LR", "fit_mine") for e in ("start", "complete")]


def test_category_lists_are_bounded(spark):
    df = small(spark)
    assert E.categories(df, "c") == ["u", "v", "w"]
    with pytest.raises(ValueError, match="more than 50"):
        E.categories(df, "wide")
    stages, assembled = J.feature_pipeline(df, "y", "binary")
    assert "wide__hash" in assembled and "c__oh" in assembled and "wide__oh" not in assembled
    indexed = [s for s in stages if s.hasParam("inputCols") and s.isSet("inputCols") and "wide" in s.getInputCols()]
    assert [type(s).__name__ for s in indexed] == ["FeatureHasher"]


def test_dictionary_of_a_million_values(spark):
    """Codes are the order of the values; nothing of them passes through the driver."""
    n = 1_000_000
    df = spark.range(n).select(F.when(F.col("id") > 5, F.format_string("%07d", F.pmod(F.col("id") * 7919, F.lit(n)))).alias("v"))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    coded = E.target_encode_label(df, "v")
    row = coded.agg(F.count("v_label").alias("n"), F.count_distinct("v_label").alias("d"), F.max("v_label").alias("top"), F.count(F.lit(1)).alias("rows")).first()
    assert row["n"] == row["d"] == n - 6 and row["top"] == n - 7 and row["rows"] == n
    pairs = coded.where("v is not null").select(F.corr(F.col("v").cast("double"), F.col("v_label").cast("double"))).first()[0]
    assert pairs == pytest.approx(1, abs=1e-9)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000  # KB


def test_label_codes_of_small_and_odd_columns(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("b",), ("é",), ("",)], "t string")
    got = sorted((r["t"], r["t_label"]) for r in E.target_encode_label(df, "t").collect() if r["t"] is not None)
    assert got == [("", 0), ("a", 1), ("b", 2), ("b", 2), ("é", 3)]
    assert E.target_encode_label(df, "t").where("t is null").first()["t_label"] is None
    assert E.target_encode_label(df.limit(0), "t").count() == 0


def test_benchmark_loop_reports_failures_and_goes_on(spark):
    df = small(spark).drop("wide")

    def run(rows):
        if rows.where("id = 0").count():
            raise RuntimeError("broken set\nwith a second line")
        _, board, _ = J.automl_fit(rows, "y", "binary", families=("LR",), id_cols=["id"])
        return board

    out = {r["grp"]: r for r in J.benchmark_loop(df, "grp", run, workers=2).collect()}
    broken = df.where("id = 0").first()["grp"]
    assert set(out) == {"g1", "g2", "g3"} and out[broken]["status"] == "failed" and out[broken]["error"] == "broken set"
    assert all(r["status"] == "completed" and 0.5 < r["score_test"] <= 1 for g, r in out.items() if g != broken)
    named = {r["grp"]: r["status"] for r in J.benchmark_loop(df, "grp", lambda rows: rows.sparkSession.createDataFrame([("m", 1.0)], "model string, score_test double"), names=["g2", "g9"]).collect()}
    assert named == {"g2": "completed", "g9": "failed"}
    with pytest.raises(ValueError, match="more than 2 groups"):
        J.benchmark_loop(df, "grp", run, max_groups=2)
