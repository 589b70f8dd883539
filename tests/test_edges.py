"""Edge cases of operators that the driver's rows don't reach."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import encode, evaluate, ordered, profile, registry, sample, telemetry


def test_parse_logs_takes_any_bracket_text(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(1, "[worker-3] started", at), (2, "[2024-02-03 04:05:06] [Warn-2] hot", at), (3, "  ", at)]
    out = {r["line_no"]: r for r in telemetry.parse_logs(spark.createDataFrame(rows, "line_no int, line string, file_time timestamp_ntz")).collect()}
    assert out[1]["timestamp"] == at and out[1]["level"] == "INFO" and out[1]["message"] == "started"
    assert out[2]["level"] == "Warn-2" and out[2]["timestamp"] == dt.datetime(2024, 2, 3, 4, 5, 6) and 3 not in out


def test_null_class_is_a_class(spark):
    df = spark.range(200).select("id", F.when(F.col("id") % 4 == 0, None).otherwise((F.col("id") % 4).cast("string")).alias("c"))
    got = {r["c"]: r["n"] for r in sample.stratified_sample(df, "c", 10, ["id"]).groupBy("c").agg(F.count("*").alias("n")).collect()}
    assert got == {None: 5, "1": 5, "2": 5, "3": 5}
    parts = {(r["c"], r["split"]): r["n"] for r in sample.split_stratified(df, "c", ["id"]).groupBy("c", "split").agg(F.count("*").alias("n")).collect()}
    assert parts[None, "test"] == 10 and parts[None, "train"] == 40


def test_sample_of_a_tiny_share(spark):
    n = sample.sample_pct(spark.range(200_000), 0.004, ["id"]).count()
    assert 0 < n < 40


def test_integers_beyond_doubles_stay_distinct(spark):
    df = spark.createDataFrame([(2**53,), (2**53 + 1,), (2**53 + 1,)], "x long")
    row = profile.numeric_profile(df, ["x"]).first()
    assert row["unique_values"] == 2 and row["is_constant"] is False


def test_r2_with_a_large_mean(spark):
    rng = np.random.default_rng(0)
    y = 1e9 + rng.normal(0, 0.01, 500)
    p = y + rng.normal(0, 0.0003, 500)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p, strict=True)], "y_true double, y_pred double")
    want = 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert evaluate.regression_metrics(df).first()["r2"] == pytest.approx(want, abs=1e-4)


def test_autocorrelation_on_a_short_time_range(spark):
    rng = np.random.default_rng(1)
    v = np.cumsum(rng.integers(-5, 6, 2000)) + 1_700_000_000_000_000
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(v)], "i int, x long")
    got = ordered.lag1_autocorr(df, "x", ["i"], partitions=4).first()[0]
    assert got == pytest.approx(np.corrcoef(v[:-1] - v[0], v[1:] - v[0])[0, 1], abs=1e-9)


def test_scan_keeps_a_null_key_together(spark):
    df = spark.range(400).select(F.lit(None).cast("string").alias("k"), "id", F.lit(1).alias("one"))
    out = ordered.segmented_scan(df, ["k"], ["id"], {"n": ("rownum", "one")}, partitions=4)
    assert sorted(r["n"] for r in out.collect()) == list(range(1, 401))


def test_upsert_takes_the_last_update(spark):
    base = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "id string, name string, n int")
    new = spark.createDataFrame([("a", "p", 1), ("a", "o", 2)], "id string, name string, at int")
    got = sorted(tuple(r) for r in registry.upsert(base, new, order="at").collect())
    assert got == [("a", "o", 1), ("b", "y", 2)]


@pytest.mark.parametrize("buckets", [7, 32, 1000])
def test_hash_trick_uses_the_whole_digest(spark, buckets):
    import hashlib
    words = ["a", "bb", "c c", "", "é"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r[0] for r in df.select(encode.hash_trick(F.col("w"), buckets)).collect()]
    assert got == [int(hashlib.md5(w.encode()).hexdigest(), 16) % buckets for w in words]
