"""Edge cases, reference quirks and scale properties, checked by hand or brute force."""

import hashlib
import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.functions import scalar as N
from quarry.operators import assoc as A
from quarry.operators import checks as H
from quarry.operators import clean as C
from quarry.operators import encode as E
from quarry.operators import evaluate as V
from quarry.operators import profile as P
from quarry.operators import registry as G
from quarry.operators import scores as K
from quarry.operators import telemetry as M
from quarry.operators.freq import exact_quantiles, numeric_frequency
from quarry.operators.ordered import lag1_autocorr, segmented_scan


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


# ---------------------------------------------------------------- profiling
def test_numeric_profile_edge_cases(spark):
    df = spark.createDataFrame(
        [(1, None, 5.0, 0.0, 1.0), (2, None, 5.0, 0.0, 2.0), (3, None, 5.0, 0.0, 3.0), (4, None, 5.0, 0.0, 100.0)],
        "id int, all_null double, const double, zero double, outl double")
    p = {r["column"]: r for r in P.numeric_profile(df, ["all_null", "const", "zero", "outl"]).collect()}
    assert p["all_null"]["mean"] is None and p["all_null"]["missing_percent"] == 100.0
    assert p["all_null"]["unique_values"] == 0 and p["all_null"]["outlier_percent"] is None
    assert p["const"]["std_dev"] == 0.0 and p["const"]["skewness"] is None and p["const"]["is_constant"]
    assert p["zero"]["coefficient_of_variation"] is None and p["zero"]["zero_percent"] == 100.0
    v = np.array([1.0, 2.0, 3.0, 100.0])
    q1, q3 = np.percentile(v, 25), np.percentile(v, 75)
    assert p["outl"]["q1"] == pytest.approx(q1) and p["outl"]["q3"] == pytest.approx(q3)
    assert p["outl"]["outlier_percent"] == pytest.approx(25.0)
    m, s = v.mean(), v.std()
    assert p["outl"]["skewness"] == pytest.approx(((v - m) ** 3).mean() / s ** 3)
    assert p["outl"]["kurtosis"] == pytest.approx(((v - m) ** 4).mean() / s ** 4 - 3)


def test_single_value_has_no_shape_moments(spark):
    df = spark.createDataFrame([(7.0,)], "x double")
    r = P.numeric_profile(df, ["x"]).first()
    assert r["skewness"] is None and r["kurtosis"] is None and r["std_dev"] is None


def test_exact_quantiles_match_numpy_across_partitionings(spark):
    rng = np.random.default_rng(3)
    vals = np.concatenate([rng.normal(size=500), np.full(300, 2.5), rng.integers(0, 5, 200).astype(float)])
    df = spark.createDataFrame(pd.DataFrame({"x": vals}))
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    for parts in (1, 3, 8):
        q = {r["p"]: r["q"] for r in exact_quantiles(numeric_frequency(df.repartition(parts), ["x"]), probs, partitions=parts).collect()}
        for p in probs:
            assert q[p] == pytest.approx(np.percentile(vals, p * 100), abs=1e-12)


def test_bool_constant_means_one_distinct_value_x1(spark):
    df = spark.createDataFrame([(True,), (False,), (True,), (False,)], "b boolean")
    assert P.bool_profile(df, ["b"]).first()["is_constant"] is False
    df2 = spark.createDataFrame([(True,), (True,), (None,)], "b boolean")
    assert P.bool_profile(df2, ["b"]).first()["is_constant"] is True


def test_binary_counts_null_once_x2(spark):
    df = spark.createDataFrame([(1.0,), (None,), (None,)], "x double")
    assert P.binary_columns(df).first()["is_binary"] is True
    df2 = spark.createDataFrame([("a",), ("b",), (None,)], "s string")
    assert P.binary_columns(df2).first()["is_binary"] is False


def test_categorical_entropy_counts_null_as_category(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "s string")
    r = P.categorical_profile(df, ["s"]).first()
    p = np.array([2, 1, 1]) / 4
    assert r["entropy"] == pytest.approx(-(p * np.log2(p)).sum())
    assert r["cardinality"] == 2 and r["top_values"] == "a:2|b:1|NULL:1"
    one = spark.createDataFrame([("a",), (None,)], "s string")
    assert P.categorical_profile(one, ["s"]).first()["entropy"] == 0.0


def test_lowercase_consistency(spark):
    df = spark.createDataFrame([("a",), ("A",), ("b",)], "s string")
    assert P.categorical_profile(df, ["s"]).first()["lowercase_consistent"] is False


def test_lag1_autocorr_matches_numpy_and_partitioning(spark):
    rng = np.random.default_rng(1)
    x = np.cumsum(rng.normal(size=400))
    df = spark.createDataFrame(pd.DataFrame({"o": np.arange(400), "x": x}))
    want = np.corrcoef(x[:-1], x[1:])[0, 1]
    for parts in (1, 5, 16):
        got = lag1_autocorr(df, "x", ["o"], partitions=parts).first()[0]
        assert got == pytest.approx(want, rel=1e-9)
    const = spark.createDataFrame([(i, 1.0) for i in range(5)], "o int, x double")
    assert lag1_autocorr(const, "x", ["o"]).first()[0] is None


# ---------------------------------------------------------------- ordered scans
def test_segmented_scan_hot_key_matches_pandas(spark):
    rng = np.random.default_rng(7)
    n = 3000
    key = np.where(rng.random(n) < 0.6, 0, rng.integers(1, 20, n))  # one key holds most rows
    v = np.where(rng.random(n) < 0.3, np.nan, rng.normal(size=n))
    pdf = pd.DataFrame({"k": key, "o": np.arange(n), "v": v})
    df = spark.createDataFrame(pdf).withColumn("v", F.when(F.isnan("v"), None).otherwise(F.col("v")))
    out = segmented_scan(df, ["k"], ["o"], {"ff": ("ffill", "v"), "bf": ("bfill", "v"), "mx": ("cummax", "v"),
                                            "mn": ("cummin", "v"), "rn": ("rownum", "v")}, partitions=8).toPandas()
    out = out.sort_values("o").reset_index(drop=True)
    g = pdf.sort_values("o").groupby("k")["v"]
    exp = pd.DataFrame({"ff": g.ffill(), "bf": g.bfill(), "mx": g.cummax().groupby(pdf["k"]).ffill(),
                        "mn": g.cummin().groupby(pdf["k"]).ffill(), "rn": g.cumcount() + 1})
    for c in ["ff", "bf", "mx", "mn"]:
        np.testing.assert_allclose(out[c].astype(float).to_numpy(), exp[c].astype(float).to_numpy(), equal_nan=True)
    assert (out["rn"].to_numpy() == exp["rn"].to_numpy()).all()


def test_ffill_leading_and_bfill_trailing_nulls_stay(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, None), (4, 7.0), (5, None)], "o int, v double")
    assert [r["v"] for r in C.ffill(df, ["v"], ["o"]).orderBy("o").collect()] == [None, 5.0, 5.0, 7.0, 7.0]
    assert [r["v"] for r in C.bfill(df, ["v"], ["o"]).orderBy("o").collect()] == [5.0, 5.0, 7.0, 7.0, None]


# ---------------------------------------------------------------- cleaning / encoding
def test_handle_null_dispatch(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "a"), (3.0, None)], "x double, s string")
    assert sorted(rows(C.handle_null(df, "mean"), "x")) == [(1.0,), (2.0,), (3.0,)]
    assert C.handle_null(df, "drop").count() == 1
    assert rows(C.handle_null(df, "mode").filter(F.col("x") == 3.0), "s") == [("a",)]
    with pytest.raises(ValueError):
        C.handle_null(df, "median-ish")
    with pytest.raises(ValueError):
        C.handle_null(df, "constant")
    clean = spark.createDataFrame([(1.0,)], "x double")
    assert C.handle_null(clean, "mean") is clean


def test_fill_mode_smallest_on_tie(spark):
    df = spark.createDataFrame([(2.0,), (1.0,), (None,)], "x double")
    assert sorted(rows(C.fill_mode(df), "x")) == [(1.0,), (1.0,), (2.0,)]


def test_nan_inf_to_null_nested(spark):
    df = spark.createDataFrame([(float("nan"), [1.0, float("inf")])], "x double, a array<double>")
    r = C.nan_inf_to_null(df).first()
    assert r["x"] is None and r["a"] == [1.0, None]


def test_hash_trick_matches_python_md5_x6(spark):
    words = ["alpha", "beta", "", "Ünïcode", "nan"]
    df = spark.createDataFrame([(w,) for w in words] + [(None,)], "s string")
    got = [r[0] for r in df.select(E.hash_trick(F.col("s"))).collect()]
    want = [int(hashlib.md5(w.encode()).hexdigest(), 16) % 32 for w in words] + [int(hashlib.md5(b"nan").hexdigest(), 16) % 32]
    assert got == want


def test_one_hot_names_and_null_row(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "x string")
    out = df.select(*E.one_hot_columns(F.col("x"), "x", ["a", "b", "c"]))
    assert out.columns == ["x___b", "x___c"]
    assert sorted(rows(out, "x___b", "x___c")) == [(0, 0), (0, 0), (0, 1), (1, 0)]


def test_int_downcast_and_cascade(spark):
    assert E.smallest_int_type(0, 255) == "smallint" and E.smallest_int_type(-1, 100) == "tinyint"
    assert E.smallest_int_type(0, 2 ** 31) == "bigint"
    df = spark.createDataFrame([(i, float(i) * 1.5, "x" if i % 2 else "y", True, f"n{i}") for i in range(20)],
                               "id int, val double, flag string, ok boolean, user_name string")
    out, rep = E.auto_cast_and_encode(df)
    actions = {r["column"]: r["action"] for r in rep.collect()}
    assert actions == {"id": "safe_cast", "val": "drop", "flag": "binary_encode", "ok": "cast_to_uint8",
                       "user_name": "one_hot_encode"}  # X8: the PII rule never sees strings by default
    _, rep2 = E.auto_cast_and_encode(df, pii_first=True)
    assert {r["column"]: r["action"] for r in rep2.collect()}["user_name"] == "drop"


def test_constant_integers_survive_x9(spark):
    df = spark.createDataFrame([(5,), (5,)], "c int")
    assert E.plan_encoding(df)[0]["action"] == "safe_cast"


# ---------------------------------------------------------------- association
def test_histogram_mi_independent_and_identical(spark):
    df = spark.createDataFrame([(a, b) for a in "xy" for b in "uv" for _ in range(5)], "a string, b string")
    assert A.histogram_mi(df, "a", "b").first()[0] == pytest.approx(0.0, abs=1e-12)
    same = spark.createDataFrame([("x", "x"), ("y", "y")] * 4, "a string, b string")
    assert A.histogram_mi(same, "a", "b").first()[0] == pytest.approx(1.0)


def test_pearson_matrix_symmetric_and_bounded(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=200)
    pdf = pd.DataFrame({"a": x, "b": 2 * x + rng.normal(size=200) * 0.1, "c": np.ones(200)})
    df = spark.createDataFrame(pdf)
    m = {(r["col_a"], r["col_b"]): r["corr"] for r in A.pearson_mean_imputed(df, ["a", "b", "c"]).collect()}
    assert m[("a", "b")] == m[("b", "a")] and -1 <= m[("a", "b")] <= 1
    assert m[("c", "c")] == 0.0 and m[("a", "a")] == 1.0
    assert m[("a", "b")] == pytest.approx(np.corrcoef(pdf.a, pdf.b)[0, 1], abs=1e-4)


def test_pcc_sketch_close_to_exact(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=4000)
    pdf = pd.DataFrame({"id": np.arange(4000), "a": x, "b": x + rng.normal(size=4000) * 0.5, "c": rng.normal(size=4000)})
    df = spark.createDataFrame(pdf)
    sk = {(r["col_a"], r["col_b"]): r["corr"] for r in A.pcc_sketch(df, ["a", "b", "c"], id_col="id").collect()}
    ex = np.corrcoef(pdf.a, pdf.b)[0, 1]
    assert abs(sk[("a", "b")] - ex) < 0.15
    assert abs(sk[("a", "c")]) < 0.15


def test_quantile_binning_right_side_and_dedup(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 1, 1, 1, 2, 3, 4, 5]], "x double")
    out = sorted(r[0] for r in A.quantile_binning(df, "x", 4).select("x_bin").collect())
    edges = np.percentile([1, 1, 1, 1, 2, 3, 4, 5], [0, 25, 50, 75, 100])
    keep = edges[np.concatenate([[True], np.diff(edges) > 1e-8])]
    want = sorted(np.searchsorted(keep[1:-1], [1, 1, 1, 1, 2, 3, 4, 5], side="right").tolist())
    assert out == want


# ---------------------------------------------------------------- evaluation
def test_roc_auc_with_ties_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 300)
    s = np.round(rng.random(300), 1)
    df = spark.createDataFrame(pd.DataFrame({"y_true": y.astype(str), "score": s}))
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert V.roc_auc(df).first()[0] == pytest.approx(want)


def test_macro_counts_absent_class_as_zero(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a")], "y_true string, y_pred string")
    classes = spark.createDataFrame([("a",), ("b",), ("c",)], "class string")
    prf = V.per_class_prf(df, classes=classes)
    r = V.macro_prf(prf, num_classes=3).first()
    assert r["macro_recall"] == pytest.approx((1.0 + 0.0 + 0.0) / 3)
    empty = spark.createDataFrame([], "y_true string, y_pred string")
    assert V.accuracy(empty).first()["accuracy"] == 0.0


# ---------------------------------------------------------------- tasks / registry / telemetry
GOLDEN = [  # name, domain, n_classes, annotations, description, expected
    ("MNIST Handwritten Digits", "vision", 10, False, None, "classification"),
    ("House Prices Prediction", "tabular", None, False, None, "regression"),
    ("Face Detection Dataset", "vision", None, True, None, "detection"),
    ("Credit Risk Assessment", "tabular", 2, False, None, "classification"),
    ("Flower Classification", "vision", 4, False, None, "classification"),
    ("Stock Price Forecast", "tabular", None, False, "Predict future stock prices", "regression"),
]


def test_task_inference_golden_table(spark):
    df = spark.createDataFrame([g[:5] for g in GOLDEN], "name string, domain string, n_classes int, ann boolean, description string")
    t = df.select(H.task_from_metadata(F.col("name"), F.col("domain"), F.col("description"), F.col("n_classes"),
                                       F.col("ann"), F.lit(False), F.lit(False)).alias("t"))
    assert [r["t"] for r in t.collect()] == [g[5] for g in GOLDEN]


def test_substring_keyword_quirk_x21(spark):
    df = spark.createDataFrame([("image category",)], "name string")
    t = df.select(H.task_from_metadata(F.col("name"), F.lit("tabular"), F.lit(None), F.lit(None),
                                       F.lit(False), F.lit(False), F.lit(False))).first()[0]
    assert t == "classification"  # 'cat' inside 'category' hits before 'age' inside 'image'


DURATIONS = [(0, "0s", "0s", "N/A"), (59, "59s", "59s", "59s"), (60, "1m 0s", "1m 0s", "1m 0s"),
             (3600, "1h 0m 0s", "1h 0m", "1h 0m 0s"), (5405, "1h 30m 5s", "1h 30m", "1h 30m 5s"), (None, None, None, "N/A")]


def test_format_and_parse_duration(spark):
    df = spark.createDataFrame([(d[0],) for d in DURATIONS], "s long")
    out = df.select(N.format_duration(F.col("s")).alias("l"), N.format_duration(F.col("s"), "short").alias("sh"),
                    N.format_duration_ui(F.col("s")).alias("ui"),
                    N.parse_duration(N.format_duration(F.col("s"))).alias("back")).collect()
    for d, r in zip(DURATIONS, out):
        assert (r["l"], r["sh"], r["ui"]) == d[1:]
        if d[0] is not None:
            assert r["back"] == d[0]


def test_parse_logs_variants(spark):
    lines = spark.createDataFrame([(1, "[2024-01-01 10:00:00] [error] boom", "2024-02-02 00:00:00"),
                                   (2, "[2024-01-01 10:00:01] no level", "2024-02-02 00:00:00"),
                                   (3, "plain text", "2024-02-02 00:00:00"), (4, "   ", "2024-02-02 00:00:00")],
                                  "line_no int, line string, file_time string").withColumn("file_time", F.col("file_time").cast("timestamp_ntz"))
    out = {r["line_no"]: r for r in M.parse_logs(lines).collect()}
    assert set(out) == {1, 2, 3}
    assert out[1]["level"] == "error" and out[1]["message"] == "boom"  # the text of the bracket as it is
    assert out[2]["level"] == "INFO" and out[2]["message"] == "no level"
    assert out[3]["level"] == "INFO" and str(out[3]["timestamp"]) == "2024-02-02 00:00:00"


def test_best_epoch_ties_and_nulls(spark):
    df = spark.createDataFrame([("r", 0, 0.5, 0.1, 0.1, 0.1), ("r", 1, 0.9, 0.2, 0.2, 0.2), ("r", 2, 0.9, 0.3, 0.3, 0.3),
                                ("r", 3, None, 0.4, 0.4, 0.4), ("z", 0, None, 0.0, 0.0, 0.0)],
                               "run_id string, iteration int, accuracy double, precision double, recall double, f1_score double")
    out = {r["run_id"]: r for r in G.best_epoch(df).collect()}
    assert out["r"]["iteration"] == 1 and "z" not in out


def test_normalize_metric_legacy_x10(spark):
    df = spark.createDataFrame([(0.005,), (1.0,), (84.3,)], "v double").select(F.create_map(F.lit("acc"), F.col("v")).alias("m"))
    new = [r[0] for r in df.select(M.normalize_metric(F.col("m"), ["accuracy", "acc"])).collect()]
    old = [r[0] for r in df.select(M.normalize_metric(F.col("m"), ["accuracy", "acc"], legacy=True)).collect()]
    assert new == pytest.approx([0.005, 1.0, 0.843]) and old == pytest.approx([0.5, 1.0, 0.843])


def test_composite_and_best_run_edges(spark):
    w = spark.createDataFrame([("d", 1, 0.8, None, None, None), ("d", 2, 0.8, None, None, None),
                               ("d", 3, None, None, None, 0.5), ("e", 4, None, None, None, None)],
                              "dataset string, run_id long, accuracy double, auc double, f1 double, rmse double")
    out = {r["dataset"]: r for r in K.best_run(w).collect()}
    assert out["d"]["run_id"] == 1 and "e" not in out  # tie -> lowest id; RMSE-only/no metrics -> no score


def test_pending_job_triage_rules(spark):
    jobs = spark.createDataFrame([("j1", "pending", 3, 3, "automl", "d1", "/p"), ("j2", "queued", 0, 3, "training", "dx", "/p"),
                                  ("j3", "pending", 0, 3, "automl", "d1", None), ("j4", "pending", 1, 3, "training", "d1", None)],
                                 "id string, status string, attempts int, max_attempts int, job_type string, dataset_id string, dataset_path string")
    ds = spark.createDataFrame([("d1",)], "id string")
    out = {r["id"]: (r["decision"], r["attempts_after"]) for r in G.pending_job_triage(jobs, ds).collect()}
    assert out == {"j1": ("fail", 3), "j2": ("skip_missing_dataset", 0), "j3": ("skip_no_path", 0), "j4": ("submit", 2)}


def test_upsert_rejects_unknown_fields(spark):
    base = spark.createDataFrame([("a", "x", 1)], "id string, status string, n int")
    with pytest.raises(ValueError):
        G.upsert(base, spark.createDataFrame([("a", "y")], "id string, error_message string"))
    out = G.upsert(base, spark.createDataFrame([("a", None)], "id string, status string")).first()
    assert out["status"] == "x"


def test_hyperparameter_schedule_choices(spark):
    from quarry.operators.automl import SCHEDULE, hyperparam_schedule
    df = spark.createDataFrame([(0, 0.9), (3, 0.4), (3, 0.7), (3, 0.85)], "it int, best double")
    out = df.select(hyperparam_schedule(F.col("it"), F.col("best"), F.lit("run")).alias("s")).collect()
    assert [r["s"]["tier"] for r in out] == ["base", "base", "explore", "refine"]
    for r in out:
        assert r["s"]["lr"] in SCHEDULE[r["s"]["tier"]]["lr"]


def test_mask_secret(spark):
    df = spark.createDataFrame([("short",), ("sk-1234567890abcdef",)], "s string")
    assert [r[0] for r in df.select(N.mask_secret(F.col("s"))).collect()] == ["***", "sk-12345...cdef"]
    u = spark.createDataFrame([("postgresql://bob:pw@host:5432/db",)], "u string")
    assert u.select(N.mask_url_password(F.col("u"))).first()[0] == "postgresql://bob:***@host:5432/db"


def test_segmented_scan_carries_state_across_arrow_batches(spark):
    prev = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        test_segmented_scan_hot_key_matches_pandas(spark)
        df = spark.createDataFrame([(i % 3, i, None if i % 4 else float(i)) for i in range(300)], "k int, o int, v double")
        out = C.bfill(df, ["v"], ["o"], keys=["k"]).toPandas().sort_values("o")
        pdf = df.toPandas().sort_values("o")
        exp = pdf.groupby("k")["v"].bfill()
        np.testing.assert_allclose(out["v"].astype(float), exp.astype(float), equal_nan=True)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", prev)


def test_column_set_compare_b13():
    r = H.column_set_compare(["a", "b"], ["b", "a"])
    assert not r["equal"] and r["same_set"]


def test_guess_target_column_h13():
    assert H.guess_target_column(["x", "Label", "z"]) == "Label"
    assert H.guess_target_column(["x", "y2", "z"]) == "z"


def test_validate_tabular_h3(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "tab")
    os.makedirs(d)
    rows = "\n".join(f"{i},{i % 2}" for i in range(60))
    for n in ("train.csv", "test.csv"):
        with open(os.path.join(d, n), "w") as f:
            f.write("a,b\n" + rows + "\n")
    assert H.validate_tabular(spark, d, "classification").first()["valid"]
    d2 = os.path.join(tmpdir_path, "single")
    os.makedirs(d2)
    with open(os.path.join(d2, "data.csv"), "w") as f:
        f.write("a,b\n" + rows + "\n")
    r = H.validate_tabular(spark, d2, "classification").first()
    assert r["mode"] == "auto_split" and r["train_rows"] == 48
    empty = os.path.join(tmpdir_path, "tab_empty")
    os.makedirs(os.path.join(empty, "sub"))
    with open(os.path.join(empty, "notes.txt"), "w") as f:
        f.write("no data here")
    with pytest.raises(ValueError):
        H.validate_tabular(spark, empty)


def test_model_families_j2():
    from quarry.operators.automl import make_estimator
    for code in ("CAT", "XGB", "XT", "KNN"):
        with pytest.raises(ValueError):
            make_estimator(code, "binary")
    assert make_estimator("RF", "regression").__class__.__name__ == "RandomForestRegressor"
    assert make_estimator("GBM", "multiclass", n_classes=3).__class__.__name__ == "OneVsRest"


def test_complete_profile_parts(spark):
    df = spark.createDataFrame([(float(i), float(i % 7), float(i % 3), "a" if i % 2 else "b") for i in range(60)],
                               "x double, y double, z double, t string")
    parts = P.complete_profile(df, "t")
    assert set(parts) == {"features", "target", "correlation", "mutual_information"}
    assert parts["target"].first()["num_classes"] == 2
    assert parts["mutual_information"].count() == 3


def test_schema_evolution_and_migration(spark):
    df = spark.createDataFrame([("m1",)], "id string")
    out = G.add_metric_columns(df, {"precision": "double", "recall": "double"})
    assert out.columns == ["id", "precision", "recall"]
    raw = spark.createDataFrame([(1, "ds", "Vision", None, "/p", None, 12)],
                                "id int, name string, domain string, readiness string, path string, total_samples int, size int")
    r = G.migrate_datasets(raw).first()
    assert (r["domain"], r["readiness"], r["file_path"], r["total_samples"]) == ("vision", "draft", "/p", 12)


def test_ntz_arithmetic_is_time_zone_free(spark):
    prev = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:  # 02:08:23 does not exist in Los Angeles on 2001-04-01 (DST start)
        df = spark.createDataFrame([("2001-04-01 02:08:23", "2001-04-01 03:49:01")], "a string, b string").select(
            F.col("a").cast("timestamp_ntz").alias("a"), F.col("b").cast("timestamp_ntz").alias("b"))
        r = df.select(N.seconds_between(F.col("a"), F.col("b")).alias("s"), N.epoch_micros(F.col("a")).alias("us")).first()
        assert r["s"] == 6038 and r["us"] == 986090903000000
    finally:
        spark.conf.set("spark.sql.session.timeZone", prev)


def test_ranks_over_many_small_batches_and_partitions(spark):
    from quarry.operators.freq import ranked_frequency
    rows = [(c, v, 1 + (v * 7) % 3) for c in ("a", "b", "c") for v in range(40)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = ranked_frequency(spark.createDataFrame(rows, "column string, value long, n long"), partitions=4).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(got) == len(rows)
    for r in got:
        before = sum(n for c, v, n in rows if c == r["column"] and v < r["value"])
        assert (r["rank_lo"], r["rank_hi"]) == (before, before + r["n"])
        assert r["total"] == sum(n for c, _, n in rows if c == r["column"])


@pytest.mark.parametrize("small_rows", [100_000, 0])
def test_stratified_sample_of_many_classes_with_and_without_broadcast(spark, monkeypatch, small_rows):
    from quarry.operators import freq, sample
    monkeypatch.setattr(freq, "SMALL_ROWS", small_rows)
    df = spark.range(600).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN NULL ELSE CAST(id % 40 AS string) END AS c")
    sizes = {r["c"]: r["n"] for r in df.groupBy("c").count().withColumnRenamed("count", "n").collect()}
    got = {r["c"]: r["n"] for r in sample.stratified_sample(df, "c", 10, ["id"]).groupBy("c").count().withColumnRenamed("count", "n").collect()}
    assert got == {c: -(-n // 10) for c, n in sizes.items()}
