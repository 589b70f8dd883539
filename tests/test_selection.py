"""Radix selection, blocked Gram matrix and mergeable sketches against numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import assoc, freq, profile, radix, sketches

SPECIAL = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 1.7976931348623157e308, -1.7976931348623157e308, math.inf, -math.inf, 2**53 + 2.0, 1e-300, 0.1, 0.30000000000000004]


def test_ordered_bits_keep_order_and_round_trip():
    rng = np.random.default_rng(1)
    x = np.concatenate([SPECIAL, rng.normal(size=500), rng.integers(-2**62, 2**62, 500).view(np.float64)])
    x = x[~np.isnan(x)]
    key = radix.ordered_bits(x.copy())
    by = np.argsort(x, kind="stable")
    assert (np.diff(key[by].astype(object)) >= 0).all() and ((np.diff(x[by]) == 0) == (np.diff(key[by].astype(object)) == 0)).all()
    assert [radix.from_bits(int(k)) for k in key] == [v + 0.0 for v in x.tolist()]
    assert radix.ordered_bits(np.array([np.nan]))[0] > radix.ordered_bits(np.array([math.inf]))[0]


@pytest.fixture()
def all_ways(monkeypatch):
    """Sets how many keys a task holds and how many rows may be collected, so that every way through the passes is taken."""
    def way(held, small, driver=200_000):
        monkeypatch.setattr(radix, "HELD_KEYS", held)
        monkeypatch.setattr(radix, "SMALL_ROWS", small)
        monkeypatch.setattr(radix, "DRIVER_ROWS", driver)
    return way


@pytest.mark.parametrize("held,small,driver", [(4096, 50_000, 200_000), (4096, 50_000, 0), (2, 50_000, 0), (2, 40, 200_000), (2, 40, 0), (2, 0, 200_000)])
def test_quantiles_equal_numpy(spark, all_ways, held, small, driver):
    all_ways(held, small, driver)
    rng = random.Random(held + small)
    cols = {"few": [rng.choice([1.0, 2.0, 2.0, None]) for _ in range(700)], "wide": [rng.gauss(0, 1e6) if rng.random() > 0.1 else None for _ in range(700)],
            "odd": [rng.choice(SPECIAL[:8] + SPECIAL[10:]) for _ in range(700)], "none": [None] * 700, "same": [7.25] * 700,
            "close": [1 + k * 2**-52 for k in range(700)]}
    df = spark.createDataFrame(list(zip(*cols.values(), strict=True)), ", ".join(f"{c} double" for c in cols)).repartition(5)
    probs = [0, 0.1, 0.25, 0.5, 0.731, 1.0]
    got = radix.quantiles(df, list(cols), probs)
    for c, values in cols.items():
        values = np.array([v for v in values if v is not None])
        for p in probs:
            if not len(values):
                assert got[c][p] is None
            else:
                with np.errstate(over="ignore", invalid="ignore"):
                    h = (len(values) - 1) * p
                    lo, hi = np.sort(values)[[math.floor(h), math.ceil(h)]]
                    want = lo if lo == hi else lo + (h - math.floor(h)) * (hi - lo)
                assert got[c][p] == want or (math.isnan(got[c][p]) and math.isnan(want)), (c, p)


def test_ranks_count_duplicates_and_leave_out_what_is_not_there(spark, all_ways):
    all_ways(2, 0)
    df = spark.createDataFrame([(float(v),) for v in [3, 1, 2, 2, 2, 9]], "v double")
    n, at = radix.select_ranks(df, ["v"], lambda c, n: [-1, 0, 1, 3, 4, 5, n])["v"]
    assert n == 6 and at == {0: 1.0, 1: 2.0, 3: 2.0, 4: 3.0, 5: 9.0}
    assert radix.select_ranks(df.where("v > 100"), ["v"], lambda c, n: [0]) == {"v": (0, {})}


def test_many_columns_share_the_passes(spark):
    df = spark.range(200).select(*[(F.col("id") * (i + 1) % 97).alias(f"c{i}") for i in range(70)])
    got = radix.quantiles(df, df.columns, [0.5])
    for i in (0, 63, 64, 69):
        assert got[f"c{i}"][0.5] == np.median(np.arange(200) * (i + 1) % 97)


def exchanges(spark, run):
    """Text of the plans of everything that ``run`` executes, eagerly run parts included."""
    plans = []
    store = spark._jsparkSession.sharedState().statusStore()
    seen = store.executionsCount()
    run()
    todo = store.executionsList(int(seen), 10_000)
    for i in range(todo.size()):
        plans.append(todo.apply(i).physicalPlanDescription())
    return plans


@pytest.mark.parametrize("name", ["fill_median", "quantile_binning", "profile_numeric", "numeric_mi"])
def test_no_range_exchange_in_eager_or_final_plans(spark, name):
    import __spark_entry__ as entry
    plans = exchanges(spark, lambda: entry.queries()[name](spark, "/root/testdata/sf0.001").collect())
    assert len(plans) > 1 and any("MapInArrow" in p for p in plans)
    for p in plans:
        assert "rangepartitioning" not in p


def test_distinct_counts_are_exact_by_type(spark):
    rows = [(2**53, 0.0, None), (2**53 + 1, -0.0, 1), (2**53 + 1, 1.5, 1), (None, None, 2)]
    df = spark.createDataFrame(rows, "a long, b double, c int").withColumn("d", F.col("a").cast("decimal(38,0)") * 100)
    assert {r["column"]: r["unique_values"] for r in freq.distinct_counts(df, df.columns).collect()} == {"a": 2, "b": 2, "c": 2, "d": 2}


def test_distinct_counts_of_few_columns_are_grouped_by_number(spark):
    df = spark.createDataFrame([(1, 0.5, None), (1, -0.0, None), (2, 0.0, None)], "a long, b double, c int")
    got = freq.distinct_counts(df, df.columns)
    assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()
    wide = df.select("*", *[F.col("a").alias(f"w{i}") for i in range(freq.NARROW)])
    assert sorted(map(tuple, got.collect())) == [("a", 2), ("b", 2)]
    assert sorted(map(tuple, freq.distinct_counts(wide, wide.columns).collect()))[:2] == [("a", 2), ("b", 2)]


def test_profile_edges(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 1.0)], "a double, b double")
    rows = {r["column"]: r for r in profile.numeric_profile(df).collect()}
    assert rows["a"]["median"] is None and rows["a"]["unique_values"] == 0 and rows["a"]["missing_percent"] == 100 and rows["a"]["outlier_percent"] is None
    assert rows["b"]["q1"] == 1.0 and rows["b"]["is_constant"] and rows["b"]["outlier_percent"] == 0


@pytest.mark.parametrize("block", [1, 3, 64])
def test_gram_equals_numpy(spark, block):
    rng = np.random.default_rng(block)
    x = rng.normal(size=(300, 7))
    rows = [[None if v > 1.5 else float(v) for v in r] for r in x]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(7))).repartition(6)
    g = np.zeros((7, 7))
    for r in assoc.gram(df, df.columns, block).collect():
        assert r["i"] <= r["j"]
        g[r["i"], r["j"]] = g[r["j"], r["i"]] = r["v"]
    z = np.where(x > 1.5, 0, x)
    assert np.allclose(g, z.T @ z)
    assert all(v == 0 for _, _, v in assoc.gram(df.limit(0), df.columns, block).collect())


def test_pearson_of_500_columns(spark):
    """A plan with one expression per column; p squared of them would not compile."""
    cols = [f"c{i}" for i in range(500)]
    rows = np.random.default_rng(0).normal(size=(400, 498)).tolist()
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols[:-2])).select("*", F.lit(None).cast("double").alias(cols[-2]), F.lit(3.0).alias(cols[-1]))
    out = assoc.pearson_mean_imputed(df, cols, digits=6)
    x = np.array(df.select(*cols[:-2]).collect())
    want = np.corrcoef(x.T)
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in out.collect()}
    assert len(got) == 250_000
    for a, b in ((0, 0), (3, 497), (497, 3), (100, 250)):
        assert got[cols[a], cols[b]] == pytest.approx(want[a, b], abs=1e-5)
    assert got[cols[-1], cols[-1]] == 0 and got[cols[-2], cols[0]] == 0


def test_merged_sketches_keep_their_error(spark):
    rng = np.random.default_rng(8)
    rows = [(int(d), float(v) if v < 3 else None, float(d)) for d, v in zip(rng.integers(0, 30, 20_000), rng.exponential(size=20_000), strict=True)]
    df = spark.createDataFrame([*rows, (99, None, None)], "day int, x double, y double")
    daily = sketches.sketch_table(df, ["x", "y"], ["day"])
    assert daily.count() == 62
    probs = {"p1": 0.01, "median": 0.5, "p99": 0.99}
    prof = sketches.sketch_profile(sketches.merge_sketches(daily), probs)
    by = {r["column"]: r for r in prof.collect()}
    x = np.array([v for _, v, _ in rows if v is not None])
    assert by["x"]["rows"] == 20_001 and by["x"]["n"] == len(x) and by["x"]["mean"] == pytest.approx(x.mean()) and by["x"]["max"] == x.max()
    assert abs(by["x"]["unique_values"] / len(set(x)) - 1) < sketches.distinct_error() and abs(by["y"]["unique_values"] - 30) <= 1
    for name, p in probs.items():
        assert abs((x < by["x"][name]).mean() - p) < sketches.rank_error() + 1e-4
    checked = sketches.rank_check(df, prof, probs).collect()
    assert len(checked) == 6 and all(r["within"] for r in checked)
    empty = sketches.sketch_profile(sketches.merge_sketches(daily.where("day = 99")), probs).collect()
    assert all(r["median"] is None and r["n"] == 0 and r["unique_values"] == 0 for r in empty)


def test_digest_counts_equal_plain_counts(spark):
    """Texts that share a long head, tie in count, differ in case only, and nulls."""
    rng = random.Random(6)
    head = "x" * 60
    texts = [None, "", "a", "A", head + "a", head + "b", head + "B", "é" * 30, "z" * 5000] + [f"{head}{i}" for i in range(30)]
    rows = [(rng.choice(texts), rng.choice([None, 3, 4]), rng.random() < 2) for _ in range(400)]
    df = spark.createDataFrame(rows, "t string, n int, one boolean").repartition(4)
    from collections import Counter
    got = {}
    for r in profile.top_values(df, ["t", "n"], 7).collect():
        got.setdefault(r["column"], []).append((r["rank"], r["value"], r["n"]))
    for c, at in (("t", 0), ("n", 1)):
        counts = Counter(None if r[at] is None else str(r[at]) for r in rows)
        want = sorted(counts.items(), key=lambda x: (-x[1], x[0] is None, x[0] or ""))[:7]
        assert sorted(got[c]) == [(i + 1, v, k) for i, (v, k) in enumerate(want)]
    prof = profile.categorical_profile(df, ["t"]).collect()[0]
    held = {r[0] for r in rows if r[0] is not None}
    assert prof["cardinality"] == len(held) and prof["lowercase_consistent"] == (len({t.lower() for t in held}) == len(held))
    assert prof["avg_str_length"] == pytest.approx(np.mean([len(r[0]) for r in rows if r[0] is not None]))
    assert {r["column"]: r["is_binary"] for r in profile.binary_columns(df).collect()} == {"t": False, "n": False, "one": False}


def test_two_valued_columns(spark):
    rows = [(1, "a", None, 1.0, True, "q"), (2, "b", "x", 1.0, True, None), (1, "a", "x", 1.0, False, None)]
    df = spark.createDataFrame(rows, "a int, b string, c string, d double, e boolean, f string").withColumn("g", F.lit(None).cast("int")).withColumn(
        "t", F.timestamp_seconds(F.col("a")).cast("timestamp_ntz"))
    want = {"a": True, "b": True, "c": True, "d": False, "e": True, "f": True, "g": False, "t": True}
    assert {r["column"]: r["is_binary"] for r in profile.binary_columns(df).collect()} == want
    three = df.unionByName(df.limit(1).withColumn("a", F.lit(7)).withColumn("b", F.lit("aa")))
    assert {r["column"] for r in profile.binary_columns(three).collect() if r["is_binary"]} == {"c", "e", "f", "t"}


def test_no_exchange_carries_texts(spark):
    """A text 4,000 times as long moves no more bytes through the exchanges."""
    moved = []
    for size in (1, 4000):
        df = spark.range(2000).select(F.concat(F.repeat(F.lit("y"), size), F.col("id").cast("string")).alias("t")).repartition(4)
        plans = exchanges(spark, lambda df=df: profile.categorical_profile(df, ["t"]).collect())
        assert any("xxhash64" in p for p in plans)
        freq = profile.digest_frequency(df, ["t"])
        moved.append(max(len(str(r)) for r in freq.collect()))
    assert moved[1] < moved[0] + 80
