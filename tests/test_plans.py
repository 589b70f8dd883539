"""Scale checks on physical plans: pruning, pushdown, partial top-k, no raw rows through one task."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
# windows / single-partition exchanges allowed only over bounded inputs (partitions, models, families, rules)
BOUNDED_SINGLE = {"autocorr_lag1", "profile_datetime", "feature_profile", "leaderboard", "select_models", "recent_activity",
                  "head_n", "list_datasets", "list_models", "list_jobs", "list_runs", "null_report"}


def plan_of(spark, name):
    df = entry.queries()[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["top_values", "tail_logs", "split_distribution"])
def test_top_k_runs_partial_limit_before_shuffle(spark, name):
    plan = plan_of(spark, name)
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize("name", ["profile_numeric", "fill_median", "quantile_binning"])
def test_exact_quantiles_avoid_per_group_percentile_buffer(spark, name):
    plan = plan_of(spark, name)
    assert "percentile(" not in plan


def test_projection_pruned_at_scan(spark):
    plan = plan_of(spark, "hash_trick")
    scan = [line for line in plan.splitlines() if "FileScan parquet" in line][0]
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string>" in scan


def test_filter_pushed_to_scan(spark):
    from pyspark.sql import functions as F
    from quarry.sources.tables import load
    df = load(spark, SF, "orders").filter(F.col("o_orderstatus") == "F").select("o_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in plan


def test_filter_on_doubles_pushed_to_scan(spark):
    from pyspark.sql import functions as F
    from quarry.sources.tables import load
    plan = load(spark, SF, "orders", F.col("o_totalprice") > 1000)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,1000.0)" in plan


@pytest.mark.parametrize("name", ["ffill", "ffill_keyless", "best_so_far", "next_run_number", "split_random",
                                  "stratified_sample", "latest_run_per_model", "best_epoch", "model_statistics"])
def test_no_unpartitioned_window_over_raw_rows(spark, name):
    plan = plan_of(spark, name)
    for line in plan.splitlines():
        if "Window [" in line:
            # a window must be partitioned by a key (the list after the window expressions is non-empty)
            assert "], [], [" not in line or name in BOUNDED_SINGLE, line


@pytest.mark.parametrize("name", ["split_random", "split_stratified", "stratified_sample"])
def test_splits_and_samples_do_not_shuffle_rows(spark, name):
    plan = plan_of(spark, name)
    assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan
