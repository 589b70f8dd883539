"""Cross-run benchmarking (K1-K8): long -> wide scores, composite ranking, best run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tracked metrics, their directions and composite weights.
METRICS = {"predictive_accuracy": "accuracy", "area_under_roc_curve": "auc", "f_measure": "f1",
           "root_mean_squared_error": "rmse"}
DIRECTIONS = {"accuracy": "max", "auc": "max", "f1": "max", "rmse": "min"}
WEIGHTS = {"accuracy": 0.5, "auc": 0.3, "f1": 0.2}

_TASK_SCHEMA = "struct<task_id:bigint,id:bigint>"


def flatten_tasks(df: DataFrame, js: str = "tasks_json", keep: list[str] | None = None) -> DataFrame:
    """K1: JSON element may be an object or an array of objects; id under task_id or id."""
    j = F.trim(F.col(js))
    arr = F.when(j.startswith("["), F.from_json(j, f"array<{_TASK_SCHEMA}>")).otherwise(
        F.array(F.from_json(j, _TASK_SCHEMA)))
    return df.select(*(keep or []), F.explode(arr).alias("t")).select(
        *(keep or []), F.coalesce(F.col("t.task_id"), F.col("t.id")).alias("task_id")).filter(F.col("task_id").isNotNull())


def runs_wide(scores: DataFrame, run: str = "run_id", metric: str = "function", value: str = "value",
              seq: str = "seq") -> DataFrame:
    """K2: long (run, metric, value) -> one row per run; later value wins; NULL run / unparsable skipped."""
    v = F.col(value).cast("string").try_cast("double")
    s = scores.filter(F.col(run).isNotNull() & v.isNotNull() & F.col(metric).isin(*METRICS))
    s = s.withColumn("_m", F.col(metric)).withColumn("_v", v)
    aggs = [F.max_by(F.when(F.col("_m") == k, F.col("_v")), F.when(F.col("_m") == k, F.col(seq))).alias(name)
            for k, name in METRICS.items()]
    return s.groupBy(run).agg(*aggs)


def composite_score(wide: DataFrame) -> Column:
    """K3: weighted mean over the weights whose metric is present; NULL when none."""
    num = sum((F.coalesce(F.col(m) * w, F.lit(0.0)) for m, w in WEIGHTS.items()), F.lit(0.0))
    den = sum((F.when(F.col(m).isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for m, w in WEIGHTS.items()), F.lit(0.0))
    return F.when(den > 0, num / den)


def best_run(wide: DataFrame, group: str = "dataset", run: str = "run_id") -> DataFrame:
    """K4: highest composite score per group; ties -> lowest run id; no metrics -> no row."""
    scored = wide.withColumn("score", composite_score(wide)).filter(F.col("score").isNotNull())
    return scored.groupBy(group).agg(
        F.max_by(F.struct(F.col(run).alias("run_id"), F.col("score")),
                 F.struct(F.col("score"), (-F.col(run)).alias("_neg"))).alias("b")).select(group, "b.*")


def merge_runs(scores: DataFrame, run: str = "run_id", task: str = "task_id", seq: str = "seq") -> DataFrame:
    """K5: per run the first task id is kept; later tasks' metric values overwrite earlier ones."""
    first = scores.groupBy(run).agg(F.min_by(task, seq).alias("task_id"))
    return first.join(runs_wide(scores, run, seq=seq), run, "left")


def best_per_metric(wide: DataFrame, group: str = "dataset") -> DataFrame:
    """K6: best value per metric by its declared direction."""
    aggs = [(F.max(m) if d == "max" else F.min(m)).alias(f"best_{m}") for m, d in DIRECTIONS.items()]
    return wide.groupBy(group).agg(*aggs)


def dataset_selection(datasets: DataFrame, wanted: list[str]) -> DataFrame:
    """K8: keep datasets whose lower(name) or id is listed (case-insensitive); empty list = all."""
    if not wanted:
        return datasets
    w = datasets.sparkSession.createDataFrame([(x.lower(),) for x in wanted], "key string")
    by_name = datasets.join(F.broadcast(w), F.lower(datasets["name"]) == w["key"], "left_semi")
    by_id = datasets.join(F.broadcast(w), F.lower(datasets["id"]) == w["key"], "left_semi")
    return by_name.unionByName(by_id).distinct()
