"""Queries for leaderboard top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import registry as G
from quarry.operators import scores as K
from quarry.plans import registry_data as R
from quarry.plans.catalog import register, rounded
from quarry.plans.q_registry import _RUN_DS, _comp_sql, _wide_sql


@register("top_models", f"""SELECT dataset, run_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT d.dataset, w.run_id, {_comp_sql()} AS score,
    row_number() OVER (PARTITION BY d.dataset ORDER BY {_comp_sql()} DESC NULLS LAST, w.run_id) AS rank
  FROM {_wide_sql()} w JOIN {_RUN_DS} d USING (run_id)) WHERE rank <= 3""")
def q_top_models(spark, sf):
    s = R.scores(spark, sf)
    ds = s.filter(F.col("run_id").isNotNull()).groupBy("run_id").agg(F.min("dataset").alias("dataset"))
    w = K.runs_wide(s).join(ds, "run_id")
    board = w.select("dataset", "run_id", K.composite_score(w).alias("score"))
    return rounded(G.top_models(board, group="dataset"))
