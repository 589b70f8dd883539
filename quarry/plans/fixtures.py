"""Inputs derived from the driver tables, each with its SQL twin.

The reference's own inputs (registry tables, predictions, progress events,
logs) do not exist in the driver data, so they are derived deterministically
from it: every derivation here has a Spark form and an identical SQL form used
by the DuckDB oracle. Work grows with the driver tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.tables import load


def _pmod(c, m):
    return F.pmod(F.col(c), F.lit(m))


# ---------------------------------------------------------------------------
# profiling input: lineitem with deterministic NULLs and a boolean column
# ---------------------------------------------------------------------------

def lineitem_nulls(spark: SparkSession, sf: str) -> DataFrame:
    li = load(spark, sf, "lineitem")
    return li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.when(_pmod("l_orderkey", 7) == 0, F.lit(None)).otherwise(F.col("l_quantity")).alias("l_quantity"),
        "l_extendedprice",
        F.when(_pmod("l_partkey", 17) == 0, F.lit(None)).otherwise(F.col("l_discount")).alias("l_discount"),
        "l_tax",
        F.when(_pmod("l_partkey", 11) == 0, F.lit(None)).otherwise(F.col("l_returnflag")).alias("l_returnflag"),
        "l_linestatus",
        F.when(_pmod("l_suppkey", 13) == 0, F.lit(None)).otherwise(F.col("l_discount") > 0.05).alias("l_is_discounted"),
        "l_shipdate")


LINEITEM_NULLS_SQL = """(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
  l_extendedprice, CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE l_discount END AS l_discount, l_tax,
  CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag,
  l_linestatus,
  CASE WHEN l_suppkey % 13 = 0 THEN NULL ELSE l_discount > 0.05 END AS l_is_discounted,
  l_shipdate FROM lineitem)"""

LINEITEM_NULLS_TYPES = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
    "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
    "l_returnflag": "string", "l_linestatus": "string", "l_is_discounted": "boolean",
    "l_shipdate": "timestamp_ntz",
}


# conversations with deterministic gaps (ordered per-key fills)
def conversations_gaps(spark: SparkSession, sf: str) -> DataFrame:
    cv = load(spark, sf, "conversations")
    return cv.select("conv_id", "turn", "role",
                     F.when(_pmod("turn", 3) == 1, F.lit(None)).otherwise(F.col("role")).alias("role_gap"),
                     F.when(_pmod("turn", 4) == 2, F.lit(None)).otherwise(F.char_length("text")).alias("len_gap"))


CONVERSATIONS_GAPS_SQL = """(SELECT conv_id, turn, role, CASE WHEN turn % 3 = 1 THEN NULL ELSE role END AS role_gap,
  CASE WHEN turn % 4 = 2 THEN NULL ELSE CAST(length(text) AS INTEGER) END AS len_gap FROM conversations)"""


# events with NaN / infinities injected
def events_nan(spark: SparkSession, sf: str) -> DataFrame:
    ev = load(spark, sf, "events")
    m = _pmod("event_id", 10)
    v = (F.when(m == 0, F.lit(float("nan"))).when(m == 1, F.lit(float("inf")))
         .when(m == 2, F.lit(float("-inf"))).otherwise(F.col("value")))
    return ev.select("event_id", v.alias("value"), F.array(v, F.col("value")).alias("pair"))


EVENTS_NAN_SQL = """(SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'nan'::DOUBLE WHEN event_id % 10 = 1 THEN 'inf'::DOUBLE
  WHEN event_id % 10 = 2 THEN '-inf'::DOUBLE ELSE value END AS value FROM events)"""


# A row order that is unique at every scale factor (the four keys alone repeat at sf0.001).
LINEITEM_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_tax", "l_shipdate"]
