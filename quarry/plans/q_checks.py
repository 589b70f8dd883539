"""Queries for validation and task inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import checks as H
from quarry.operators import sample as S
from quarry.plans import registry_data as R
from quarry.plans.catalog import register, rounded
from quarry.plans.fixtures import LINEITEM_NULLS_SQL as LN, lineitem_nulls
from quarry.plans.q_sample_eval import _split_sql
from quarry.sources.tables import load

DS = R.duck(lambda e: R.datasets_sql(e))


def _orders(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")


@register("validate_split_tables", f"""WITH s AS ({_split_sql(0.2)})
SELECT true AS valid, CAST(NULL AS VARCHAR) AS reason, (SELECT count(*) FROM s WHERE split = 'train') AS train_rows,
  (SELECT count(*) FROM s WHERE split = 'test') AS test_rows, 4 AS n_columns""")
def q_validate_split(spark, sf):
    s = S.split_random(_orders(spark, sf), ["o_orderkey"], 0.2)
    train = s.filter(F.col("split") == "train").drop("split")
    test = s.filter(F.col("split") == "test").drop("split")
    return H.validate_split_tables(train, test, "classification")


@register("validate_single_table", """SELECT 'auto_split' AS mode, CAST(floor(count(*) * 0.8) AS BIGINT) AS train_rows,
  CAST(count(*) - floor(count(*) * 0.8) AS BIGINT) AS test_rows, count(*) > 0 AND floor(count(*) * 0.8) >= 50 AS valid FROM lineitem""")
def q_validate_single(spark, sf):
    return H.validate_single_table(load(spark, sf, "lineitem"), "classification")


_LN_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
            "l_tax", "l_returnflag", "l_linestatus", "l_is_discounted", "l_shipdate"]


@register("validate_automl", f"""SELECT count(DISTINCT l_returnflag) >= 2 AND count(*) >= 100 AS valid, CAST(NULL AS VARCHAR) AS reason,
  CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT l_returnflag) AS BIGINT) AS target_unique,
  'classification' AS problem_type,
  round_even(({' + '.join(f'count(*) - count({c})' for c in _LN_COLS)}) * 100.0 / (count(*) * {len(_LN_COLS)}), 2) AS missing_percent
  FROM {LN}""")
def q_validate_automl(spark, sf):
    return H.validate_automl(lineitem_nulls(spark, sf), "l_returnflag")


_TGT_COLS = {"l_quantity": True, "l_discount": True, "l_linenumber": True, "l_returnflag": False, "l_extendedprice": True}


@register("task_from_target", "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column",
  CASE WHEN {str(num).lower()} AND count(DISTINCT {c}) > 20 THEN 'regression' ELSE 'classification' END AS validator,
  CASE WHEN {str(num).lower()} AND (count(DISTINCT {c}) > 10 OR CAST(count(DISTINCT {c}) AS DOUBLE) / count(*) > 0.05) THEN 'regression' ELSE 'classification' END AS worker,
  CASE WHEN count(DISTINCT {c}) BETWEEN 2 AND 100 THEN 'classification,regression'
       WHEN count(DISTINCT {c}) > 100 OR {'true' if c in ('l_quantity', 'l_discount', 'l_extendedprice') else 'false'} THEN 'regression'
       ELSE 'classification,regression' END AS upload,
  CASE WHEN count(DISTINCT {c}) = 2 THEN 'binary' ELSE 'multiclass' END AS strategy FROM lineitem""" for c, num in _TGT_COLS.items()))
def q_task_from_target(spark, sf):
    li = load(spark, sf, "lineitem")
    parts = []
    for c, num in _TGT_COLS.items():
        a = li.agg(F.count_distinct(c).alias("nu"), F.count(F.lit(1)).alias("n"))
        dtype = F.lit(li.schema[c].dataType.simpleString())
        parts.append(a.select(
            F.lit(c).alias("column"),
            H.task_from_target(F.col("nu"), F.col("n"), F.lit(num), dtype, "validator").alias("validator"),
            H.task_from_target(F.col("nu"), F.col("n"), F.lit(num), dtype, "worker").alias("worker"),
            F.array_join(H.task_from_target(F.col("nu"), F.col("n"), F.lit(num),
                                            F.when(dtype == "double", F.lit("float64")).otherwise(dtype), "upload"), ",").alias("upload"),
            H.task_from_target(F.col("nu"), F.col("n"), F.lit(num), dtype, "strategy").alias("strategy")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _any_sql(col, words):
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


def _metadata_sql():
    n, d = "lower(coalesce(name, ''))", "lower(coalesce(description, ''))"
    whens = [f"WHEN {_any_sql(n, ws)} THEN '{t}'" for t, ws in H.NAME_RULES]
    whens += ["WHEN domain = 'vision' AND coalesce(n_classes, 0) >= 2 THEN 'classification'",
              "WHEN domain = 'vision' AND coalesce(has_annotations, false) THEN 'detection'",
              "WHEN domain = 'vision' AND coalesce(has_masks, false) THEN 'detection'"]
    whens += [f"WHEN {_any_sql(d, ws)} THEN '{t}'" for t, ws in H.DESCRIPTION_RULES]
    return "CASE " + " ".join(whens) + " ELSE 'classification' END"


def _ds(spark, sf):
    return R.datasets(spark, sf)


def _meta_cols():
    return dict(name=F.col("name"), domain=F.col("domain"), description=F.col("description"), n_classes=F.col("n_classes"),
                has_annotations=F.col("has_annotations"), has_labels=F.lit(False), has_masks=F.col("has_masks"))


@register("task_from_metadata", f"SELECT id, {_metadata_sql()} AS task FROM {DS}")
def q_task_from_metadata(spark, sf):
    return _ds(spark, sf).select("id", H.task_from_metadata(**_meta_cols()).alias("task"))


def _conf_sql():
    n = "lower(coalesce(name, ''))"
    parts = {}
    for t, base in H.CONFIDENCE_BASE.items():
        s = [str(base)] + [f"CASE WHEN contains({n}, '{kw}') THEN 0.3 ELSE 0.0 END" for kw in H.CONFIDENCE_KEYWORDS.get(t, [])]
        if t == "classification":
            s.append("CASE WHEN domain = 'vision' AND n_classes IS NOT NULL THEN 0.2 ELSE 0.0 END")
        if t == "detection":
            s.append("CASE WHEN domain = 'vision' AND has_annotations THEN 0.2 ELSE 0.0 END")
        parts[t] = "(" + " + ".join(s) + ")"
    total = "(" + " + ".join(parts.values()) + ")"
    return ", ".join(f"round(CAST({p} AS DOUBLE) / {total}, 6) AS conf_{t}" for t, p in parts.items())


@register("task_confidence", f"SELECT id, {_conf_sql()} FROM {DS}")
def q_task_confidence(spark, sf):
    ds = _ds(spark, sf)
    m = H.task_confidence(F.col("name"), F.col("domain"), F.col("n_classes").isNotNull(), F.col("has_annotations"))
    return rounded(ds.select("id", m.alias("m")).select("id", *[F.col("m")[t].alias(f"conf_{t}") for t in H.CONFIDENCE_BASE]))


@register("supported_tasks_vision", f"""SELECT id, CASE WHEN domain = 'vision' THEN
  CASE WHEN n_classes IS NOT NULL AND n_classes >= 2 THEN 'classification' WHEN n_classes IS NOT NULL THEN ''
       WHEN has_annotations THEN 'detection' WHEN has_masks THEN 'detection' ELSE 'classification' END
  WHEN domain = 'tabular' THEN CASE WHEN target_unique_values BETWEEN 2 AND 100 THEN 'classification,regression'
       WHEN target_unique_values > 100 OR contains(lower(target_dtype), 'float') THEN 'regression' ELSE 'classification,regression' END
  ELSE 'classification' END AS supported FROM {DS}""")
def q_supported(spark, sf):
    ds = _ds(spark, sf)
    st = H.supported_tasks(F.col("domain"), F.col("n_classes"), F.col("has_annotations"), F.lit(False), F.col("has_masks"),
                           F.col("target_unique_values"), F.col("target_dtype"))
    return ds.select("id", F.array_join(st, ",").alias("supported"))


@register("task_reasoning", f"""SELECT id, array_to_string(list_filter([
  CASE WHEN domain = 'vision' AND n_classes >= 2 THEN 'Vision dataset with ' || n_classes || ' class folders' END,
  CASE WHEN domain = 'vision' AND n_classes IS NULL AND has_annotations THEN 'Dataset contains annotation files for object detection' END,
  CASE WHEN domain = 'vision' AND n_classes IS NULL AND NOT has_annotations AND has_masks THEN 'Dataset contains mask files for segmentation' END,
  CASE WHEN domain = 'tabular' AND target_unique_values BETWEEN 2 AND 100 THEN 'Target column has ' || target_unique_values || ' unique values (categorical)' END,
  CASE WHEN domain = 'tabular' AND (target_unique_values > 100 OR (contains(lower(target_dtype), 'float') AND NOT (target_unique_values BETWEEN 2 AND 100))) THEN 'Target column is continuous (regression)' END,
  CASE WHEN domain = 'tabular' AND target_unique_values IS NULL THEN 'Tabular dataset (task depends on target column)' END],
  lambda r: r IS NOT NULL), '; ') AS reasoning FROM {DS}""")
def q_reasoning(spark, sf):
    ds = _ds(spark, sf)
    r = H.task_reasoning(F.col("domain"), F.col("n_classes"), F.col("has_annotations"), F.col("has_masks"),
                         F.col("target_unique_values"), F.col("target_dtype"))
    return ds.select("id", F.array_join(r, "; ").alias("reasoning"))


MODELS = R.duck(lambda e: R.models_sql(e))


def metrics_map():
    return F.map_filter(F.create_map(F.lit("accuracy"), F.col("m_accuracy"), F.lit("acc"), F.col("m_acc"),
                                     F.lit("r2"), F.col("m_r2"), F.lit("loss"), F.col("m_loss")),
                        lambda k, v: v.isNotNull())


@register("task_from_metrics", f"SELECT id, CASE WHEN m_r2 IS NOT NULL THEN 'regression' ELSE 'classification' END AS task FROM {MODELS}")
def q_task_from_metrics(spark, sf):
    return R.models(spark, sf).select("id", H.task_from_metrics(metrics_map()).alias("task"))


_HP_SQL = """(SELECT o_orderkey, o_totalprice / 200000.0 AS learning_rate, CAST(o_custkey % 600 AS INT) AS batch_size,
  (o_orderkey % 10) / 10.0 AS dropout_rate, CAST(o_orderkey % 120 AS INT) AS epochs,
  CASE WHEN o_orderkey % 4 = 0 THEN 'Adam' WHEN o_orderkey % 4 = 1 THEN 'SGD' WHEN o_orderkey % 4 = 2 THEN 'RMSprop' ELSE 'Nadam' END AS optimizer
  FROM orders)"""


@register("hyperparameter_check", f"""SELECT o_orderkey, NOT (learning_rate > 0 AND learning_rate <= 1) AS learning_rate_invalid,
  NOT (batch_size >= 1 AND batch_size <= 512) AS batch_size_invalid, NOT (dropout_rate >= 0 AND dropout_rate <= 0.9) AS dropout_rate_invalid,
  NOT (epochs >= 1 AND epochs <= 100) AS epochs_invalid, optimizer NOT IN ('Adam', 'SGD', 'RMSprop') AS optimizer_invalid,
  array_to_string(list_filter([CASE WHEN NOT (learning_rate > 0 AND learning_rate <= 1) THEN 'learning_rate' END,
    CASE WHEN NOT (batch_size >= 1 AND batch_size <= 512) THEN 'batch_size' END,
    CASE WHEN NOT (dropout_rate >= 0 AND dropout_rate <= 0.9) THEN 'dropout_rate' END,
    CASE WHEN NOT (epochs >= 1 AND epochs <= 100) THEN 'epochs' END,
    CASE WHEN optimizer NOT IN ('Adam', 'SGD', 'RMSprop') THEN 'optimizer' END], lambda x: x IS NOT NULL), ',') AS violations
  FROM {_HP_SQL}""")
def q_hyperparameter_check(spark, sf):
    o = load(spark, sf, "orders")
    m4 = F.pmod("o_orderkey", F.lit(4))
    hp = o.select("o_orderkey", (F.col("o_totalprice") / 200000.0).alias("learning_rate"),
                  F.pmod("o_custkey", F.lit(600)).cast("int").alias("batch_size"),
                  (F.pmod("o_orderkey", F.lit(10)) / 10.0).alias("dropout_rate"),
                  F.pmod("o_orderkey", F.lit(120)).cast("int").alias("epochs"),
                  F.when(m4 == 0, "Adam").when(m4 == 1, "SGD").when(m4 == 2, "RMSprop").otherwise("Nadam").alias("optimizer"))
    out = H.hyperparameter_check(hp)
    return out.select("o_orderkey", "learning_rate_invalid", "batch_size_invalid", "dropout_rate_invalid", "epochs_invalid",
                      "optimizer_invalid", F.array_join("violations", ",").alias("violations"))
