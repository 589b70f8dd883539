"""Tree models fitted on cells: rows that share bins, categories and class."""

import random

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.feature import StringIndexer
from pyspark.sql import functions as F

from quarry.operators import automl as J
from quarry.operators import cells as C

SCHEMA = "id long, a double, b double, c string, y string"


def few_values(spark, n=3000):
    """Numbers of up to 30 values, so that a bin is a value, with NULLs."""
    rng = random.Random(5)
    rows = []
    for i in range(n):
        a, b, c = rng.randrange(30) / 3, rng.randrange(12) * 1.5, rng.choice(["u", "v", "w"])
        y = "p" if a > 5 and c == "u" else "q" if b > 8 else "r"
        rows.append((i, a if rng.random() > 0.05 else None, b, c if rng.random() > 0.05 else None, y if rng.random() > 0.1 else rng.choice("pqr")))
    return spark.createDataFrame(rows, SCHEMA)


def small_cells(monkeypatch):
    monkeypatch.setattr(C, "MIN_ROWS", 1)
    monkeypatch.setattr(C, "ROWS_PER_CELL", 1)


def fitted(spark, df, monkeypatch):
    small_cells(monkeypatch)
    data = J._prep(df.drop("id"), "y", "multiclass")
    prepared = Pipeline(stages=J.feature_pipeline(data, "y", "multiclass")[0]).fit(data)
    rows = prepared.transform(data)
    cells = J._cells(prepared, data, rows.schema["label"])
    cells.count(data, {"seen": F.lit(True)})
    return data, prepared, rows, cells


def test_boosted_trees_of_cells_are_those_of_rows(spark, monkeypatch):
    data, prepared, rows, cells = fitted(spark, few_values(spark), monkeypatch)
    assert cells.table.count() < rows.count() / 2
    assert cells.table.agg(*[F.sum(f"seen_{k}") for k in range(3)]).first() == tuple(
        r["count"] for r in rows.groupBy("label").count().orderBy("label").collect())
    est = J.make_estimator("GBM", "multiclass", n_classes=3, iterations=4)
    of_cells = cells.fit({"GBM": est}, "seen", J._each, 42)["GBM"]
    of_rows = est.fit(rows)
    keyed = cells.assembler.transform(cells.keyed(data)).withColumn("_n", F.monotonically_increasing_id())
    both = of_cells.transform(keyed).withColumnsRenamed({"prediction": "mine", "rawPrediction": "raw"})
    got = [(r["mine"], r["prediction"], r["raw"].toArray(), r["rawPrediction"].toArray()) for r in of_rows.transform(both).collect()]
    assert all(a == b for a, b, _, _ in got) and max(np.abs(x - z).max() for _, _, x, z in got) < 1e-6


def test_forest_of_cells_is_bagged_and_repeatable(spark, monkeypatch):
    data, prepared, rows, cells = fitted(spark, few_values(spark), monkeypatch)
    est = J.make_estimator("RF", "multiclass", n_classes=3)
    a, b = (cells.fit({"RF": est}, "seen", J._each, 42)["RF"] for _ in range(2))
    assert a.getNumTrees == est.getNumTrees() == 20 and a.numClasses == 3 and a.toDebugString.split("\n", 1)[1] == b.toDebugString.split("\n", 1)[1]
    assert len({t.toDebugString.split("\n", 1)[1] for t in a.trees}) > 10  # samples differ
    draws = cells.train("seen", 20, 42).select(F.sum("n").alias("n"), *[F.sum(F.col("draws")[t]).alias(f"d{t}") for t in range(20)]).first()
    assert draws["n"] == 3000 and all(abs(draws[f"d{t}"] - 3000) < 6 * 3000**0.5 for t in range(20)) and len(set(draws)) > 10
    keyed = cells.assembler.transform(cells.keyed(data))

    def right(model, on):
        return model.transform(on).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert abs(right(a, keyed) - right(est.fit(rows), rows)) < 0.03


def test_edges_are_values_or_quantiles_of_all_rows(spark):
    df = spark.range(4000).select((F.col("id") % 7).cast("double").alias("few"), F.col("id").cast("double").alias("many"), F.lit(2.0).alias("one"),
                                  F.when(F.col("id") == 77, 5.0).otherwise(F.col("id") % 2).alias("rare"))
    found = C.edges(df, df.columns)
    assert found["few"] == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0] and found["one"] == [] and found["rare"] == [1.0, 5.0]
    assert len(found["many"]) == 31 and max(abs(e - (i + 1) * 125) for i, e in enumerate(found["many"])) <= 4000 / C.ACCURACY + 1


def test_automl_scores_by_cells_as_by_rows(spark, monkeypatch):
    df = few_values(spark).drop("id").withColumn("id", F.monotonically_increasing_id() % 1)  # one value: no cell of its own
    plain = {r["model"]: r["score_test"] for r in J.automl_fit(df, "y", "multiclass", families=("RF", "GBM"), id_cols=["a", "b", "c"])[1].collect()}
    small_cells(monkeypatch)
    kept = []
    monkeypatch.setattr(J, "materialize", lambda d, name="table", write=J.materialize: kept.append(write(d, name)) or kept[-1])
    models, board, _ = J.automl_fit(df, "y", "multiclass", families=("LR", "RF", "GBM"), id_cols=["a", "b", "c"])
    mine = {r["model"]: r["score_test"] for r in board.collect()}
    test = kept[0].filter("split = 'test'")
    for code in ("LR", "RF", "GBM"):  # models answer rows, too
        rows = models[code].transform(test).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
        assert abs(rows - mine[code]) < 1e-12
    assert mine["GBM"] == plain["GBM"] and abs(mine["RF"] - plain["RF"]) < 0.05
    assert any(type(s).__name__ == "Bucketizer" for s in models["GBM"].stages)


def test_stack_answers_every_row_from_cells(spark, monkeypatch):
    df = few_values(spark)
    small_cells(monkeypatch)
    used = []
    monkeypatch.setattr(C.Cells, "answers", lambda self, *a, f=C.Cells.answers: used.append(1) or f(self, *a))
    oof = J.out_of_fold(df.withColumn("id", (F.col("id") / 500).cast("long")), "y", "multiclass", "id", ("LR", "RF", "GBM"), folds=2, iterations=2)
    assert len(used) == 2 and oof.columns == ["id", "_fold", "label", "m_LR", "m_RF", "m_GBM"]
    assert oof.count() == 3000 and oof.where(" or ".join(f"m_{m} is null or size(m_{m}) <> 3" for m in ("LR", "RF", "GBM"))).count() == 0
    assert oof.agg(F.avg((F.array_position("m_GBM", 1.0) - 1 == F.col("label")).cast("double"))).first()[0] > 0.6


def test_fold_indexers_are_those_fitted_outside_the_fold(spark):
    rows = [(i % 3, v) for i, v in enumerate(["b", "a", "c", "b", "a", None, "z", "c", "a", "\U0001f600", "￮"])]
    df = spark.createDataFrame(rows, "_fold int, c string")
    est = StringIndexer(inputCols=["c"], outputCols=["x"], handleInvalid="keep")
    mine = J._fold_indexers(df, [est])
    for k in range(3):
        assert list(mine(est, k).labelsArray[0]) == list(est.fit(df.filter(F.col("_fold") != k)).labelsArray[0])


def test_regression_and_unlike_rows_keep_the_rows(spark, monkeypatch):
    df = few_values(spark, 400)
    monkeypatch.setattr(C, "MIN_ROWS", 1)  # ids are unlike: too many cells
    data = J._prep(df.withColumn("x", F.rand(3)), "y", "multiclass")
    prepared = Pipeline(stages=J.feature_pipeline(data, "y", "multiclass")[0]).fit(data)
    assert J._cells(prepared, data, prepared.transform(data).schema["label"]) is None
