"""Tree models over cells: rows that share the bins of all numbers, all categories and the class.

A tree of Spark ML knows a number by its bin only, 32 a column, so rows of one cell are one
row with a weight to it: boosting reads the cells' counts, and a bootstrap sample of
Poisson(1) copies of each row has Poisson(n) copies of a cell's n rows. One aggregate over
the rows yields the cells; every pass over the levels of the trees reads these alone. Where
rows seldom share a cell, the callers fit the rows themselves.
"""

from __future__ import annotations

from collections.abc import Callable
from math import inf, isqrt, prod

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import OneVsRest, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, ImputerModel, OneHotEncoderModel, StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import materialize

#: Families whose models depend on bins alone.
FAMILIES = ("RF", "GBM")
#: Bins of a column (Spark's default), fewest rows that are worth cells, rows per cell at least.
BINS = 32
MIN_ROWS = 100_000
ROWS_PER_CELL = 16
#: A bin's bound is off its rank by one row in so many (Spark's own come from a sample of 10,000 rows).
ACCURACY = 2000
#: Most classes with a count column each.
MAX_CLASSES = 32


def edges(df: DataFrame, cols: list[str]) -> dict[str, list[float]]:
    """Lower bounds of a column's bins but the first: quantiles of all rows, or the values themselves where they are few."""
    if not cols:
        return {}
    probs = [i / BINS for i in range(1, BINS)]
    row = df.agg(*[x for i, c in enumerate(cols) for x in (F.percentile_approx(c, probs, ACCURACY).alias(f"q{i}"), F.min(c).alias(f"m{i}"))]).first()
    found = {i: set(row[f"q{i}"] or []) for i in range(len(cols))}
    tied = [i for i, q in found.items() if len(q) < len(probs)]  # of many values, or of frequent ones
    sizes = df.agg(*[F.approx_count_distinct(cols[i]).alias(f"d{i}") for i in tied]).first() if tied else {}
    few = [i for i in tied if sizes[f"d{i}"] <= 2 * BINS]
    values = df.agg(*[F.collect_set(cols[i]).alias(f"v{i}") for i in few]).first() if few else {}  # about 2 * BINS a column
    for i in few:
        if len(values[f"v{i}"]) <= BINS:
            found[i] = set(values[f"v{i}"])
    return {c: sorted(e for e in found[i] if e > row[f"m{i}"]) for i, c in enumerate(cols)}


class Cells:
    """Cells of the rows that ``prepared`` (indexers, one-hot, imputer, assembler) turns into features."""

    def __init__(self, prepared: PipelineModel, bounds: dict[str, list[float]], n_classes: int, label_field: T.StructField):
        self.prepared, self.n_classes, self.label_field = prepared, n_classes, label_field
        onehot = [s for s in prepared.stages if isinstance(s, OneHotEncoderModel)]
        numbers = list(bounds)
        self.encoders = onehot
        self.bins = [f"{c}__bin" for c in numbers]
        # a column of one value still has two bins, one of them empty
        self.binner = [Bucketizer(splitsArray=[[-inf, *(bounds[c] or [0.0]), inf] for c in numbers], inputCols=numbers,
                                  outputCols=self.bins)] if numbers else []
        self.keys = [c for s in onehot for c in s.getInputCols()] + self.bins
        self.assembler = VectorAssembler(inputCols=[c for s in onehot for c in s.getOutputCols()] + self.bins, outputCol="binned")
        self.table: DataFrame | None = None

    @classmethod
    def of(cls, prepared: PipelineModel, seen: DataFrame, n_classes: int, label_field: T.StructField, rows: int) -> Cells | None:
        """Cells for the rows ``seen`` in training, or none where they wouldn't be far fewer than the rows."""
        known = (StringIndexerModel, OneHotEncoderModel, ImputerModel, VectorAssembler)
        if rows < MIN_ROWS or not 1 < n_classes <= MAX_CLASSES or not all(isinstance(s, known) for s in prepared.stages):
            return None
        coded = prepared.transform(seen)
        numbers = [c for s in prepared.stages if isinstance(s, ImputerModel) for c in s.getOutputCols()]
        bounds = edges(coded, numbers)
        found = cls(prepared, bounds, n_classes, label_field)
        most = prod(size + 1 for s in found.encoders for size in s.categorySizes) * prod(len(b) + 1 for b in bounds.values())
        if most * ROWS_PER_CELL > rows:  # not all combinations need occur
            most = found.keyed(seen).agg(F.approx_count_distinct(F.xxhash64(*found.keys))).first()[0]
        return found if most * ROWS_PER_CELL <= rows else None

    def keyed(self, rows: DataFrame) -> DataFrame:
        """``rows`` with their features and the key columns of their cell."""
        out = self.prepared.transform(rows)
        for stage in self.binner:
            out = stage.transform(out)
        return out

    def count(self, rows: DataFrame, parts: dict[str, Column]) -> None:
        """One scan: for every cell of ``rows``, its rows of each class in each of ``parts`` (name to condition), as ``<name>_<class>``."""
        counts = [F.count_if(where & (F.col("label") == float(k))).alias(f"{name}_{k}") for name, where in parts.items() for k in range(self.n_classes)]
        self.table = materialize(self.keyed(rows).groupBy(*self.keys).agg(*counts), "tree-cells")

    def _vectors(self, cells: DataFrame) -> DataFrame:
        # numbers, not the categories that Bucketizer declares: trees split them in their order
        cells = cells.withColumns({c: F.col(c) + 0.0 for c in self.bins}) if self.bins else cells
        for stage in [*self.encoders, self.assembler]:
            cells = stage.transform(cells)
        return cells

    def train(self, part: str, trees: int, seed: int) -> DataFrame:
        """A row per cell and class: ``label``, ``binned``, its rows ``n`` and its copies in the samples of the ``trees``."""
        counts = F.array(*[F.col(f"{part}_{k}") for k in range(self.n_classes)])
        rows = self.table.select(*self.keys, F.posexplode(counts).alias("_class", "n")).filter("n > 0")
        rows = rows.withColumn("_seed", F.xxhash64(*self.keys, "_class", F.lit(seed)))

        def sampled(batches):
            for pdf in batches:  # each cell has its own generator: a repeated task draws the same
                drawn = [np.random.default_rng(s % 2**64).poisson(n, trees).astype(float) for s, n in zip(pdf["_seed"].tolist(), pdf["n"].tolist(), strict=True)]
                yield pdf.assign(draws=pd.Series(drawn, index=pdf.index, dtype=object)).drop(columns="_seed")

        fields = [f for f in rows.schema.fields if f.name != "_seed"]
        rows = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism).mapInPandas(
            sampled, T.StructType([*fields, T.StructField("draws", T.ArrayType(T.DoubleType()))]))
        label = F.col("_class").cast("double").alias("label", metadata=self.label_field.metadata)
        return self._vectors(rows).select(label, F.col("n").cast("double").alias("n"), "draws", "binned")

    def fit(self, ests: dict[str, object], part: str, each: Callable, seed: int) -> dict[str, object]:
        """A model of ``binned`` for every estimator (forest, boosted trees, or one-vs-rest of these)."""
        trees = max([e.getNumTrees() for e in ests.values() if isinstance(e, RandomForestClassifier)], default=0)
        train = self.train(part, trees, seed).persist(StorageLevel.MEMORY_AND_DISK)  # as many rows as cells, not as rows
        size = train.count()
        # Spark looks for bins in a sample of maxBins ** 2 rows: let it see all cells, whose bins stay as they are
        most = max(BINS, isqrt(size) + 1)

        def one(est):
            est = est.copy().setFeaturesCol("binned")
            if isinstance(est, RandomForestClassifier):
                return _forest(est.setMaxBins(most), train, each)
            if isinstance(est, OneVsRest):
                est.setClassifier(est.getClassifier().copy().setMaxBins(most))
            else:
                est.setMaxBins(most)
            return est.setWeightCol("n").fit(train.select("label", "binned", "n"))
        models = {code: one(est) for code, est in ests.items()}
        train.unpersist()
        return models

    def answers(self, models: dict[str, object], answer: Callable[[DataFrame], Column]) -> DataFrame:
        """A row per cell with what each model says of it (``m_<code>``)."""
        out = self._vectors(self.table)
        for code, model in models.items():
            scored = model.transform(out)
            out = scored.withColumn(f"m_{code}", answer(scored)).drop("prediction", "probability", "rawPrediction")
        return out

    def accuracy(self, model, part: str) -> float:
        """Share of the rows of ``part`` whose class the model says."""
        total = sum(F.col(f"{part}_{k}") for k in range(self.n_classes))
        right = sum(F.when(F.col("prediction") == float(k), F.col(f"{part}_{k}")).otherwise(0) for k in range(self.n_classes))
        row = model.transform(self._vectors(self.table)).agg(F.sum(right).alias("right"), F.sum(total).alias("total")).first()
        return row["right"] / row["total"]

    def stages(self) -> list:
        """Stages that follow ``prepared`` before a model of ``binned`` where rows are scored one by one."""
        return [*self.binner, self.assembler]


def _forest(est: RandomForestClassifier, train: DataFrame, each: Callable) -> RandomForestClassificationModel:
    """A forest whose trees are fitted one by one, each on its own sample of copies."""
    subset = "sqrt" if est.getFeatureSubsetStrategy() == "auto" and est.getNumTrees() > 1 else est.getFeatureSubsetStrategy()

    def tree(t: int):
        one = est.copy().setNumTrees(1).setBootstrap(False).setFeatureSubsetStrategy(subset).setSeed(est.getSeed() + t).setWeightCol("w")
        return one.fit(train.select("label", "binned", F.col("draws")[t].alias("w")).filter("w > 0"))

    trees = each(train.sparkSession, tree, range(est.getNumTrees()))
    sc, first = train.sparkSession.sparkContext, trees[0]
    kind = sc._jvm.org.apache.spark.ml.classification
    joined = sc._gateway.new_array(kind.DecisionTreeClassificationModel, len(trees))
    for i, one in enumerate(trees):
        joined[i] = one._java_obj.trees()[0]
    java = kind.RandomForestClassificationModel(est.uid, joined, first.numFeatures, first.numClasses)
    model = RandomForestClassificationModel(java)
    return est._copyValues(model).setFeaturesCol(est.getFeaturesCol())
