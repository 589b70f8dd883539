"""Model evaluation (I1-I14) over ``predictions(id, y_true, y_pred [, score])``.

Every metric starts from a small aggregate (the confusion matrix, per-score
class counts, one ``agg`` of error sums), so the raw predictions are read once
with map-side partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-15


def confusion_matrix(pred: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Counts by (true, pred)."""
    return pred.groupBy(F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred")).agg(
        F.count(F.lit(1)).alias("n"))


def per_class_prf(pred: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred",
                  classes: DataFrame | None = None) -> DataFrame:
    """TP/FP/FN, precision, recall, F1 per class; 0 when a denominator is 0.

    Classes default to every label seen as truth or prediction; pass ``classes``
    (one column ``class``) to include absent ones.
    """
    cm = confusion_matrix(pred, y_true, y_pred)
    tp = cm.filter(F.col("y_true") == F.col("y_pred")).select(F.col("y_true").alias("class"), F.col("n").alias("tp"))
    support = cm.groupBy(F.col("y_true").alias("class")).agg(F.sum("n").alias("support"))
    predicted = cm.groupBy(F.col("y_pred").alias("class")).agg(F.sum("n").alias("predicted"))
    if classes is None:
        classes = support.select("class").union(predicted.select("class")).distinct()
    j = (classes.join(tp, "class", "left").join(support, "class", "left").join(predicted, "class", "left")
         .fillna(0, ["tp", "support", "predicted"]))
    tpc, sup, prd = F.col("tp").cast("double"), F.col("support").cast("double"), F.col("predicted").cast("double")
    prec = F.coalesce(F.try_divide(tpc, prd), F.lit(0.0))
    rec = F.coalesce(F.try_divide(tpc, sup), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
    return j.select("class", F.col("tp").cast("long").alias("tp"),
                    (F.col("predicted") - F.col("tp")).cast("long").alias("fp"),
                    (F.col("support") - F.col("tp")).cast("long").alias("fn"),
                    F.col("support").cast("long").alias("support"),
                    prec.alias("precision"), rec.alias("recall"), f1.alias("f1"))


def macro_prf(prf: DataFrame, num_classes: int | None = None) -> DataFrame:
    """Unweighted mean over all ``num_classes`` (absent classes count as 0)."""
    n = F.lit(num_classes) if num_classes else F.count(F.lit(1))
    return prf.agg((F.sum("precision") / n).alias("macro_precision"), (F.sum("recall") / n).alias("macro_recall"),
                   (F.sum("f1") / n).alias("macro_f1"))


def weighted_prf(prf: DataFrame) -> DataFrame:
    """I4: support-weighted precision/recall/F1."""
    s = F.sum("support").cast("double")
    return prf.agg(F.try_divide(F.sum(F.col("precision") * F.col("support")), s).alias("weighted_precision"),
                   F.try_divide(F.sum(F.col("recall") * F.col("support")), s).alias("weighted_recall"),
                   F.try_divide(F.sum(F.col("f1") * F.col("support")), s).alias("weighted_f1"))


def accuracy(pred: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Correct / total, 0 when empty."""
    return pred.agg(F.coalesce(F.avg((F.col(y_true) == F.col(y_pred)).cast("double")), F.lit(0.0)).alias("accuracy"),
                    F.count(F.lit(1)).alias("n"))


def log_loss(pred: DataFrame, p_true: str = "p_true", eps: float = EPS) -> DataFrame:
    """Mean -ln p(true class), probabilities clipped to [eps, 1 - eps]."""
    p = F.least(F.greatest(F.col(p_true), F.lit(eps)), F.lit(1 - eps))
    return pred.agg(F.avg(-F.log(p)).alias("log_loss"))


def roc_auc(pred: DataFrame, y_true: str = "y_true", score: str = "score", positive: str = "1") -> DataFrame:
    """Exact binary ROC AUC (Mann-Whitney, ties count one half) from per-score counts.

    Rows reduce to (score, positives, negatives); negatives strictly below each
    score are its rank in the range-partitioned negative counts, so no task
    ever holds all distinct scores.
    """
    from quarry.operators.freq import ranked_frequency
    per = pred.filter(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("value")).agg(
        F.count_if(F.col(y_true).cast("string") == positive).alias("pos"),
        F.count_if(F.col(y_true).cast("string") != positive).alias("neg"))
    ranked = ranked_frequency(per.select(F.lit("all").alias("column"), "value", F.col("neg").alias("n")))
    j = ranked.join(per.select("value", "pos"), "value")
    u = j.agg(F.sum(F.col("pos") * (F.col("rank_lo") + 0.5 * F.col("n"))).alias("U"),
              F.sum("pos").alias("P"), F.sum("n").alias("N"))
    return u.select(F.try_divide(F.col("U"), (F.col("P") * F.col("N")).cast("double")).alias("roc_auc"))


def roc_auc_weighted(scores: DataFrame, cls: str = "class", y_true: str = "y_true", score: str = "score") -> DataFrame:
    """I7, several classes: one-vs-rest AUCs, weighted by how often each class is true.

    ``scores`` has a row per case and class. Counts per (class, score) are ranked for
    all classes by one range exchange; classes that never, or always, are true have no
    AUC and no weight.
    """
    from quarry.operators.freq import ranked_frequency
    per = scores.filter(F.col(score).isNotNull() & F.col(y_true).isNotNull()).groupBy(
        F.col(cls).cast("string").alias("column"), F.col(score).cast("double").alias("value")).agg(
        F.count_if(F.col(y_true).cast("string") == F.col(cls).cast("string")).alias("pos"),
        F.count_if(F.col(y_true).cast("string") != F.col(cls).cast("string")).alias("n"))
    ranked = ranked_frequency(per.select("column", "value", "n"))
    u = ranked.join(per.select("column", "value", "pos"), ["column", "value"]).groupBy("column").agg(
        F.sum(F.col("pos") * (F.col("rank_lo") + 0.5 * F.col("n"))).alias("u"), F.sum("pos").alias("p"), F.sum("n").alias("q"))
    auc = F.try_divide(F.col("u"), (F.col("p") * F.col("q")).cast("double"))
    return u.withColumn("auc", auc).where("auc is not null").agg(F.try_divide(F.sum(F.col("auc") * F.col("p")), F.sum("p").cast("double")).alias("roc_auc_weighted"))


def regression_metrics(pred: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """I8: MAE, MSE, RMSE, R^2 (1 - SSE/SST) in one aggregate."""
    e = F.col(y_pred).cast("double") - F.col(y_true).cast("double")
    yt = F.col(y_true).cast("double")
    both = e.isNotNull()
    agg = pred.agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.sum(e * e).alias("sse"),
                   (F.var_pop(F.when(both, yt)) * F.count(e)).alias("sst"))  # not as a difference of large sums
    sst = F.col("sst")
    return agg.select("mae", "mse", F.sqrt("mse").alias("rmse"),
                      (F.lit(1.0) - F.try_divide(F.col("sse"), sst)).alias("r2"))


def _kv(name: str, col: str):
    return F.struct(F.lit(name).alias("metric"), F.col(col).cast("double").alias("value"))


def evaluation_dispatch(pred: DataFrame, problem_type: str) -> DataFrame:
    """Problem type -> metric set, as one long (metric, value) table; ROC AUC for binary predictions with a ``score``."""
    if problem_type in ("binary", "multiclass", "classification"):
        prf = per_class_prf(pred)
        parts = [accuracy(pred).select(F.inline(F.array(_kv("accuracy", "accuracy")))),
                 macro_prf(prf).select(F.inline(F.array(_kv("precision_macro", "macro_precision"),
                                                        _kv("recall_macro", "macro_recall"), _kv("f1_macro", "macro_f1")))),
                 weighted_prf(prf).select(F.inline(F.array(_kv("precision_weighted", "weighted_precision"),
                                                           _kv("recall_weighted", "weighted_recall"),
                                                           _kv("f1_weighted", "weighted_f1"))))]
        if problem_type == "binary" and "score" in pred.columns:
            parts.append(roc_auc(pred).select(F.inline(F.array(_kv("roc_auc", "roc_auc")))))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
    m = regression_metrics(pred, "y_true_num", "y_pred_num") if "y_true_num" in pred.columns else regression_metrics(pred)
    return m.select(F.inline(F.array(*[_kv(c, c) for c in ("mae", "mse", "rmse", "r2")])))


def leaderboard(scored: DataFrame, model: str = "model", y_true: str = "y_true", y_pred: str = "y_pred",
                split: str = "split") -> DataFrame:
    """Accuracy per model on test and validation rows, ranked by test score (ties by model)."""
    correct = (F.col(y_true) == F.col(y_pred)).cast("double")
    agg = scored.groupBy(model).agg(F.avg(F.when(F.col(split) == "test", correct)).alias("score_test"),
                                    F.avg(F.when(F.col(split) == "val", correct)).alias("score_val"))
    w = Window.orderBy(F.col("score_test").desc_nulls_last(), F.col(model))  # one row per model: small
    return agg.withColumn("rank", F.row_number().over(w))


def weighted_avg_loss(batches: DataFrame, loss: str = "loss", size: str = "batch_size", group: str | None = None) -> DataFrame:
    """sum(loss * n) / sum(n)."""
    g = [group] if group else []
    return batches.groupBy(*g).agg(
        F.try_divide(F.sum(F.col(loss) * F.col(size)), F.sum(size).cast("double")).alias("avg_loss"))


def inference_speed(timings: DataFrame, ms: str = "elapsed_ms", n: str = "samples", group: str | None = None) -> DataFrame:
    """Milliseconds per sample and samples per second."""
    g = [group] if group else []
    return timings.groupBy(*g).agg(
        F.try_divide(F.sum(ms).cast("double"), F.sum(n).cast("double")).alias("ms_per_sample"),
        F.try_divide(F.sum(n).cast("double") * 1000.0, F.sum(ms).cast("double")).alias("samples_per_sec"))


def stability_pct(iterations: DataFrame, success: str = "success", group: str = "run_id") -> DataFrame:
    """Successful iterations / all x 100 per run (100 when a run has none)."""
    return iterations.groupBy(group).agg(
        F.coalesce(F.avg(F.col(success).cast("double")) * 100.0, F.lit(100.0)).alias("stability_pct"))


def permutation_importance(model, test: DataFrame, features: list[str], id_col: str, metric_fn,
                           seed: int = 42) -> DataFrame:
    """Drop in test score after permuting one feature.

    The permutation pairs the row of id-rank k with the feature value of
    hash-rank k; both ranks come from the range-partitioned rank machinery,
    so the shuffle is an equi-join on rank (no global window, no collect).
    ``metric_fn(scored_df) -> float`` evaluates a scored frame.
    """
    from quarry.operators.freq import ranked_frequency
    from quarry.operators.sample import hash_key
    base = metric_fn(model.transform(test))
    one = F.lit(1).cast("long").alias("n")
    ids = ranked_frequency(test.select(F.lit("all").alias("column"), F.col(id_col).alias("value"), one))
    left = test.join(ids.select(F.col("value").alias("_id"), F.col("rank_lo").alias("_pos")), F.col(id_col) == F.col("_id")).drop("_id")
    keyed = test.withColumn("_h", F.struct(hash_key([id_col], seed).alias("h"), F.col(id_col).alias("id")))  # ties of the hash go by id
    hs = ranked_frequency(keyed.select(F.lit("all").alias("column"), F.col("_h").alias("value"), one))
    right_base = keyed.join(hs.select(F.col("value").alias("_h"), F.col("rank_lo").alias("_pos")), "_h")
    rows = []
    for f in features:
        right = right_base.select("_pos", F.col(f).alias("_perm"))
        shuffled = left.join(right, "_pos").drop(f, "_pos").withColumnRenamed("_perm", f)
        rows.append((f, float(base - metric_fn(model.transform(shuffled)))))
    return test.sparkSession.createDataFrame(rows, "feature string, importance double")
