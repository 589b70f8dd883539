"""Validation and task inference.

Table checks are single aggregates returning one result row; metadata rules
are Column expressions evaluated over a datasets DataFrame (one pass, no
Python per row).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the reference's validation and inference rules.
MIN_TRAIN_ROWS = {"classification": 50, "regression": 50, "clustering": 50}
MIN_COLUMNS = 2
MIN_AUTOML_ROWS = 100
MIN_CLASSES = 2
MIN_IMAGES_PER_CLASS = 10
MIN_DETECTION_IMAGES = 20
TARGET_NAMES = ("class", "label", "target", "y", "output", "outcome", "result", "category")

NAME_RULES = [  # priority order, substring match on lower(name)
    ("classification", ["classification", "classifier", "classes"]),
    ("regression", ["regression", "prediction", "forecast", "price", "sales"]),
    ("detection", ["detection", "detect", "yolo", "rcnn", "ssd"]),
    ("detection", ["segmentation", "segment", "mask", "semantic"]),
    ("classification", ["mnist", "cifar", "imagenet", "fashion", "flower", "animal", "pet",
                        "cat", "dog", "bird", "plant", "leaf", "fruit", "vehicle",
                        "credit", "fraud", "spam", "sentiment", "emotion", "toxicity",
                        "churn", "diagnosis", "disease", "symptom"]),
    ("regression", ["house", "housing", "apartment", "stock", "energy", "consumption",
                    "temperature", "weather", "sales", "revenue", "income", "salary",
                    "age", "rating", "score", "time_series", "timeseries"]),
    ("detection", ["face", "person", "people", "pedestrian", "vehicle",
                   "object", "coco", "voc", "anomaly", "defect", "crack"]),
]
DESCRIPTION_RULES = [
    ("classification", ["classify", "categorize", "category", "label"]),
    ("regression", ["predict", "estimate", "forecast", "continuous"]),
    ("detection", ["detect", "locate", "bounding box", "object"]),
]
CONFIDENCE_BASE = {"classification": 0.3, "regression": 0.2, "detection": 0.1, "clustering": 0.1}
CONFIDENCE_KEYWORDS = {
    "classification": ["classification", "classifier", "mnist", "cifar", "imagenet", "fraud", "sentiment"],
    "regression": ["regression", "prediction", "forecast", "price", "sales", "temperature"],
    "detection": ["detection", "detect", "yolo", "rcnn", "face", "object"],
}
HYPERPARAMETER_RANGES = {  # name: (low, low_inclusive, high, high_inclusive)
    "learning_rate": (0.0, False, 1.0, True),
    "batch_size": (1, True, 512, True),
    "dropout_rate": (0.0, True, 0.9, True),
    "epochs": (1, True, 100, True),
    "max_iterations": (1, True, 50, True),
    "target_accuracy": (0.0, True, 1.0, True),
}
OPTIMIZERS = ("Adam", "SGD", "RMSprop")


def _contains_any(c: Column, words) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | F.coalesce(c.contains(w), F.lit(False))
    return cond


# ---------------------------------------------------------------------------
# H1 / H2 / H7: table checks
# ---------------------------------------------------------------------------

def validate_split_tables(train: DataFrame, test: DataFrame, task: str | None = None) -> DataFrame:
    """H1: equal ordered columns, enough training rows for the task, >= 2 columns."""
    same = train.columns == test.columns
    need = MIN_TRAIN_ROWS.get(task or "", 0)
    n_train = train.agg(F.count(F.lit(1))).scalar()
    n_test = test.agg(F.count(F.lit(1))).scalar()
    reason = (F.when(F.lit(not same), F.lit("train and test columns differ"))
              .when(F.lit(len(train.columns) < MIN_COLUMNS), F.lit("need at least 2 columns"))
              .when(n_train < F.lit(need), F.lit(f"need at least {need} training rows")))
    return train.sparkSession.range(1).select(
        reason.isNull().alias("valid"), reason.alias("reason"), n_train.alias("train_rows"),
        n_test.alias("test_rows"), F.lit(len(train.columns)).alias("n_columns"))


def validate_single_table(df: DataFrame, task: str | None = None, train_ratio: float = 0.8) -> DataFrame:
    """H2: empty -> invalid; a split column decides the counts, else int(n * 0.8) / rest."""
    from quarry.operators.sample import SPLIT_COLUMN_NAMES, split_column, split_sizes
    col = next((c for c in df.columns if c.lower() in SPLIT_COLUMN_NAMES), None)
    if col is not None:
        s = split_column(df)
        return s.select(F.lit("split_column").alias("mode"), F.col("train_count").alias("train_rows"),
                        F.col("test_count").alias("test_rows"), "valid")
    s = split_sizes(df, train_ratio)
    need = MIN_TRAIN_ROWS.get(task or "", 0)
    return s.select(F.lit("auto_split").alias("mode"), "train_rows", "test_rows",
                    ((F.col("total_rows") > 0) & (F.col("train_rows") >= need)).alias("valid"))


def problem_type_validator(nunique: Column, is_numeric: Column) -> Column:
    """H8(a): numeric with > 20 distinct -> regression, else classification."""
    return F.when(is_numeric & (nunique > 20), F.lit("regression")).otherwise(F.lit("classification"))


def validate_automl(df: DataFrame, target: str) -> DataFrame:
    """H7: >= 100 rows, target present, >= 2 distinct, not all NULL; problem type; missing %."""
    spark = df.sparkSession
    if target not in df.columns:
        return spark.range(1).select(F.lit(False).alias("valid"), F.lit(f"target {target} not found").alias("reason"),
                                     F.lit(None).cast("long").alias("rows"), F.lit(None).cast("long").alias("target_unique"),
                                     F.lit(None).cast("string").alias("problem_type"),
                                     F.lit(None).cast("double").alias("missing_percent"))
    is_num = isinstance(df.schema[target].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                                                     T.FloatType, T.DoubleType, T.DecimalType))
    cells = F.lit(0)
    for c in df.columns:
        cells = cells + F.count_if(F.col(c).isNull())
    a = df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(target).alias("target_unique"),
               F.count(target).alias("target_nn"), cells.alias("null_cells"))
    reason = (F.when(F.col("rows") < MIN_AUTOML_ROWS, F.lit(f"need at least {MIN_AUTOML_ROWS} rows"))
              .when(F.col("target_nn") == 0, F.lit("target is all null"))
              .when(F.col("target_unique") < MIN_CLASSES, F.lit("target needs at least 2 distinct values")))
    return a.select(reason.isNull().alias("valid"), reason.alias("reason"), F.col("rows").cast("long").alias("rows"),
                    F.col("target_unique").cast("long").alias("target_unique"),
                    problem_type_validator(F.col("target_unique"), F.lit(is_num)).alias("problem_type"),
                    F.bround(F.col("null_cells") * 100.0 / (F.col("rows") * float(len(df.columns))), 2).alias("missing_percent"))


# ---------------------------------------------------------------------------
# H8: target-based task rules (four named policies)
# ---------------------------------------------------------------------------

def task_from_target(nunique: Column, n_rows: Column, is_numeric: Column, dtype: Column, policy: str,
                     given_task: Column | None = None) -> Column:
    """H8 (a) validator, (b) worker, (c) upload (returns supported list), (d) strategy (binary/multiclass)."""
    if policy == "validator":
        return problem_type_validator(nunique, is_numeric)
    if policy == "worker":
        ratio = F.try_divide(nunique.cast("double"), n_rows.cast("double"))
        return F.when(is_numeric & ((nunique > 10) | (ratio > 0.05)), F.lit("regression")).otherwise(F.lit("classification"))
    if policy == "upload":
        return (F.when((nunique >= 2) & (nunique <= 100), F.array(F.lit("classification"), F.lit("regression")))
                .when((nunique > 100) | F.lower(dtype).contains("float"), F.array(F.lit("regression")))
                .otherwise(F.array(F.lit("classification"), F.lit("regression"))))
    if policy == "strategy":
        return F.when(nunique == 2, F.lit("binary")).otherwise(F.lit("multiclass"))
    raise ValueError(policy)


# ---------------------------------------------------------------------------
# Metadata rules over a datasets DataFrame
# ---------------------------------------------------------------------------

def task_from_metadata(name: Column, domain: Column, description: Column, n_classes: Column,
                       has_annotations: Column, has_labels: Column, has_masks: Column) -> Column:
    """H9: keyword rules on name, then structure, then description, then the default."""
    n = F.lower(F.coalesce(name, F.lit("")))
    d = F.lower(F.coalesce(description, F.lit("")))
    dom = F.lower(F.coalesce(domain, F.lit("")))
    expr = None
    for task, words in NAME_RULES:
        expr = (F.when(_contains_any(n, words), F.lit(task)) if expr is None
                else expr.when(_contains_any(n, words), F.lit(task)))
    vision = dom == "vision"
    expr = (expr.when(vision & (F.coalesce(n_classes, F.lit(0)) >= 2), F.lit("classification"))
            .when(vision & (F.coalesce(has_annotations, F.lit(False)) | F.coalesce(has_labels, F.lit(False))), F.lit("detection"))
            .when(vision & F.coalesce(has_masks, F.lit(False)), F.lit("detection")))
    for task, words in DESCRIPTION_RULES:
        expr = expr.when(_contains_any(d, words), F.lit(task))
    return expr.otherwise(F.lit("classification"))


def task_confidence(name: Column, domain: Column, has_classes: Column, has_annotations: Column) -> Column:
    """Base scores + 0.3 per keyword + 0.2 structure, normalised; a map task -> share."""
    n = F.lower(F.coalesce(name, F.lit("")))
    vision = F.lower(F.coalesce(domain, F.lit(""))) == "vision"
    raw = {}
    for task, base in CONFIDENCE_BASE.items():
        s = F.lit(base)
        for kw in CONFIDENCE_KEYWORDS.get(task, []):
            s = s + F.when(n.contains(kw), F.lit(0.3)).otherwise(F.lit(0.0))
        if task == "classification":
            s = s + F.when(vision & F.coalesce(has_classes, F.lit(False)), F.lit(0.2)).otherwise(F.lit(0.0))
        if task == "detection":
            s = s + F.when(vision & F.coalesce(has_annotations, F.lit(False)), F.lit(0.2)).otherwise(F.lit(0.0))
        raw[task] = s
    total = sum(raw.values(), F.lit(0.0))
    return F.create_map(*[x for t, s in raw.items() for x in (F.lit(t), s / total)])


def supported_tasks(domain: Column, n_classes: Column, has_annotations: Column, has_labels: Column, has_masks: Column,
                    target_unique: Column, target_dtype: Column) -> Column:
    """H11 (+ tabular branch of H8c): supported task list; vision with < 2 classes listed yields none."""
    vision = domain == "vision"
    has_cls = n_classes.isNotNull()
    vis = (F.when(has_cls & (n_classes >= 2), F.array(F.lit("classification")))
           .when(has_cls, F.array().cast("array<string>"))
           .when(F.coalesce(has_annotations, F.lit(False)) | F.coalesce(has_labels, F.lit(False)), F.array(F.lit("detection")))
           .when(F.coalesce(has_masks, F.lit(False)), F.array(F.lit("detection")))
           .otherwise(F.array(F.lit("classification"))))
    tab = F.when(target_unique.isNull(), F.array(F.lit("classification"), F.lit("regression"))).otherwise(
        task_from_target(target_unique, F.lit(None), F.lit(True), F.coalesce(target_dtype, F.lit("")), "upload"))
    return F.when(vision, vis).when(domain == "tabular", tab).otherwise(F.array(F.lit("classification")))


def task_reasoning(domain: Column, n_classes: Column, has_annotations: Column, has_masks: Column,
                   target_unique: Column, target_dtype: Column) -> Column:
    """List of matched reasons."""
    vision = domain == "vision"
    reasons = F.array(
        F.when(vision & (n_classes >= 2), F.format_string("Vision dataset with %d class folders", n_classes)),
        F.when(vision & n_classes.isNull() & F.coalesce(has_annotations, F.lit(False)),
               F.lit("Dataset contains annotation files for object detection")),
        F.when(vision & n_classes.isNull() & ~F.coalesce(has_annotations, F.lit(False)) & F.coalesce(has_masks, F.lit(False)),
               F.lit("Dataset contains mask files for segmentation")),
        F.when((domain == "tabular") & (target_unique >= 2) & (target_unique <= 100),
               F.format_string("Target column has %d unique values (categorical)", target_unique)),
        F.when((domain == "tabular") & ((target_unique > 100) | (F.lower(target_dtype).contains("float") & ~((target_unique >= 2) & (target_unique <= 100)))),
               F.lit("Target column is continuous (regression)")),
        F.when((domain == "tabular") & target_unique.isNull(), F.lit("Tabular dataset (task depends on target column)")))
    return F.filter(reasons, lambda r: r.isNotNull())


def guess_target_column(columns: list[str]) -> str:
    """First column with a conventional target name, else the last column."""
    for c in columns:
        if c.lower() in TARGET_NAMES:
            return c
    return columns[-1]


def num_classes_from_path(listing: DataFrame, domain: str = "vision") -> DataFrame:
    """Class folders under train/ else top level (min 2); non-vision -> 2."""
    if domain != "vision":
        return listing.sparkSession.range(1).select(F.lit(2).alias("num_classes"))
    parts = F.col("parts")
    under_train = listing.filter((F.size(parts) >= 3) & (F.lower(parts[0]) == "train")).select(parts[1].alias("c"))
    top = listing.filter(F.size(parts) >= 2).select(parts[0].alias("c"))
    n_train = under_train.agg(F.count_distinct("c")).scalar()
    n_top = top.agg(F.count_distinct("c")).scalar()
    return listing.sparkSession.range(1).select(
        F.when(n_train > 0, n_train).otherwise(F.greatest(n_top, F.lit(2))).alias("num_classes"))


def task_from_metrics(metrics: Column) -> Column:
    """r2 / rmse / mae present -> regression, else classification."""
    reg = F.lit(False)
    for k in ("r2", "rmse", "mae"):
        reg = reg | F.coalesce(F.map_contains_key(metrics, k), F.lit(False))
    return F.when(reg, F.lit("regression")).otherwise(F.lit("classification"))


def hyperparameter_check(df: DataFrame) -> DataFrame:
    """One violation flag per range rule, plus the optimizer enum."""
    out = [F.col(c) for c in df.columns]
    bad = []
    for name, (lo, lo_inc, hi, hi_inc) in HYPERPARAMETER_RANGES.items():
        if name not in df.columns:
            continue
        c = F.col(name)
        ok = (c >= lo if lo_inc else c > lo) & (c <= hi if hi_inc else c < hi)
        flag = F.when(c.isNull(), F.lit(None)).otherwise(~ok)
        out.append(flag.alias(f"{name}_invalid"))
        bad.append(F.when(flag, F.lit(name)))
    if "optimizer" in df.columns:
        flag = ~F.col("optimizer").isin(*OPTIMIZERS)
        out.append(flag.alias("optimizer_invalid"))
        bad.append(F.when(flag, F.lit("optimizer")))
    out.append(F.filter(F.array(*bad), lambda x: x.isNotNull()).alias("violations"))
    return df.select(*out)


# ---------------------------------------------------------------------------
# H4-H6: image folder validation over listings (root/<split>/<class>/<file>)
# ---------------------------------------------------------------------------

def _split_class(listing: DataFrame) -> DataFrame:
    parts = F.col("parts")
    return listing.filter(F.size(parts) >= 3).select(F.lower(parts[0]).alias("split"), parts[1].alias("class"), "path")


def validate_image_classes(listing: DataFrame, min_per_class: int = MIN_IMAGES_PER_CLASS) -> tuple[DataFrame, DataFrame]:
    """H4: >= 2 classes, equal train/test class sets, >= 10 training images per class (test not checked).

    Returns (per-class counts, one-row verdict).
    """
    sc = _split_class(listing).filter(F.col("split").isin("train", "test"))
    per_class = (sc.groupBy("class").pivot("split", ["train", "test"]).count().fillna(0)
                 .withColumn("total", F.col("train") + F.col("test")))
    v = per_class.agg(
        F.count(F.lit(1)).alias("n_classes"),
        F.count_if(F.col("train") == 0).alias("missing_in_train"),
        F.count_if(F.col("test") == 0).alias("missing_in_test"),
        F.count_if(F.col("train") < min_per_class).alias("too_small"))
    reason = (F.when(F.col("n_classes") < MIN_CLASSES, F.lit("need at least 2 classes"))
              .when((F.col("missing_in_train") > 0) | (F.col("missing_in_test") > 0), F.lit("train and test class sets differ"))
              .when(F.col("too_small") > 0, F.lit(f"need at least {min_per_class} training images per class")))
    return per_class, v.select(reason.isNull().alias("valid"), reason.alias("reason"), "n_classes")


def validate_image_detection(images: DataFrame, files: DataFrame) -> DataFrame:
    """H5: >= 20 training images; annotations.json, labels/ or *.xml present in both splits."""
    parts = F.col("parts")
    img = images.filter(F.size(parts) >= 2).select(F.lower(parts[0]).alias("split"))
    f = files.filter(F.size(parts) >= 2).select(F.lower(parts[0]).alias("split"), F.col("rel"))
    ann = (F.lower(F.col("rel")).endswith("annotations.json") | F.col("rel").contains("/labels/")
           | F.lower(F.col("rel")).endswith(".xml"))
    a = f.groupBy().agg(F.max(F.when((F.col("split") == "train") & ann, 1).otherwise(0)).alias("ann_train"),
                        F.max(F.when((F.col("split") == "test") & ann, 1).otherwise(0)).alias("ann_test"))
    n_train = img.filter(F.col("split") == "train").agg(F.count(F.lit(1))).scalar()
    reason = (F.when(n_train < MIN_DETECTION_IMAGES, F.lit(f"need at least {MIN_DETECTION_IMAGES} training images"))
              .when((F.col("ann_train") == 0) | (F.col("ann_test") == 0), F.lit("annotations missing in a split")))
    return a.select(reason.isNull().alias("valid"), reason.alias("reason"), n_train.alias("train_images"))


def validate_vision(images: DataFrame, task: str | None = None) -> DataFrame:
    """H6: train and test folders needed; without a task, >= 1 image in each."""
    parts = F.col("parts")
    s = images.filter(F.size(parts) >= 2).groupBy().agg(
        F.count_if(F.lower(parts[0]) == "train").alias("train_images"),
        F.count_if(F.lower(parts[0]) == "test").alias("test_images"))
    reason = F.when((F.col("train_images") == 0) | (F.col("test_images") == 0), F.lit("need train and test folders with images"))
    return s.select(reason.isNull().alias("valid"), reason.alias("reason"), "train_images", "test_images")


def column_set_compare(a_cols: list[str], b_cols: list[str]) -> dict:
    """train/test column lists must be equal and in the same order (schema-level check)."""
    return {"equal": list(a_cols) == list(b_cols), "same_set": set(a_cols) == set(b_cols),
            "only_in_a": sorted(set(a_cols) - set(b_cols)), "only_in_b": sorted(set(b_cols) - set(a_cols))}


def validate_tabular(spark, directory: str, task: str | None = None) -> DataFrame:
    """H3: train+test files -> H1; otherwise the first other data file -> H2; no data file -> error."""
    from quarry.sources.tables import list_data_files, read_table
    files = [r["path"] for r in list_data_files(spark, directory).select("path").collect()]  # directory listing
    names = {p.rsplit("/", 1)[-1].lower(): p for p in files}
    train = next((p for n, p in names.items() if n.startswith("train")), None)
    test = next((p for n, p in names.items() if n.startswith("test")), None)
    if train and test:
        return validate_split_tables(read_table(spark, train), read_table(spark, test), task)
    others = [p for p in files if p not in (train, test)]
    if not others:
        raise ValueError(f"no data file found in {directory}")
    return validate_single_table(read_table(spark, others[0]), task)
