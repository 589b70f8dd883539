"""Scans, listings and sinks.

Directory listings go through the ``binaryFile`` source with only metadata
columns selected, so file contents are never read for a listing.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# Fixed values that must equal the reference's behaviour.
DATA_EXTENSIONS = (".csv", ".parquet", ".pq")
VALIDATOR_IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "gif", "tif")
TRAINER_IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "tif", "tiff")
MIN_IMAGE_SIDE = 32


def load(spark: SparkSession, sf_dir: str, name: str, where: Column | str | None = None) -> DataFrame:
    """Driver table ``name`` from ``sf_dir`` (one parquet file per table), NaN as NULL.

    ``where`` filters the columns as stored, so that filters on doubles, too, reach
    the Parquet reader. NaN is no NULL there yet; it is greater than any number.
    """
    rows = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return nan_to_null(rows if where is None else rows.where(where))


def nan_to_null(df: DataFrame) -> DataFrame:
    """pandas has one missing concept, Spark two: fold NaN into NULL at ingest."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.when(F.isnan(f.name), F.lit(None)).otherwise(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def _path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hpath)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A1: dispatch on suffix (.csv / .parquet / .pq)."""
    lower = path.lower()
    if not lower.endswith(DATA_EXTENSIONS):
        raise ValueError(f"Unsupported file format: {path}")
    if not _path_exists(spark, path):
        raise FileNotFoundError(path)
    if lower.endswith(".csv"):
        reader = spark.read.option("header", True)
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
        return nan_to_null(reader.csv(path))
    return nan_to_null(spark.read.parquet(path))


def file_format(path: Column) -> Column:
    """A2: suffix -> csv / parquet / unknown."""
    p = F.lower(path)
    return (F.when(p.endswith(".csv"), F.lit("csv"))
            .when(p.endswith(".parquet") | p.endswith(".pq"), F.lit("parquet"))
            .otherwise(F.lit("unknown")))


def _listing(spark: SparkSession, root: str, recursive: bool) -> DataFrame:
    reader = spark.read.format("binaryFile")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    # only metadata columns are selected: the binaryFile source prunes `content`.
    return (reader.load(root).select("path", "length", "modificationTime")
            .withColumn("name", F.element_at(F.split("path", "/"), -1)))


def list_data_files(spark: SparkSession, directory: str, extensions=DATA_EXTENSIONS) -> DataFrame:
    """A3: non-recursive listing of data files, sorted by path."""
    df = _listing(spark, directory, recursive=False)
    cond = F.lit(False)
    for ext in extensions:
        cond = cond | F.lower("name").endswith(ext)
    return df.filter(cond).withColumn("format", file_format(F.col("path"))).orderBy("path")


def load_csv_nonempty(spark: SparkSession, path: str) -> DataFrame:
    """A4: local CSV; an empty frame is an error."""
    df = read_table(spark, path)
    if df.isEmpty():
        raise ValueError(f"Loaded dataset is empty: {path}")
    return df


def write_csv(df: DataFrame, path: str) -> str:
    """A5: CSV sink with header; parent folders are created by the writer."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def dataset_size(spark: SparkSession, root: str) -> DataFrame:
    """Recursive file count and total bytes, skipping hidden names and .DS_Store."""
    df = _listing(spark, root, recursive=True)
    keep = ~F.col("name").startswith(".") & (F.col("name") != ".DS_Store")
    return df.filter(keep).agg(F.count(F.lit(1)).alias("file_count"),
                               F.coalesce(F.sum("length"), F.lit(0)).cast("bigint").alias("total_bytes"))


def dataset_columns(df: DataFrame) -> DataFrame:
    """One row per column: name, dtype, position, row and column counts."""
    schema_rows = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column_name"),
                 F.lit(f.dataType.simpleString()).alias("dtype"))
        for i, f in enumerate(df.schema.fields)])
    # the count is one global aggregate (partial counts per task); the schema rows
    # are generated next to that single row, no join needed.
    return (df.agg(F.count(F.lit(1)).alias("n_rows"))
            .select(F.inline(schema_rows), "n_rows", F.lit(len(df.columns)).alias("n_cols")))


def _ext_filter(name: Column, extensions) -> Column:
    pattern = r"(?i)\.(" + "|".join(extensions) + r")$"
    return name.rlike(pattern)


def image_scan(spark: SparkSession, root: str) -> DataFrame:
    """Decodable images with an accepted extension and both sides >= 32 px."""
    img = (spark.read.format("image").option("dropInvalid", True)
           .option("recursiveFileLookup", "true").load(root))
    out = img.select(F.col("image.origin").alias("path"), F.col("image.width").alias("width"),
                     F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"))
    name = F.element_at(F.split("path", "/"), -1)
    return out.filter(_ext_filter(name, VALIDATOR_IMAGE_EXTENSIONS)
                      & (F.col("width") >= MIN_IMAGE_SIDE) & (F.col("height") >= MIN_IMAGE_SIDE))


def image_name_filter(path: Column) -> Column:
    """Trainer rule: excludes '._*' and '.DS_Store', extension list with tiff and without gif."""
    name = F.element_at(F.split(path, "/"), -1)
    return (~name.startswith("._")) & (name != ".DS_Store") & _ext_filter(name, TRAINER_IMAGE_EXTENSIONS)


def image_listing(spark: SparkSession, root: str) -> DataFrame:
    """Listing of candidate image files under ``root`` with path parts split out."""
    df = _listing(spark, root, recursive=True).filter(image_name_filter(F.col("path")))
    rel = F.regexp_replace("path", r"^.*?" + _regex_escape(root.rstrip("/")) + "/", "")
    return df.withColumn("rel", rel).withColumn("parts", F.split("rel", "/"))


def _regex_escape(s: str) -> str:
    import re
    return re.escape(s)


def class_root(spark: SparkSession, root: str) -> DataFrame:
    """A10: depth (0 or 1) whose sub-folders hold the images, with the class folder names."""
    df = image_listing(spark, root).withColumn("depth", F.size("parts") - 1)
    # depth 1: root/<class>/img ; depth 2: root/<x>/<class>/img
    return (df.filter(F.col("depth").isin(1, 2))
            .groupBy((F.col("depth") - 1).alias("class_root_depth"))
            .agg(F.count(F.lit(1)).alias("images"),
                 F.count_distinct(F.element_at("parts", -2)).alias("classes"))
            .orderBy("class_root_depth").limit(1))


def read_registry_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Legacy JSON arrays; a malformed file yields no rows instead of failing."""
    return spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").schema(schema).json(path)


def restore_catalog(spark: SparkSession, root: str) -> DataFrame:
    """Rebuild dataset rows from ``root/<dataset>/test/<class>/<file>``."""
    df = image_listing(spark, root)
    df = df.filter((F.size("parts") >= 4) & (F.element_at("parts", 2) == "test"))
    return (df.groupBy(F.element_at("parts", 1).alias("dataset_id"))
            .agg(F.count_distinct(F.element_at("parts", 3)).alias("num_classes"),
                 F.count(F.lit(1)).alias("test_files"),
                 F.array_sort(F.collect_set(F.element_at("parts", 3))).alias("classes")))


def result_sink_json(df: DataFrame, path: str) -> str:
    """Summaries and metrics as JSON lines."""
    df.write.mode("overwrite").json(path)
    return path


def model_sink(model, path: str) -> str:
    """Persist a fitted Spark ML model (PipelineModel or any MLWritable)."""
    model.write().overwrite().save(path)
    return path
