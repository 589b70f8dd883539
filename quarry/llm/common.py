"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import ensure_checkpoint_dir

#: Stands for a null id inside an operator, so that null ids survive joins; turned back at the end.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/llm-{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep_by(df: DataFrame, name: str, column: str) -> DataFrame:
    """``keep`` in hash buckets of ``column``, one per shuffle partition, so that a later join on it needn't shuffle these rows.

    The files lie in the shared folder; the session's catalog holds the table's name.
    """
    spark, as_table = df.sparkSession, f"llm_{name.replace('-', '_')}_{uuid.uuid4().hex[:12]}"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{as_table}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("compression", "zstd").option("path", path).bucketBy(n, column).saveAsTable(as_table, format="parquet")
    return spark.table(as_table)


def drop_kept(df: DataFrame) -> None:
    """Delete a table that ``keep`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Give back driver memory that earlier work no longer needs: Python's and Arrow's freed blocks, and what the JVM holds for
    unreachable broadcasts, shuffles and plans."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
    spark.sparkContext._jvm.System.gc()


def with_id(df: DataFrame, id_col: str, text_col: str, as_id: str = "doc_id", as_text: str = "text") -> DataFrame:
    """Only the id (null as NULL_ID) and the text (null as empty) of ``df``: clashing extra columns stay out."""
    return df.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias(as_id),
                     F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias(as_text))


def null_id(name: str):
    """The id as the caller knows it."""
    return F.when(F.col(name) != F.lit(NULL_ID), F.col(name)).alias(name)


def hash_below(id_col: str, share) -> Column:
    """Whether the hash of an id lies in the first ``share`` (number or column) of its range: the same rows on every run."""
    return F.pmod(F.xxhash64(id_col), F.lit(2**40)) < F.least(F.lit(1.0), share if isinstance(share, Column) else F.lit(float(share))) * float(2**40)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` for a function of one record batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := fn(b)) is not None and out.num_rows:
                yield out
            del b
            pa.default_memory_pool().release_unused()
    return df.mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (xor-shift-multiply), element by element."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
