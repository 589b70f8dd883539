"""quarry: dataset profiling, preparation, evaluation and experiment analytics on Spark.

Every operator is a function ``DataFrame (+ params) -> DataFrame`` built from
DataFrame / Spark SQL expressions so that Catalyst plans it and executors run it.
"""

from quarry.session import get_spark, ensure_checkpoint_dir

__all__ = ["get_spark", "ensure_checkpoint_dir"]
