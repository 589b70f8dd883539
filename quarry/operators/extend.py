"""Extension surface: stage events from a callback, and profile metrics that callers register.

Own estimators go to J1 as they are (``automl_fit(estimators=...)``).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.profile import columns_by_kind

EVENTS = "job_id long, event_id long, stage int, name string, event string, message string, ts timestamp_ntz"


class StageEvents:
    """A callback ``(stage, status)`` that appends event rows to a table, the input of M14, M15 and M18.

    Statuses are start, complete or error. Stages are numbered as they first appear.
    Rows are written in batches of ``every``; ``flush`` writes what is left. One log
    belongs to one job, and its driver thread writes it.
    """

    def __init__(self, spark: SparkSession, folder: str, job_id: int, every: int = 50, clock: Callable[[], dt.datetime] | None = None) -> None:
        self.spark, self.folder, self.job_id, self.every = spark, folder, job_id, every
        self.clock = clock or (lambda: dt.datetime.now(dt.UTC).replace(tzinfo=None))
        self.stages: dict[str, int] = {}
        self.rows: list[tuple] = []
        self.sent = 0

    def __call__(self, stage: str, status: str, message: str | None = None) -> None:
        if status not in ("start", "complete", "error"):
            raise ValueError(f"unknown status: {status}")
        number = self.stages.setdefault(stage, len(self.stages) + 1)
        self.rows.append((self.job_id, self.sent + len(self.rows) + 1, number, stage, status, message, self.clock()))
        if len(self.rows) >= self.every:
            self.flush()

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        """Start and complete events around a block; an error event, with its text, if it raises."""
        self(name, "start")
        try:
            yield
        except Exception as e:
            self(name, "error", str(e).splitlines()[0][:500] if str(e) else type(e).__name__)
            self.flush()
            raise
        self(name, "complete")

    def flush(self) -> None:
        if self.rows:
            self.spark.createDataFrame(self.rows, EVENTS).coalesce(1).write.mode("append").parquet(self.folder)
            self.sent, self.rows = self.sent + len(self.rows), []

    def table(self) -> DataFrame:
        """All events of the folder, other jobs' included."""
        self.flush()
        return self.spark.read.schema(EVENTS).parquet(self.folder)


@dataclass(frozen=True)
class Metric:
    """One number per column: ``expr`` makes an aggregate of the column, for columns of the given kinds."""
    name: str
    expr: Callable[[Column], Column]
    kinds: tuple[str, ...] = ("numeric",)


METRICS: dict[str, Metric] = {}


def register_metric(name: str, expr: Callable[[Column], Column], kinds: tuple[str, ...] = ("numeric",)) -> None:
    """Make a metric part of every later ``metric_profile``; a name can be given again, the last one counts."""
    if unknown := set(kinds) - {"bool", "numeric", "categorical", "datetime", "other"}:
        raise ValueError(f"unknown column kinds: {sorted(unknown)}")
    METRICS[name] = Metric(name, expr, tuple(kinds))


def metric_profile(df: DataFrame, cols: list[str] | None = None, metrics: list[Metric] | None = None) -> DataFrame:
    """``(column, metric, value)`` of the registered (or given) metrics, all in one aggregate over the table."""
    wanted = list(METRICS.values()) if metrics is None else metrics
    pairs = [(c, m) for kind, names in columns_by_kind(df).items() for c in names if cols is None or c in cols for m in wanted if kind in m.kinds]
    if not pairs:
        return df.sparkSession.createDataFrame([], "column string, metric string, value double")
    row = df.agg(*[m.expr(F.col(f"`{c}`")).cast("double").alias(f"v{i}") for i, (c, m) in enumerate(pairs)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(m.name).alias("metric"), F.col(f"v{i}").alias("value")) for i, (c, m) in enumerate(pairs)])))
