"""A schema's rules as data, compiled to Spark jobs.

Rules are CHECK predicates, UNIQUE column lists and foreign keys with what a
delete does. ``violations`` compiles them to one scan per table for all its
CHECKs (an array of failed rules, exploded), one aggregation per UNIQUE and one
anti join per foreign key. ``delete`` follows the foreign keys from the deleted
rows through all tables below them, parents first.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CASCADE, SET_NULL = "cascade", "set null"


@dataclass(frozen=True)
class Check:
    """Rows violate it where ``predicate`` (SQL) is false; NULL passes."""
    table: str
    name: str
    predicate: str


@dataclass(frozen=True)
class Unique:
    """Rows violate it that agree in all ``columns``, none of them NULL."""
    table: str
    name: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class ForeignKey:
    """``table.column`` names an id of ``parent`` or is NULL; ``on_delete`` is what happens to the row with its parent gone."""
    table: str
    column: str
    parent: str
    on_delete: str
    name: str = ""


# Fixed values of the reference schema: keys with their delete rules, unique keys, value lists and ranges.
FOREIGN_KEYS = [
    ForeignKey("models", "dataset_id", "datasets", SET_NULL, "fk_dataset"),
    ForeignKey("training_runs", "model_id", "models", CASCADE, "fk_model"),
    ForeignKey("training_runs", "dataset_id", "datasets", SET_NULL, "fk_dataset"),
    ForeignKey("training_logs", "training_run_id", "training_runs", CASCADE, "fk_run"),
    ForeignKey("model_versions", "model_id", "models", CASCADE, "fk_model"),
    ForeignKey("model_versions", "training_run_id", "training_runs", SET_NULL, "fk_run"),
    ForeignKey("jobs", "model_id", "models", CASCADE, "fk_model"),
    ForeignKey("jobs", "dataset_id", "datasets", CASCADE, "fk_dataset"),
]
UNIQUES = [Unique("model_versions", "unique_model_version", ("model_id", "version"))]
CHECKS = [
    Check("datasets", "domain", "domain IN ('vision', 'tabular')"),
    Check("datasets", "readiness", "readiness IN ('draft', 'processing', 'ready', 'failed')"),
    Check("datasets", "total_samples", "total_samples >= 0"),
    Check("datasets", "file_size", "file_size > 0"),
    Check("models", "task", "task IN ('classification', 'regression', 'clustering', 'detection', 'unknown')"),
    Check("models", "framework", "framework IN ('pytorch', 'tensorflow', 'sklearn')"),
    Check("models", "status", "status IN ('draft', 'queued', 'training', 'ready', 'active', 'failed')"),
    Check("models", "accuracy", "accuracy >= 0 AND accuracy <= 100"),
    Check("training_runs", "status", "status IN ('pending', 'queued', 'running', 'completed', 'failed', 'stopped')"),
    Check("training_runs", "epochs", "current_epoch >= 0 AND (total_epochs IS NULL OR current_epoch <= total_epochs)"),
    Check("training_logs", "log_level", "log_level IN ('DEBUG', 'INFO', 'WARNING', 'ERROR', 'CRITICAL')"),
    Check("jobs", "status", "status IN ('pending', 'running', 'completed', 'failed')"),
]


def parents_first(tables: list[str], keys: list[ForeignKey]) -> list[str]:
    """The tables in an order in which every parent comes before its children; a cycle is an error."""
    left, out = list(tables), []
    while left:
        free = [t for t in left if not any(k.table == t and k.parent in left for k in keys)]
        if not free:
            raise ValueError(f"foreign keys form a cycle among {left}")
        out += free
        left = [t for t in left if t not in free]
    return out


def below(table: str, keys: list[ForeignKey]) -> list[str]:
    """All tables that a delete in ``table`` can change, itself included: the transitive closure of the cascades, and the
    tables with keys of rows that these remove."""
    removed = {table}
    while more := {k.table for k in keys if k.on_delete == CASCADE and k.parent in removed} - removed:
        removed |= more
    return sorted(removed | {k.table for k in keys if k.parent in removed})


def delete(tables: dict[str, DataFrame], doomed: dict[str, DataFrame], keys: list[ForeignKey] | None = None, id_col: str = "id") -> dict[str, DataFrame]:
    """What is left of each table when the rows named in ``doomed`` (table -> DataFrame with ``id_col``) go.

    CASCADE removes the children of removed rows, and theirs in turn; SET NULL clears
    the key of rows that stay. Every step is an equi join on ids; tables that nothing
    reaches come back as they are.
    """
    keys = [k for k in (FOREIGN_KEYS if keys is None else keys) if k.table in tables and k.parent in tables]
    if unknown := set(doomed) - set(tables):
        raise ValueError(f"unknown tables: {sorted(unknown)}")
    gone: dict[str, DataFrame] = {}
    left = dict(tables)
    for name in parents_first(list(tables), keys):
        rows, own = tables[name], [k for k in keys if k.table == name and k.parent in gone]
        ids = [doomed[name].select(F.col(id_col))] if name in doomed else []
        ids += [rows.join(gone[k.parent].withColumnRenamed(id_col, k.column), k.column, "left_semi").select(id_col) for k in own if k.on_delete == CASCADE]
        if ids:
            gone[name] = reduce(DataFrame.union, ids).where(F.col(id_col).isNotNull()).distinct()
            rows = rows.join(gone[name], id_col, "left_anti")
        for k in own:
            if k.on_delete == SET_NULL:
                lost = gone[k.parent].select(F.col(id_col).alias(k.column), F.lit(True).alias("_lost"))
                rows = rows.join(lost, k.column, "left").withColumn(k.column, F.when(F.col("_lost").isNull(), F.col(k.column))).drop("_lost")
        left[name] = rows.select(*tables[name].columns)
    return left


def violations(tables: dict[str, DataFrame], rules: list | None = None, id_col: str = "id") -> DataFrame:
    """``(table, rule, id)`` for every row that breaks a rule whose tables are all given."""
    rules = [*CHECKS, *UNIQUES, *FOREIGN_KEYS] if rules is None else rules
    parts = []
    for name, rows in tables.items():
        checks = [r for r in rules if isinstance(r, Check) and r.table == name]
        if checks:
            failed = F.array_compact(F.array(*[F.when(~F.expr(f"({r.predicate})"), F.lit(r.name)) for r in checks]))
            parts.append(rows.select(F.lit(name).alias("table"), F.explode(failed).alias("rule"), F.col(id_col).alias("id")))
    for r in rules:
        if r.table not in tables:
            continue
        rows = tables[r.table]
        if isinstance(r, Unique):
            cols = list(r.columns)
            twice = rows.dropna(subset=cols).groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
            parts.append(rows.join(twice, cols, "left_semi").select(F.lit(r.table).alias("table"), F.lit(r.name).alias("rule"), F.col(id_col).alias("id")))
        elif isinstance(r, ForeignKey) and r.parent in tables:
            known = tables[r.parent].select(F.col(id_col).alias("_parent"))
            child = rows.select(F.col(id_col).alias("id"), F.col(r.column).alias("_parent")).where("_parent is not null")
            parts.append(child.join(known, "_parent", "left_anti").select(F.lit(r.table).alias("table"), F.lit(r.name or r.column).alias("rule"), "id"))
    return reduce(DataFrame.union, parts)
