"""Experiment registry queries.

Registry tables are DataFrames (datasets, models, training_runs, jobs, ...).
Lookups are equi-joins that Catalyst may broadcast when the planner's size
estimate allows; "latest per key" uses ``max_by`` aggregation (partial per
task, so a hot key is combined before the shuffle), never a per-key window
over raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.constraints import CHECKS, FOREIGN_KEYS, violations

# The eight pipeline stages and the registry enumerations.
PIPELINE_STAGES = ["Type Conversion", "Data Sampling", "Profile Generation (Sampled)", "Preprocessing Insights Generation",
                   "Preprocessing Code Execution", "Profile Generation (Preprocessed)", "Model Recommendation", "Model Training"]
ENUMS = {
    "datasets.domain": ["vision", "tabular"],
    "datasets.readiness": ["draft", "processing", "ready", "failed"],
    "models.task": ["classification", "regression", "clustering", "detection", "unknown"],
    "models.framework": ["pytorch", "tensorflow", "sklearn"],
    "models.status": ["draft", "queued", "training", "ready", "active", "failed"],
    "training_runs.status": ["pending", "queued", "running", "completed", "failed", "stopped"],
    "jobs.status": ["pending", "running", "completed", "failed"],
}


def list_filtered(df: DataFrame, equals: dict | None = None, search: str | None = None, search_col: str = "name",
                  order_col: str = "created_at") -> DataFrame:
    """Optional equality filters, case-insensitive substring search, newest first."""
    for c, v in (equals or {}).items():
        if v is not None:
            df = df.filter(F.col(c) == F.lit(v))
    if search:
        df = df.filter(F.col(search_col).ilike(f"%{search}%"))
    return df.orderBy(F.col(order_col).desc(), F.col("id"))


def get_by_id(df: DataFrame, id_value: str) -> DataFrame:
    """Point lookup (zero or one row)."""
    return df.filter(F.col("id") == F.lit(id_value))


def tag_search(df: DataFrame, tag: str, tags_col: str = "tags") -> DataFrame:
    """Rows whose tag array contains ``tag``."""
    return df.filter(F.array_contains(F.col(tags_col), tag))


def rename_project(df: DataFrame, names: dict[str, str], lifted: dict[str, str] | None = None) -> DataFrame:
    """Columns under the names of the interface (old -> new), and fields lifted out of JSON columns (new -> ``column.path``), as text."""
    lift = [F.get_json_object(F.col(p.split(".", 1)[0]), "$." + p.split(".", 1)[1]).alias(new) for new, p in (lifted or {}).items()]
    return df.select(*[F.col(old).alias(new) for old, new in names.items()], *lift)


def coalesce_defaults(df: DataFrame) -> DataFrame:
    """NULL -> defaults (size 0, path '', tags [])."""
    return df.select(*[c for c in df.columns if c not in ("file_size", "file_path", "tags")],
                     F.coalesce("file_size", F.lit(0).cast("bigint")).alias("size"),
                     F.coalesce("file_path", F.lit("")).alias("path"),
                     F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


def recent_activity(datasets: DataFrame, models: DataFrame, per_source: int = 3, total: int = 5) -> DataFrame:
    """Latest 3 datasets + latest 3 models -> newest 5 (top-k per side, then top-k)."""
    d = datasets.select(F.lit("dataset").alias("kind"), "id", "name", "created_at").orderBy(
        F.col("created_at").desc(), "id").limit(per_source)
    m = models.select(F.lit("model").alias("kind"), "id", "name", "created_at").orderBy(
        F.col("created_at").desc(), "id").limit(per_source)
    return d.unionByName(m).orderBy(F.col("created_at").desc(), "kind", "id").limit(total)


def class_set_compare(a: DataFrame, b: DataFrame, col: str = "class") -> DataFrame:
    """Classes only in a, only in b, and whether the sets are equal (full outer join of distincts)."""
    da = a.select(F.col(col).alias("class")).distinct().withColumn("in_a", F.lit(True))
    db = b.select(F.col(col).alias("class")).distinct().withColumn("in_b", F.lit(True))
    j = da.join(db, "class", "full")
    return j.select("class", F.coalesce("in_a", F.lit(False)).alias("in_a"), F.coalesce("in_b", F.lit(False)).alias("in_b"))


def distinct_ids(df: DataFrame, col: str) -> DataFrame:
    """Integer ids, unparsable dropped, deduplicated."""
    return df.select(F.col(col).cast("string").try_cast("bigint").alias("id")).filter(F.col("id").isNotNull()).distinct()


def active_runs(runs: DataFrame, models: DataFrame, datasets: DataFrame) -> DataFrame:
    """L1: runs INNER JOIN models LEFT JOIN datasets where status in (running, queued)."""
    r = runs.filter(F.col("status").isin("running", "queued"))
    m = models.select(F.col("id").alias("model_id"), F.col("name").alias("model_name"), F.col("task"))
    d = datasets.select(F.col("id").alias("dataset_id"), F.col("name").alias("dataset_name"))
    return r.join(m, "model_id").join(d, "dataset_id", "left")


def model_statistics(models: DataFrame, runs: DataFrame) -> DataFrame:
    """L2: per model total/completed/failed runs, best accuracy and loss (aggregate runs first)."""
    agg = runs.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("total_runs"), F.count_if(F.col("status") == "completed").alias("successful_runs"),
        F.count_if(F.col("status") == "failed").alias("failed_runs"),
        F.max("final_accuracy").alias("best_accuracy"), F.min("final_loss").alias("best_loss"))
    m = models.select("id", "name", "task", "framework", "status")
    return m.join(agg, m.id == agg.model_id, "left").select(
        "id", "name", "task", "framework", "status",
        F.coalesce("total_runs", F.lit(0)).cast("long").alias("total_runs"),
        F.coalesce("successful_runs", F.lit(0)).cast("long").alias("successful_runs"),
        F.coalesce("failed_runs", F.lit(0)).cast("long").alias("failed_runs"), "best_accuracy", "best_loss")


def next_run_number(runs: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """L3: batch numbering: base max(run_number) per model (NULL/0 -> 0) + position by created_at.

    Positions come from the segmented scan (range partitioned on model,
    created_at, id), so a model with a huge run history is spread over tasks.
    """
    from quarry.operators.ordered import segmented_scan
    num = segmented_scan(runs.withColumn("_one", F.lit(1)), ["model_id"], ["created_at", "id"], {"_pos": ("rownum", "_one")})
    if existing is not None:
        base = existing.groupBy("model_id").agg(F.coalesce(F.max("run_number"), F.lit(0)).alias("_base"))
        num = num.join(base, "model_id", "left")
    else:
        num = num.withColumn("_base", F.lit(0))
    return num.withColumn("run_number", (F.coalesce("_base", F.lit(0)) + F.col("_pos")).cast("int")).drop("_one", "_pos", "_base")


def training_history(runs: DataFrame, now: Column) -> DataFrame:
    """L4: runs newest first; duration = stored, else completed - started, else now - started while active."""
    from quarry.functions.scalar import seconds_between
    active = F.col("status").isin("running", "pending")
    dur = F.coalesce(
        F.col("duration_seconds").cast("long"),
        seconds_between(F.col("started_at"), F.col("completed_at")),
        F.when(active, seconds_between(F.col("started_at"), now)))
    return runs.select("id", "model_id", "status", "created_at", dur.alias("duration"))


def latest_per_key(df: DataFrame, key: str, order_col: str = "created_at", tie: str = "id") -> DataFrame:
    """Newest row per key via max_by over a struct (partial aggregation, hot keys combine early)."""
    cols = [c for c in df.columns if c != key]
    latest = df.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(F.col(order_col), F.col(tie))).alias("_r"))
    return latest.select(key, "_r.*")


def dashboard_counts(datasets: DataFrame, models: DataFrame) -> DataFrame:
    """Ready datasets, all models, models training or queued."""
    d = datasets.agg(F.count_if(F.col("readiness") == "ready").alias("ready_datasets"))
    m = models.agg(F.count(F.lit(1)).alias("total_models"),
                   F.count_if(F.col("status").isin("training", "queued")).alias("training_models"))
    return d.select("ready_datasets", m.select("total_models").scalar().alias("total_models"),
                    m.select("training_models").scalar().alias("training_models"))


def stage_template_merge(stage_events: DataFrame, job_col: str = "job_id") -> DataFrame:
    """The 8 fixed stages left-joined with reported stage states, default pending."""
    from quarry.operators.telemetry import stage_state
    states = stage_state(stage_events, job_col)
    jobs = stage_events.select(job_col).distinct()
    tmpl = jobs.select(job_col, F.posexplode(F.array(*[F.lit(s) for s in PIPELINE_STAGES])).alias("pos", "name"))
    tmpl = tmpl.select(job_col, (F.col("pos") + 1).alias("stage"), "name")
    return tmpl.join(states, [job_col, "stage"], "left").select(
        job_col, "stage", "name", F.coalesce("status", F.lit("pending")).alias("status"))


def waiting_jobs(jobs: DataFrame) -> DataFrame:
    """Number of jobs that are queued or pending (one row, also without any)."""
    return jobs.agg(F.count_if(F.col("status").isin("queued", "pending")).cast("long").alias("waiting_jobs"))


def job_model_summary(jobs: DataFrame, models: DataFrame) -> DataFrame:
    """Job projection + model status by left join."""
    m = models.select(F.col("id").alias("model_id"), F.col("status").alias("model_status"))
    return jobs.select("id", "job_type", "status", "model_id", "created_at").join(m, "model_id", "left")


def pending_job_triage(jobs: DataFrame, datasets: DataFrame) -> DataFrame:
    """pending/queued jobs: attempts >= max -> fail; dataset missing -> skip; automl without path -> skip; else submit."""
    p = jobs.filter(F.col("status").isin("pending", "queued"))
    d = datasets.select(F.col("id").alias("dataset_id"), F.lit(True).alias("_ds"))
    j = p.join(d, "dataset_id", "left")
    decision = (F.when(F.col("attempts") >= F.col("max_attempts"), F.lit("fail"))
                .when(F.col("_ds").isNull(), F.lit("skip_missing_dataset"))
                .when((F.col("job_type") == "automl") & F.col("dataset_path").isNull(), F.lit("skip_no_path"))
                .otherwise(F.lit("submit")))
    return j.select("id", "status", "attempts", decision.alias("decision"),
                    F.when(decision == "submit", F.col("attempts") + 1).otherwise(F.col("attempts")).alias("attempts_after"))


def cascade_delete_model(model_ids: DataFrame, runs: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """L15 (model): CASCADE removes the model's runs and jobs (left anti joins)."""
    ids = model_ids.select(F.col("id").alias("model_id")).distinct()
    return runs.join(ids, "model_id", "left_anti"), jobs.join(ids, "model_id", "left_anti")


def cascade_delete_dataset(dataset_ids: DataFrame, models: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """L15 (dataset): SET NULL on models.dataset_id, CASCADE on jobs."""
    ids = dataset_ids.select(F.col("id").alias("dataset_id"), F.lit(True).alias("_del")).distinct()
    m = models.join(ids, "dataset_id", "left").withColumn(
        "dataset_id", F.when(F.col("_del"), F.lit(None).cast("string")).otherwise(F.col("dataset_id"))).drop("_del")
    return m, jobs.join(ids.drop("_del"), "dataset_id", "left_anti")


def upsert(base: DataFrame, updates: DataFrame, key: str = "id", allow_null: bool = False, order: str | None = None) -> DataFrame:
    """Update only non-NULL supplied fields (models: NULL may be set with ``allow_null``); unknown fields raise.

    Of several updates of one key the last by ``order`` counts (without one, the
    greatest row); ``order`` itself is no field of the table.
    """
    fields = [c for c in updates.columns if c not in (key, order)]
    last = F.max_by(F.struct(*fields), F.struct(*([order] if order else []), *fields)) if fields else F.max(F.struct(F.lit(1)))
    updates = updates.groupBy(key).agg(last.alias("_last")).select(key, *[F.col(f"_last.{c}").alias(c) for c in fields])
    unknown = [c for c in updates.columns if c not in base.columns]
    if unknown:
        raise ValueError(f"unknown fields: {unknown}")
    u = updates.select(*[F.col(c).alias(f"_u_{c}") if c != key else F.col(c) for c in updates.columns]).withColumn("_hit", F.lit(True))
    j = base.join(u, key, "left")
    cols = []
    for c in base.columns:
        if c == key or c not in updates.columns:
            cols.append(F.col(c))
        elif allow_null:
            cols.append(F.when(F.col("_hit"), F.col(f"_u_{c}")).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.coalesce(F.col(f"_u_{c}"), F.col(c)).alias(c))
    return j.select(*cols)


def migrate_models(raw: DataFrame, datasets: DataFrame) -> DataFrame:
    """JSON model rows -> typed rows; dataset looked up by name (deduplicated), else NULL."""
    d = datasets.groupBy(F.col("name").alias("dataset_name")).agg(F.min("id").alias("dataset_id"))
    return raw.join(d, "dataset_name", "left")


def add_metric_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Schema evolution: add missing nullable metric columns."""
    for c, t in columns.items():
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(t))
    return df


def best_epoch(epochs: DataFrame, run: str = "run_id", tie: list[str] | None = None) -> DataFrame:
    """Iteration with the strictly highest non-null accuracy, earliest on tie.

    ``tie`` adds further ascending tie-break columns when (run, iteration) is not unique.
    """
    ranked = F.struct(F.col("accuracy"), (-F.col("iteration")).alias("neg_it"),
                      *[(-F.col(t)).alias(f"neg_{t}") for t in (tie or [])])
    e = epochs.filter(F.col("accuracy").isNotNull())
    return e.groupBy(run).agg(
        F.max_by(F.struct("iteration", "accuracy", "precision", "recall", "f1_score"), ranked).alias("b")).select(run, "b.*")


def validate_registry(datasets: DataFrame, models: DataFrame, runs: DataFrame) -> DataFrame:
    """CHECK / FK rule violations of three tables as a long report (table, rule, id), one scan per table for its CHECKs."""
    tables = {"datasets": datasets, "models": models, "training_runs": runs}
    rules = [r for r in [*CHECKS, *FOREIGN_KEYS] if r.table in tables and (r.table, r.name) != ("training_runs", "fk_dataset")]
    return violations(tables, rules)


def dataset_record(datasets: DataFrame, tasks: Column | None = None) -> DataFrame:
    """Catalog row: parsed tags, size default, description fallback and, given an expression for them, the supported tasks."""
    from quarry.functions.scalar import parse_tags
    extra = [] if tasks is None else [tasks.alias("tasks")]
    return datasets.select(*extra, "id", "name", parse_tags(F.col("tags_text")).alias("tags"),
                           F.coalesce("file_size", F.lit(0).cast("bigint")).alias("size"),
                           F.coalesce("description", F.concat(F.lit("Dataset "), F.col("name"))).alias("description"))


def current_version(versions: DataFrame) -> DataFrame:
    """Flagged current version per model, else the latest created."""
    flagged = versions.filter(F.col("is_current")).groupBy("model_id").agg(
        F.max_by("version", F.struct("created_at", "version")).alias("current_version"))
    latest = versions.groupBy("model_id").agg(F.max_by("version", F.struct("created_at", "version")).alias("latest_version"))
    return latest.join(flagged, "model_id", "left").select(
        "model_id", F.coalesce("current_version", "latest_version").alias("version"))


def validation_state(datasets: DataFrame, valid: Column, errors: Column) -> DataFrame:
    """Valid -> ready; invalid -> error with errors appended to the description."""
    return datasets.select("id", F.when(valid, F.lit("ready")).otherwise(F.lit("error")).alias("readiness"),
                           F.when(valid, F.col("description")).otherwise(
                               F.concat_ws(" | ", F.col("description"), errors)).alias("description"))


def top_models(board: DataFrame, score: str = "score", group: str | None = None, k: int = 3,
               tie: str = "run_id") -> DataFrame:
    """First k leaderboard rows by score (desc) per group; ``row_number() <= k`` runs as a
    partial WindowGroupLimit before the shuffle."""
    w = (Window.partitionBy(group) if group else Window.partitionBy(F.lit(1))).orderBy(
        F.col(score).desc_nulls_last(), F.col(tie))
    return board.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def migrate_datasets(raw: DataFrame) -> DataFrame:
    """L17 (datasets): legacy JSON rows -> typed rows with field fallbacks."""
    cols = set(raw.columns)

    def pick(*names, default=None):
        present = [F.col(n) for n in names if n in cols]
        return F.coalesce(*present, F.lit(default)) if present else F.lit(default)

    return raw.select(pick("id").cast("string").alias("id"), pick("name").alias("name"),
                      F.lower(pick("domain", default="tabular")).alias("domain"),
                      pick("readiness", "status", default="draft").alias("readiness"),
                      pick("file_path", "path").alias("file_path"),
                      pick("total_samples", "size", default=0).cast("int").alias("total_samples"))


def migrate_jobs(raw: DataFrame, models: DataFrame) -> DataFrame:
    """L17 (jobs): legacy job rows -> typed rows; model reference kept only when it exists."""
    m = models.select(F.col("id").alias("model_id"), F.lit(True).alias("_m"))
    j = raw.select(F.col("id").cast("string").alias("id"), F.coalesce(F.col("job_type"), F.lit("training")).alias("job_type"),
                   F.coalesce(F.col("status"), F.lit("pending")).alias("status"), F.col("model_id").cast("string").alias("model_id"))
    return j.join(m, "model_id", "left").select(
        "id", "job_type", "status", F.when(F.col("_m"), F.col("model_id")).alias("model_id"))
