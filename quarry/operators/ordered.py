"""Order-dependent operators without an unbounded window.

Spark rows have no order, so every operator here takes an explicit ``order``
(unique, or made unique with a tie-break column). The work is range
partitioned on ``(keys..., order...)`` so a single hot key is spread over many
tasks; each sorted partition is scanned once (Arrow batches through
``mapInPandas``) and reports a one-row *carry* (its first/last state). The
carries table has one row per partition (bounded by configuration), and is
combined with a small window and broadcast back. No ``Window`` ever partitions
raw rows by a key whose group may be huge, and nothing row-sized reaches the
driver.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import ensure_checkpoint_dir, materialize


def _n_parts(df: DataFrame, partitions: int | None) -> int:
    return partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


_PAIR_SCHEMA = T.StructType([
    T.StructField("pid", T.IntegerType()),
    T.StructField("n", T.LongType()),
    T.StructField("sa", T.DoubleType()), T.StructField("sb", T.DoubleType()),
    T.StructField("saa", T.DoubleType()), T.StructField("sbb", T.DoubleType()),
    T.StructField("sab", T.DoubleType()),
    T.StructField("first_v", T.DoubleType()), T.StructField("last_v", T.DoubleType()),
])


def _pair_stats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sufficient statistics of consecutive pairs inside one sorted partition, batch by batch."""
    import pyspark
    pid = pyspark.TaskContext.get().partitionId()
    sums, first, last = np.zeros(6), None, None
    for b in batches:
        v = b["x"].to_numpy(dtype="float64")
        if not v.size:
            continue
        if first is None:
            first = v[0]
        else:
            v = np.concatenate([[last], v])  # the pair across two batches
        x, y, last = v[:-1], v[1:], v[-1]
        sums += [x.size, x.sum(), y.sum(), (x * x).sum(), (y * y).sum(), (x * y).sum()]
    if first is not None:
        n, sa, sb, saa, sbb, sab = sums
        yield pd.DataFrame({"pid": [pid], "n": [int(n)], "sa": [sa], "sb": [sb], "saa": [saa], "sbb": [sbb], "sab": [sab], "first_v": [first], "last_v": [last]})


def lag1_autocorr(df: DataFrame, value: str, order: list[str], partitions: int | None = None,
                  column_name: str | None = None) -> DataFrame:
    """Pearson correlation of the series with itself shifted by one row.

    Nulls are dropped first; NULL when fewer than two pairs or a constant side.
    Timestamps are taken as epoch microseconds (correlation is scale free).
    """
    dtype = df.schema[value].dataType
    x = F.col(value)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        from quarry.functions.scalar import epoch_micros  # NTZ: no session time-zone shift (DST safe)
        x = epoch_micros(x, ntz=isinstance(dtype, T.TimestampNTZType))
    elif isinstance(dtype, T.DateType):
        x = F.unix_date(x)
    base = df.select(*[F.col(o) for o in order], x.alias("x")).filter(F.col("x").isNotNull())
    # Counted from the least value: sums of squares of large numbers would lose what varies.
    base = base.withColumn("x", (F.col("x") - base.agg(F.min("x")).scalar()).cast("double"))
    p = _n_parts(df, partitions)
    parts = (base.repartitionByRange(p, *order).sortWithinPartitions(*order)
             .select("x").mapInPandas(_pair_stats, _PAIR_SCHEMA))
    # boundary pair between consecutive non-empty partitions: tiny window over <= P rows.
    w = Window.orderBy("pid")
    prev_last = F.lag("last_v").over(w)
    with_edges = parts.select(
        "*", prev_last.alias("prev_last"))
    edge_n = F.when(F.col("prev_last").isNotNull(), F.lit(1)).otherwise(F.lit(0))
    a_e, b_e = F.col("prev_last"), F.col("first_v")
    agg = with_edges.agg(
        (F.sum("n") + F.sum(edge_n)).alias("n"),
        (F.sum("sa") + F.coalesce(F.sum(a_e), F.lit(0.0))).alias("sa"),
        (F.sum("sb") + F.coalesce(F.sum(F.when(a_e.isNotNull(), b_e)), F.lit(0.0))).alias("sb"),
        (F.sum("saa") + F.coalesce(F.sum(a_e * a_e), F.lit(0.0))).alias("saa"),
        (F.sum("sbb") + F.coalesce(F.sum(F.when(a_e.isNotNull(), b_e * b_e)), F.lit(0.0))).alias("sbb"),
        (F.sum("sab") + F.coalesce(F.sum(a_e * b_e), F.lit(0.0))).alias("sab"))
    n = F.col("n").cast("double")
    cov = n * F.col("sab") - F.col("sa") * F.col("sb")
    va = n * F.col("saa") - F.col("sa") * F.col("sa")
    vb = n * F.col("sbb") - F.col("sb") * F.col("sb")
    r = F.when((F.col("n") >= 2) & (va > 0) & (vb > 0), cov / F.sqrt(va * vb))
    out = agg.select(r.alias("autocorrelation_lag1"))
    if column_name is not None:
        out = out.select(F.lit(column_name).alias("column"), "autocorrelation_lag1")
    return out


# ---------------------------------------------------------------------------
# Segmented running scans (ffill / bfill / running max / min / count)
# ---------------------------------------------------------------------------

_SCAN_KINDS = ("ffill", "bfill", "cummax", "cummin", "rownum")


def segmented_scan(df: DataFrame, keys: list[str], order: list[str], specs: dict[str, tuple[str, str]],
                   partitions: int | None = None) -> DataFrame:
    """Running operators per key in ``order`` without grouping a key into one task.

    ``specs`` maps output column -> (kind, input column) with kind in
    ffill (last non-null at or above), bfill (next non-null at or below),
    cummax, cummin (running, nulls ignored) and rownum (1-based position).
    Forward kinds run in one pass; bfill is a forward fill over the reversed
    order in a second pass.
    """
    for kind, _ in specs.values():
        if kind not in _SCAN_KINDS:
            raise ValueError(f"unknown scan kind {kind}")
    fwd = {k: v for k, v in specs.items() if v[0] != "bfill"}
    back = {k: ("ffill", v[1]) for k, v in specs.items() if v[0] == "bfill"}
    out = df
    if fwd:
        out = _scan_pass(out, keys, [F.col(o).asc() for o in order], fwd, partitions)
    if back:
        out = _scan_pass(out, keys, [F.col(o).desc() for o in order], back, partitions)
    return out


def _scan_pass(df: DataFrame, keys: list[str], order_cols, specs: dict[str, tuple[str, str]],
               partitions: int | None = None) -> DataFrame:
    """One forward pass.

    Plan: range partition on keys + order, sort within partitions, then a
    streaming pandas pass over the Arrow batches of each partition (per-key
    state carried from batch to batch, so memory is one batch, not one
    partition). Each partition's boundary state (<= 2 rows) goes into a small
    carries table combined by a window over partitions and broadcast back.
    """
    ensure_checkpoint_dir(df.sparkSession)
    p = _n_parts(df, partitions)
    sort_cols = [F.col(k).asc() for k in keys] + list(order_cols)
    ranged = (df.repartitionByRange(p, *sort_cols).sortWithinPartitions(*sort_cols)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_seq", F.monotonically_increasing_id()))
    in_fields = {f.name: f for f in df.schema.fields}
    out_fields = list(df.schema.fields) + [T.StructField("_pid", T.IntegerType()),
                                           T.StructField("_seq", T.LongType())]
    for name, (kind, src) in specs.items():
        dt = T.LongType() if kind == "rownum" else in_fields[src].dataType
        out_fields.append(T.StructField(name, dt))
    schema = T.StructType(out_fields)
    key_cols = list(keys)

    def local_scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry_key, carry = None, {}
        for pdf in batches:
            if pdf.empty:
                continue
            kdf = pdf[key_cols] if key_cols else pd.DataFrame({"_k": np.zeros(len(pdf), dtype=np.int8)})
            gid = kdf.groupby(list(kdf.columns), sort=False, dropna=False).ngroup().to_numpy()
            first_key = tuple(kdf.iloc[0]) if key_cols else ()
            cont = carry_key is not None and _same_key(first_key, carry_key)
            head = gid == gid[0]  # rows of the batch's first key
            for name, (kind, src) in specs.items():
                srs = pdf[src]
                g = srs.groupby(gid, sort=False)
                if kind == "rownum":
                    vals = g.cumcount().to_numpy() + 1
                    if cont:
                        vals = vals + np.where(head, carry.get(name, 0), 0)
                    pdf[name] = vals
                    continue
                if kind == "ffill":
                    vals = g.ffill()
                    if cont and carry.get(name) is not None:
                        vals = vals.where(~(head & vals.isna().to_numpy()), carry[name])
                else:  # cummax / cummin: pandas leaves NULL at NULL inputs, the running value carries on
                    vals = getattr(g, kind)().groupby(gid, sort=False).ffill()
                    c = carry.get(name)
                    if cont and c is not None:
                        h = vals[head]
                        comb = h.fillna(c)
                        comb = comb.clip(lower=c) if kind == "cummax" else comb.clip(upper=c)
                        vals = vals.astype(comb.dtype)
                        vals[head] = comb
                pdf[name] = vals
            # carry the state of the batch's last key into the next batch
            last = gid == gid[-1]
            last_key = tuple(kdf.iloc[-1]) if key_cols else ()
            same_as_prev = cont and gid[-1] == gid[0]
            new_carry = {}
            for name, (kind, src) in specs.items():
                if kind == "rownum":
                    new_carry[name] = int(pdf[name].to_numpy()[-1])
                else:
                    v = pdf[name][last].iloc[-1]
                    new_carry[name] = None if pd.isna(v) else v
                    if new_carry[name] is None and same_as_prev:
                        new_carry[name] = carry.get(name)
            carry_key, carry = last_key, new_carry
            yield pdf

    local = materialize(ranged.mapInPandas(local_scan, schema), "scan")

    # Boundary state per (partition, key): only keys at a partition edge can
    # receive a carry, so each partition contributes at most two rows.
    kcols = [F.col(k) for k in key_cols]
    edge_aggs = [F.min("_seq").alias("_first_seq"), F.max("_seq").alias("_last_seq")]
    for name, (kind, src) in specs.items():
        if kind == "ffill":
            edge_aggs.append(F.max_by(F.col(name), F.col("_seq")).alias(f"{name}__last"))
        elif kind == "cummax":
            edge_aggs.append(F.max(F.col(src)).alias(f"{name}__agg"))
        elif kind == "cummin":
            edge_aggs.append(F.min(F.col(src)).alias(f"{name}__agg"))
        elif kind == "rownum":
            edge_aggs.append(F.count(F.lit(1)).alias(f"{name}__agg"))
    part_bounds = local.groupBy("_pid").agg(F.min("_seq").alias("_pmin"), F.max("_seq").alias("_pmax"))
    edge_rows = (local.join(F.broadcast(part_bounds), "_pid")
                 .filter((F.col("_seq") == F.col("_pmin")) | (F.col("_seq") == F.col("_pmax")))
                 .select("_pid", *kcols).distinct())
    def on(side: DataFrame):  # a NULL key is a key
        names = {c: f"_r_{c}" for c in ["_pid"] + key_cols}
        right = side.select(*[F.col(c).alias(names.get(c, c)) for c in side.columns])
        match = F.lit(True)
        for c, r in names.items():
            match = match & F.col(c).eqNullSafe(F.col(r))
        return F.broadcast(right), match

    seg = (local.join(*on(edge_rows), "left_semi")
           .groupBy("_pid", *kcols).agg(*edge_aggs))
    # seg holds <= 2 rows per partition; carries combine earlier partitions of the same key.
    wk = Window.partitionBy(*kcols) if key_cols else Window.partitionBy(F.lit(0))
    before = wk.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carry_cols = []
    for name, (kind, src) in specs.items():
        if kind == "ffill":
            carry_cols.append(F.last(f"{name}__last", ignorenulls=True).over(before).alias(f"{name}__carry"))
        elif kind == "cummax":
            carry_cols.append(F.max(f"{name}__agg").over(before).alias(f"{name}__carry"))
        elif kind == "cummin":
            carry_cols.append(F.min(f"{name}__agg").over(before).alias(f"{name}__carry"))
        elif kind == "rownum":
            carry_cols.append(F.coalesce(F.sum(f"{name}__agg").over(before), F.lit(0)).alias(f"{name}__carry"))
    carries = seg.select("_pid", *kcols, *carry_cols)
    joined = local.join(*on(carries), "left")
    outs = []
    for name, (kind, src) in specs.items():
        c, carry = F.col(name), F.col(f"{name}__carry")
        if kind == "ffill":
            outs.append(F.coalesce(c, carry).alias(name))
        elif kind == "cummax":
            outs.append(F.when(carry.isNull(), c).when(c.isNull(), carry).otherwise(F.greatest(c, carry)).alias(name))
        elif kind == "cummin":
            outs.append(F.when(carry.isNull(), c).when(c.isNull(), carry).otherwise(F.least(c, carry)).alias(name))
        elif kind == "rownum":
            outs.append((c + F.coalesce(carry, F.lit(0))).alias(name))
    base_cols = [F.col(f.name) for f in df.schema.fields]
    return joined.select(*base_cols, *outs)


def _same_key(a: tuple, b: tuple) -> bool:
    if len(a) != len(b):
        return False
    for x, y in zip(a, b):
        if (x is None or (isinstance(x, float) and np.isnan(x))) and (y is None or (isinstance(y, float) and np.isnan(y))):
            continue
        if x != y:
            return False
    return True
