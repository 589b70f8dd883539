"""SQL text for the DuckDB oracle of each registered query.

Generated from the same column lists the Spark side uses. Doubles are rounded
to 6 digits on both sides; counts are cast to BIGINT (DuckDB sums are HUGEINT).
"""

from __future__ import annotations


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def r6(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6)"


def numeric_profile_sql(table: str, cols: dict[str, str], with_minmax: bool = False) -> str:
    parts = []
    for c, dtype in cols.items():
        x = f"CAST({q(c)} AS DOUBLE)"
        inner = f"SELECT {x} AS x, avg({x}) OVER () AS mu FROM {table}"
        m2 = "avg(power(x - mu, 2))"
        skew = f"CASE WHEN count(x) > 1 AND {m2} > 0 THEN avg(power(x - mu, 3)) / power({m2}, 1.5) END"
        kurt = f"CASE WHEN count(x) > 1 AND {m2} > 0 THEN avg(power(x - mu, 4)) / power({m2}, 2) - 3 END"
        agg = (f"SELECT '{c}' AS col, '{dtype}' AS dtype, avg(x) AS mean, stddev_samp(x) AS std_dev, "
               f"quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3, "
               f"{skew} AS skewness, {kurt} AS kurtosis, count(*) AS n_rows, count(x) AS nn, "
               f"count_if(x = 0) AS zeros, count(DISTINCT x) AS nuniq, min(x) AS vmin, max(x) AS vmax FROM ({inner}) s")
        out = (f"SELECT a.col AS {q('column')}, a.dtype, {r6('a.mean')} AS mean, {r6('a.std_dev')} AS std_dev, "
               f"{r6('a.median')} AS median, {r6('a.q1')} AS q1, {r6('a.q3')} AS q3, "
               f"{r6('a.skewness')} AS skewness, {r6('a.kurtosis')} AS kurtosis, "
               f"{r6('CAST(a.n_rows - a.nn AS DOUBLE) * 100 / a.n_rows')} AS missing_percent, "
               f"{r6('CAST(a.zeros AS DOUBLE) * 100 / a.n_rows')} AS zero_percent, "
               f"CAST(a.nuniq AS BIGINT) AS unique_values, "
               f"CASE WHEN a.nn > 0 THEN {r6(f'CAST((SELECT count(*) FROM (SELECT {x} AS x FROM {table}) z WHERE z.x < a.q1 - 1.5 * (a.q3 - a.q1) OR z.x > a.q3 + 1.5 * (a.q3 - a.q1)) AS DOUBLE) * 100 / a.nn')} END AS outlier_percent, "
               f"CASE WHEN a.mean <> 0 THEN {r6('a.std_dev / a.mean')} END AS coefficient_of_variation, "
               f"a.nuniq = 1 AS is_constant"
               + (f", {r6('a.vmin')} AS min, {r6('a.vmax')} AS max" if with_minmax else "")
               + f" FROM ({agg}) a")
        parts.append(out)
    return "\nUNION ALL\n".join(parts)


def top_values_sql(table: str, col: str, k: int = 10) -> str:
    f = f"(SELECT {q(col)} AS v, count(*) AS n FROM {table} GROUP BY {q(col)})"
    return (f"(SELECT string_agg(coalesce(CAST(v AS VARCHAR), 'NULL') || ':' || CAST(n AS VARCHAR), '|' "
            f"ORDER BY n DESC, v ASC NULLS LAST) FROM (SELECT v, n FROM {f} ORDER BY n DESC, v ASC NULLS LAST LIMIT {k}))")


def categorical_profile_sql(table: str, cols: dict[str, str]) -> str:
    parts = []
    for c, dtype in cols.items():
        f = f"(SELECT {q(c)} AS v, count(*) AS n FROM {table} GROUP BY {q(c)})"
        agg = (f"SELECT sum(n) AS n_rows, sum(CASE WHEN v IS NULL THEN n ELSE 0 END) AS nulls, count(v) AS card, "
               f"-sum((CAST(n AS DOUBLE) / t.total) * log2(CAST(n AS DOUBLE) / t.total)) AS ent, "
               f"count(DISTINCT lower(v)) AS lower_distinct, "
               f"sum(CASE WHEN v IS NOT NULL THEN n * length(v) END) AS len_sum "
               f"FROM {f} f, (SELECT count(*) AS total FROM {table}) t")
        parts.append(
            f"SELECT '{c}' AS {q('column')}, '{dtype}' AS dtype, {top_values_sql(table, c)} AS top_values, "
            f"CAST(a.card AS BIGINT) AS cardinality, CASE WHEN a.card > 1 THEN {r6('a.ent')} ELSE 0.0 END AS entropy, "
            f"{r6('CAST(a.nulls AS DOUBLE) * 100 / a.n_rows')} AS missing_percent, a.card > 50 AS high_cardinality, "
            f"a.card = 1 AS is_constant, a.lower_distinct = a.card AS lowercase_consistent, "
            f"{r6('CAST(a.len_sum AS DOUBLE) / (a.n_rows - a.nulls)')} AS avg_str_length FROM ({agg}) a")
    return "\nUNION ALL\n".join(parts)


def bool_profile_sql(table: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        parts.append(
            f"SELECT '{c}' AS {q('column')}, 'boolean' AS dtype, "
            f"{top_values_sql(f'(SELECT CAST({q(c)} AS VARCHAR) AS {q(c)} FROM {table})', c, 3)} AS value_counts, "
            f"{r6(f'CAST(count(*) - count({q(c)}) AS DOUBLE) * 100 / count(*)')} AS missing_percent, "
            f"count(DISTINCT {q(c)}) = 1 AS is_constant FROM {table}")
    return "\nUNION ALL\n".join(parts)


def autocorr_sql(table: str, col: str, order: list[str]) -> str:
    x = f"CAST(epoch_us({q(col)}) AS DOUBLE)"
    o = ", ".join(q(c) for c in order)
    return (f"(SELECT CASE WHEN count(nx) >= 2 AND var_pop(x) FILTER (WHERE nx IS NOT NULL) > 0 "
            f"AND var_pop(nx) > 0 THEN corr(x, nx) END FROM (SELECT x, lead(x) OVER (ORDER BY {o}) AS nx "
            f"FROM (SELECT {x} AS x, {o} FROM {table} WHERE {q(col)} IS NOT NULL)))")


def datetime_profile_sql(table: str, cols: dict[str, str], order: list[str] | None) -> str:
    parts = []
    for c, dtype in cols.items():
        ac = f", {r6(autocorr_sql(table, c, order))} AS autocorrelation_lag1" if order else ""
        parts.append(
            f"SELECT '{c}' AS {q('column')}, '{dtype}' AS dtype, CAST(min({q(c)}) AS TIMESTAMP) AS min_timestamp, "
            f"CAST(max({q(c)}) AS TIMESTAMP) AS max_timestamp, "
            f"{r6(f'CAST(count(*) - count({q(c)}) AS DOUBLE) * 100 / count(*)')} AS missing_percent{ac} FROM {table}")
    return "\nUNION ALL\n".join(parts)


def inner_edges_sql(raw: str) -> str:
    """Merge near-duplicate edges of the list column ``raw`` and drop the outer two."""
    kept = f"list_filter({raw}, lambda e, i: i = 1 OR e - {raw}[i - 1] > 1e-8)"
    return f"list_slice({kept}, 2, len({kept}) - 1)"


def _probs(b: int) -> str:
    return "[" + ", ".join(f"{i}/{b}" for i in range(b + 1)) + "]"


def stable_mi_sql(table: str, target: str, features: dict[str, str], target_binned: bool,
                  bin_counts=(10, 20, 30), top_k: int = 20, max_card: int = 50, per_run: bool = False) -> str:
    """features: name -> branch (onehot | lowcard | numeric)."""
    meds, edge_cols, other = [], [], []
    for f, kind in features.items():
        if kind == "numeric":
            meds.append(f"quantile_cont({q(f)}, 0.5) AS med_{f}")
            for b in bin_counts:
                edge_cols.append(f"quantile_cont(coalesce(CAST({q(f)} AS DOUBLE), med_{f}), {_probs(b)}) AS e_{f}_{b}")
        elif kind == "onehot":
            v = f"coalesce({q(f)}, 'Missing')"
            other.append(f"(SELECT list(v) FROM (SELECT v, count(*) AS n FROM (SELECT {v} AS v FROM {table}) "
                         f"GROUP BY v ORDER BY n DESC, v ASC LIMIT {top_k})) AS top_{f}")
            other.append(f"(SELECT count(DISTINCT {v}) FROM {table}) AS card_{f}")
    if target_binned:
        for b in bin_counts:
            edge_cols.append(f"quantile_cont(CAST({q(target)} AS DOUBLE), {_probs(b)}) AS t_{b}")
    meds_cte = f"SELECT {', '.join(meds)} FROM {table}" if meds else "SELECT 1 AS dummy_m"
    edges_cte = f"SELECT {', '.join(edge_cols)} FROM {table}, meds" if edge_cols else "SELECT 1 AS dummy_e"
    tops_cte = f"SELECT {', '.join(other)}" if other else "SELECT 1 AS dummy_t"
    branches = []
    for b in bin_counts:
        if target_binned:
            y = f"CAST(len(list_filter({inner_edges_sql(f't_{b}')}, lambda e: e <= {q(target)})) AS VARCHAR)"
        else:
            y = f"CAST({q(target)} AS VARCHAR)"
        for f, kind in features.items():
            if kind == "numeric":
                filled = f"coalesce(CAST({q(f)} AS DOUBLE), med_{f})"
                x = f"CAST(len(list_filter({inner_edges_sql(f'e_{f}_{b}')}, lambda e: e <= {filled})) AS VARCHAR)"
            elif kind == "lowcard":
                x = f"coalesce(CAST({q(f)} AS VARCHAR), 'Missing')"
            else:
                v = f"coalesce({q(f)}, 'Missing')"
                x = f"CASE WHEN card_{f} <= {max_card} OR list_contains(top_{f}, {v}) THEN {v} ELSE 'Other' END"
            branches.append(f"SELECT '{f}' AS feature, '{kind}' AS branch, {b} AS bins, {x} AS x, {y} AS y "
                            f"FROM {table}, meds, edges, tops")
    long = "\nUNION ALL\n".join(branches)
    return f"""WITH meds AS ({meds_cte}),
edges AS ({edges_cte}),
tops AS ({tops_cte}),
long AS ({long}),
tot AS (SELECT count(*) AS total_n FROM {table}),
cont AS (SELECT feature, branch, bins, x, y, count(*) AS n FROM long GROUP BY ALL),
c AS (SELECT * FROM cont WHERE y IS NOT NULL),
nx AS (SELECT feature, bins, x, sum(n) AS nx FROM c GROUP BY ALL),
ny AS (SELECT feature, bins, y, sum(n) AS ny FROM c GROUP BY ALL),
std AS (SELECT c.feature, c.bins, sum((CAST(n AS DOUBLE) / total_n) * log2(CAST(n AS DOUBLE) * total_n / (nx * ny))) AS mi
  FROM c JOIN nx USING (feature, bins, x) JOIN ny USING (feature, bins, y), tot
  WHERE c.branch <> 'onehot' GROUP BY ALL),
cats AS (SELECT feature, bins, x, sum(CASE WHEN y IS NOT NULL THEN n ELSE 0 END) AS n1 FROM cont WHERE branch = 'onehot' GROUP BY ALL),
ys AS (SELECT feature, bins, y, sum(n) AS ny FROM c WHERE branch = 'onehot' GROUP BY ALL),
nyt AS (SELECT feature, bins, sum(ny) AS ny_total FROM ys GROUP BY ALL),
grid AS (SELECT cats.feature, cats.bins, cats.x, ys.y, ys.ny, cats.n1, nyt.ny_total - cats.n1 AS n0,
  coalesce(c.n, 0) AS ndy FROM cats JOIN ys USING (feature, bins) JOIN nyt USING (feature, bins)
  LEFT JOIN c ON c.feature = cats.feature AND c.bins = cats.bins AND c.x = cats.x AND c.y = ys.y),
oh AS (SELECT feature, bins, sum(
  CASE WHEN ndy > 0 THEN (CAST(ndy AS DOUBLE) / total_n) * log2(CAST(ndy AS DOUBLE) * total_n / (n1 * ny)) ELSE 0 END
  + CASE WHEN ny - ndy > 0 THEN (CAST(ny - ndy AS DOUBLE) / total_n) * log2(CAST(ny - ndy AS DOUBLE) * total_n / (n0 * ny)) ELSE 0 END) AS mi
  FROM grid, tot GROUP BY ALL),
runs AS (SELECT * FROM std UNION ALL SELECT * FROM oh)
""" + ("SELECT feature, bins, round(mi, 6) AS mi FROM runs" if per_run else
       """SELECT feature, round_even(avg(mi), 6) AS avg_mi, round_even(stddev_pop(mi), 6) AS std_mi,
  CASE WHEN stddev_pop(mi) > 0.01 THEN 'Unstable' ELSE 'Stable' END AS stability,
  CASE WHEN avg(mi) < 0.0001 THEN 'Near-Zero' ELSE 'Informative' END AS mi_flag
FROM runs GROUP BY feature""")


def pearson_sql(table: str, cols: list[str], digits: int = 4) -> str:
    means = ", ".join(f"avg(CAST({q(c)} AS DOUBLE)) AS m_{i}" for i, c in enumerate(cols))
    zs = {c: f"coalesce(CAST({q(c)} AS DOUBLE) - m_{i}, 0.0)" for i, c in enumerate(cols)}
    sums = ", ".join(f"sum({zs[a]} * {zs[b]}) AS s_{i}_{j}" for i, a in enumerate(cols) for j, b in enumerate(cols))
    rows = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            rows.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, CASE WHEN s_{i}_{i} > 0 AND s_{j}_{j} > 0 THEN "
                        f"round_even(s_{i}_{j} / sqrt(s_{i}_{i} * s_{j}_{j}), {digits}) ELSE 0.0 END AS corr FROM s")
    return (f"WITH m AS (SELECT {means} FROM {table}), s AS (SELECT {sums} FROM {table}, m)\n"
            + "\nUNION ALL\n".join(rows))
