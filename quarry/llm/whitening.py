"""Whitening of embeddings from the exact characteristic polynomial of their integer scatter.

Vectors become integers, so count, sums and scatter are exact. The scatter's
characteristic polynomial follows from its residues: modulo each of enough
31-bit primes a task reduces the matrix to Hessenberg form and reads off the
polynomial, and Chinese remaindering gives the integer coefficients. All roots
are real, so the number of roots above a point is exactly the number of sign
changes after a Taylor shift; bisection with that count isolates the largest
roots, and bisection by sign refines each to ``ROOT_BITS`` binary places. A
component spans the null space of scatter less root, by inverse iteration in
``DIGITS`` decimal digits.

Only tables of a size given by the dimension are on the driver: scatter,
polynomial and components. Rows meet them in tasks.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from functools import lru_cache
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import drop_kept, keep

#: Binary places of a root, and decimal digits of inverse iteration.
ROOT_BITS, DIGITS = 96, 120
#: Results fit in a long up to here.
LONG = 2**63 - 1


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, x): floor(scale * c) of each component as double; rows with a null vector, an empty one,
    or a null, non-finite or (scaled) 63-bit entry drop out."""
    c = F.transform(F.col(f"`{vector_col}`"), lambda e: e.cast("double") * scale)
    fits = F.forall("c", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float(2**62)))
    return (rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), c.alias("c")).where(F.col("c").isNotNull() & (F.size("c") > 0))
            .where(fits).select("vec_id", F.transform("c", lambda e: F.floor(e)).alias("x")))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _peak(m: np.ndarray) -> int:
    return max(abs(int(m.max())), abs(int(m.min())))


def product(m: np.ndarray) -> np.ndarray:
    """The exact transpose(m) * m of an integer matrix, as int64 or Python integers."""
    peak = _peak(m)
    if peak * peak * len(m) < 2**53:  # every partial sum is an exact double
        return (m.T.astype(float) @ m.astype(float)).astype(np.int64)
    if peak * peak * len(m) < 2**62:
        return m.T @ m
    wide = m.astype(object)
    return wide.T.dot(wide)


def scatter(fit: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """n, the sums S and the matrix n * sum(x x') - S S' of the rows (x) of ``fit``, all exact.

    Tasks add up their rows; (i, j, sum) rows, as many as matrix cells, are combined by a groupBy.
    """
    left, right = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, cells = 0, np.zeros(d, object), np.zeros(len(left), object)
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                m = _matrix(b.column(0).slice(at, 4096), d)
                if len(m):
                    n += len(m)
                    sums += m.sum(0).astype(object) if _peak(m) * len(m) < 2**62 else m.astype(object).sum(0)
                    cells += product(m)[left, right].astype(object)
        if n:
            values = [decimal.Decimal(int(v)) for v in [n, *sums, *cells]]
            i, j = [-1, *[-1] * d, *left.tolist()], [-1, *range(d), *right.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(values, pa.decimal128(38, 0))], ["i", "j", "v"])

    rows = fit.select("x").mapInArrow(run, "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # d * d rows
    at = {(r["i"], r["j"]): int(r["v"]) for r in rows}
    n, s = at.get((-1, -1), 0), [at.get((-1, j), 0) for j in range(d)]
    return n, s, [[n * at.get((min(i, j), max(i, j)), 0) - s[i] * s[j] for j in range(d)] for i in range(d)]


def _is_prime(n: int) -> bool:
    """Miller-Rabin; these bases decide every n below 3,215,031,751."""
    k, r = n - 1, 0
    while k % 2 == 0:
        k, r = k // 2, r + 1
    for a in (2, 3, 5, 7):
        x = pow(a, k, n)
        if x in (1, n - 1):
            continue
        for _ in range(r - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes(product_above: int) -> list[int]:
    """The largest primes below 2**31, enough of them for their product."""
    out, have, n = [], 1, 2**31 - 1
    while have <= product_above:
        if _is_prime(n):
            out.append(n)
            have *= n
        n -= 2
    return out


def _power(base: np.ndarray, exponent: np.ndarray, p: np.ndarray) -> np.ndarray:
    out, base, exponent = np.ones_like(base), base % p, exponent.copy()
    while exponent.any():
        out = np.where(exponent & 1, out * base % p, out)
        base, exponent = base * base % p, exponent >> 1
    return out


def residues(matrix: list[list[int]], ps: list[int]) -> np.ndarray:
    """Coefficients (constant first) of the characteristic polynomial modulo each prime, one row a prime."""
    d, p = len(matrix), np.array(ps, np.int64)
    h = np.array([[[v % q for v in row] for row in matrix] for q in ps], np.int64)
    one, two, every = p[:, None], p[:, None, None], np.arange(len(ps))
    for k in range(d - 2):  # similarity steps that clear column k below the subdiagonal
        pivot = k + 1 + (h[:, k + 1:, k] != 0).argmax(1)
        h[every, k + 1], h[every, pivot] = h[every, pivot], h[every, k + 1].copy()
        swapped = h[every, :, pivot].copy()
        h[every, :, pivot] = h[:, :, k + 1]
        h[:, :, k + 1] = swapped
        u = h[:, k + 2:, k] * _power(h[:, k + 1, k], p - 2, p)[:, None] % one
        h[:, k + 2:] = (h[:, k + 2:] - u[:, :, None] * h[:, None, k + 1] % two) % two
        h[:, :, k + 1] = (h[:, :, k + 1] + (h[:, :, k + 2:] * u[:, None] % two).sum(2)) % one
    poly = np.zeros((d + 1, len(ps), d + 1), np.int64)
    poly[0, :, 0] = 1
    for m in range(1, d + 1):  # determinants of leading blocks, along the last column
        poly[m, :, 1:] = poly[m - 1, :, :-1]
        poly[m] = (poly[m] - h[:, m - 1, m - 1, None] * poly[m - 1] % one) % one
        below = np.ones(len(ps), np.int64)
        for i in range(m - 1, 0, -1):
            below = below * h[:, i, i - 1] % p
            poly[m] = (poly[m] - (h[:, i - 1, m - 1] * below % p)[:, None] * poly[i - 1] % one) % one
    return poly[d]


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]], per_task: int = 16) -> list[int]:
    """Integer coefficients, constant first, of a positive semidefinite matrix; tasks share the primes.

    A coefficient is an elementary symmetric function of the roots, so at most (1 + trace / d)^d.
    """
    d = len(matrix)
    bound = (2 + sum(matrix[i][i] for i in range(d)) // d) ** d
    ps = primes(2 * bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mine = [ps[i] for i in b.column(0).to_pylist()]
            for at in range(0, len(mine), per_task):
                found = residues(matrix, mine[at:at + per_task])
                yield pa.RecordBatch.from_arrays([pa.array(mine[at:at + per_task], pa.int64()), pa.array(found.tolist(), pa.list_(pa.int64()))], ["prime", "residues"])

    parts = -(-len(ps) // per_task)
    rows = spark.range(0, len(ps), 1, parts).mapInArrow(run, "prime long, residues array<long>").collect()  # bounded by the dimension
    whole = prod(ps)
    parts_of = [whole // r["prime"] * pow(whole // r["prime"], -1, r["prime"]) for r in rows]
    out = []
    for k in range(d + 1):
        v = sum(r["residues"][k] * f for r, f in zip(rows, parts_of, strict=True)) % whole
        out.append(v - whole if v > whole // 2 else v)
    return out


def _shift(poly: list[int], a: int) -> list[int]:
    """Coefficients of poly(y + a)."""
    c = list(poly)
    for i in range(len(c) - 1):
        for k in range(len(c) - 2, i - 1, -1):
            c[k] += a * c[k + 1]
    return c


def _changes(poly: list[int]) -> int:
    signs = [c > 0 for c in poly if c]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def largest_roots(poly: list[int], wanted: int, bits: int = ROOT_BITS) -> list[tuple[int, int]]:
    """(root * 2**bits, multiplicity) of the largest positive roots, ``wanted`` of them with multiplicity, falling.

    All roots of ``poly`` must be real and none negative. Roots that agree in all places count as one.
    """
    d = len(poly) - 1
    scaled = [c << bits * (d - k) for k, c in enumerate(poly)]
    count = lru_cache(None)(lambda a: _changes(_shift(scaled, a)))
    out: list[tuple[int, int]] = []

    def refine(lo: int, hi: int, above: int) -> int:
        while hi - lo > 1:
            mid = (lo + hi) // 2
            v = 0
            for c in reversed(scaled):
                v = v * mid + c
            if v == 0:
                return mid
            if (v > 0) == (above % 2 == 0):
                hi = mid
            else:
                lo = mid
        return hi

    todo = [(0, 1 << (abs(poly[d - 1]) + 1).bit_length() + bits)]
    while todo:  # the largest interval that is left is on top
        lo, hi = todo.pop()
        above, n = count(hi), count(lo) - count(hi)
        if not n or above >= wanted:
            continue
        if n == 1:
            out.append((refine(lo, hi, above), 1))
        elif hi - lo == 1:
            out.append((hi, n))
        else:
            mid = (lo + hi) // 2
            todo += [(lo, mid), (mid, hi)]
    return out


def null_vectors(matrix: list[list[int]], root: int, n: int, bits: int = ROOT_BITS) -> list[list[float]]:
    """n orthonormal vectors of the null space of ``matrix`` less ``root`` / 2**bits, by inverse iteration."""
    with decimal.localcontext(decimal.Context(prec=DIGITS, Emax=decimal.MAX_EMAX, Emin=decimal.MIN_EMIN)):
        d, one = len(matrix), decimal.Decimal(1)
        value = decimal.Decimal(root) / decimal.Decimal(2**bits)
        a = [[decimal.Decimal(v) - (value if i == j else 0) for j, v in enumerate(row)] for i, row in enumerate(matrix)]
        least = max(abs(v) for row in a for v in row) * one.scaleb(-DIGITS + 10) or one
        order = list(range(d))
        for k in range(d):  # triangular factors, rows interchanged
            i = max(range(k, d), key=lambda r: abs(a[r][k]))
            a[k], a[i], order[k], order[i] = a[i], a[k], order[i], order[k]
            if abs(a[k][k]) < least:
                a[k][k] = least
            for r in range(k + 1, d):
                f = a[r][k] / a[k][k]
                a[r][k] = f
                if f:
                    row, top = a[r], a[k]
                    for c in range(k + 1, d):
                        row[c] -= f * top[c]
        found: list[list[decimal.Decimal]] = []

        def unit(v: list) -> list:
            for w in found:
                along = sum(x * y for x, y in zip(v, w, strict=True))
                v = [x - along * y for x, y in zip(v, w, strict=True)]
            size = sum(x * x for x in v).sqrt()
            return [x / size for x in v]

        for start in range(n):
            v = unit([one + (i * (start + 3) * 7919 % 101) for i in range(d)])
            for _ in range(3):
                y = [v[i] for i in order]
                for i in range(d):
                    y[i] -= sum(a[i][j] * y[j] for j in range(i))
                for i in range(d - 1, -1, -1):
                    y[i] = (y[i] - sum(a[i][j] * y[j] for j in range(i + 1, d))) / a[i][i]
                v = unit(y)
            if max(v, key=abs) < 0:
                v = [-x for x in v]
            found.append(v)
        return [[float(x) for x in v] for v in found]


def components(spark: SparkSession, matrix: list[list[int]], wanted: int) -> tuple[list[float], list[list[float]]]:
    """The ``wanted`` largest positive eigenvalues of an integer positive semidefinite matrix, and unit eigenvectors."""
    values, vectors = [], []
    for root, times in largest_roots(characteristic_polynomial(spark, matrix), wanted):
        times = min(times, wanted - len(values))
        values += [root / 2**ROOT_BITS] * times
        vectors += null_vectors(matrix, root, times)
    return values, vectors


def _centred(m: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * m - sums, exact, as int64 or Python integers."""
    if n * max(_peak(m), 1) + max(map(abs, sums)) < 2**62:
        return n * m - np.array(sums, np.int64)
    return n * m.astype(object) - np.array(sums, object)


def whiten(rows: DataFrame, k: int = 4, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per usable vector and component up to ``k``: vec_id, component, n, deviation, whitened, explained, identity_error.

    Entries c become x = floor(scale * c). Rows whose vector is null, empty, of another than
    the most frequent dimension (ties: the smallest), or holds null, non-finite or 63-bit
    entries drop out. Sums and scatter are over the distinct x vectors, n of them. deviation is
    the exact sum over dimensions of (n * x - S)^2, null beyond 63 bits. Components without
    variance are left out, so tables of one distinct vector, or none, give no rows; equal
    eigenvalues have any orthonormal basis of their space. Null and repeated ids stay, one
    result each. Other columns are not read.
    """
    spark, schema = rows.sparkSession, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors = integer_vectors(rows, id_col, vector_col, scale)
    usual = vectors.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not usual:
        return spark.createDataFrame([], schema)
    d = usual[0]["d"]
    vectors = vectors.where(F.size("x") == d)
    fit = keep(vectors.select("x").distinct(), "whitening-fit")
    n, sums, matrix = scatter(fit, d)
    values, units = components(spark, matrix, k) if any(matrix[i][i] for i in range(d)) else ([], [])
    if not values:
        return spark.createDataFrame([], schema)
    trace = sum(matrix[i][i] for i in range(d))
    explained, found = [v / trace for v in values], len(values)
    # (x - S/n) . u / sqrt(e) = (n x - S) . u / sqrt(n^2 e)
    to_white = np.array(units).T / np.sqrt(np.array(values))

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, cross = np.zeros(found), np.zeros((found, found))
        for b in batches:
            if b.num_rows:
                w = _centred(_matrix(b.column(0), d), n, sums).astype(float) @ to_white
                total += w.sum(0)
                cross += w.T @ w
        i, j = np.divmod(np.arange(found * found), found)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(cross[i, j]), pa.array(total[i]), pa.array(total[j])],
                                         ["i", "j", "v", "a", "b"])

    cells = (fit.select("x").mapInArrow(moments, "i int, j int, v double, a double, b double").groupBy("i", "j")
             .agg(F.sum("v").alias("v"), F.sum("a").alias("a"), F.sum("b").alias("b")).collect())  # k * k rows
    error = max(abs(r["v"] / n - r["a"] * r["b"] / n / n - (r["i"] == r["j"])) for r in cells)
    drop_kept(fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            y = _centred(_matrix(b.column(1), d), n, sums)
            square = (y * y).sum(1) if _peak(y) ** 2 * d < 2**62 else (y.astype(object) ** 2).sum(1)
            deviation = pa.array([v if v <= LONG else None for v in square.tolist()], pa.int64())
            w = y.astype(float) @ to_white
            for c in range(found):
                same = [pa.array(np.full(len(w), v), t) for v, t in ((c + 1, pa.int32()), (n, pa.int64()), (explained[c], pa.float64()), (error, pa.float64()))]
                yield pa.RecordBatch.from_arrays([b.column(0), same[0], same[1], deviation, pa.array(w[:, c]), same[2], same[3]],
                                                 ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(run, schema)
