"""Low modes of the graph operator, their extension to new points, and states.

Modes of an operator on at most ``graph.MAX_LANDMARKS`` vertices are solved on the
driver from its entries, those of a larger one by ``eigensolver``; everything per query
stays distributed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stored import release, stored
from .eigensolver import smallest_modes
from .graph import MAX_LANDMARKS

DENSE = 3000


def _lanczos(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, n: int, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest eigenpairs of a symmetric matrix of triplets, by Lanczos with full reorthogonalization."""
    order = np.argsort(rows, kind="stable")
    rows, cols, values = rows[order], cols[order], values[order]
    present, first = np.unique(rows, return_index=True)

    def times(x: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        out[present] = np.add.reduceat(values * x[cols], first)
        return out

    m = min(n, max(6 * k + 60, 160))
    v = np.random.Generator(np.random.PCG64(seed)).normal(size=n)
    basis, a, b = np.zeros((m, n)), np.zeros(m), np.zeros(m)
    v /= np.linalg.norm(v)
    for j in range(m):
        basis[j] = v
        w = times(v)
        a[j] = v @ w
        for _ in range(2):
            w -= basis[: j + 1].T @ (basis[: j + 1] @ w)
        b[j] = np.linalg.norm(w)
        if b[j] < 1e-12:
            m = j + 1
            break
        v = w / b[j]
    e, s = np.linalg.eigh(np.diag(a[:m]) + np.diag(b[: m - 1], 1) + np.diag(b[: m - 1], -1))
    return e[:k], (basis[:m].T @ s)[:, :k]


def solve_modes(entries: DataFrame, k: int, degrees: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(k, epsilon) of the k smallest eigenvalues, ascending, and (id, u, phi), phi = u / sqrt(degree).

    The component of u that is largest in size is positive.
    """
    deg = {r["id"]: r["degree"] for r in degrees.select("id", "degree").limit(MAX_LANDMARKS + 1).collect()}
    if len(deg) > MAX_LANDMARKS:
        return distributed_modes(entries, k, degrees, seed)
    ids = np.array(sorted(deg))
    got = entries.select("src", "dst", "value").toPandas()
    r, c = np.searchsorted(ids, got["src"]), np.searchsorted(ids, got["dst"])
    n, k = len(ids), min(k, len(ids))
    if n <= DENSE:
        h = np.zeros((n, n))
        np.add.at(h, (r, c), got["value"].to_numpy())
        e, u = np.linalg.eigh((h + h.T) / 2)
        e, u = e[:k], u[:, :k]
    else:
        e, u = _lanczos(r, c, got["value"].to_numpy(), n, k, seed)
    u = u * np.where(u[np.abs(u).argmax(axis=0), np.arange(k)] < 0, -1, 1)
    phi = u / np.sqrt(np.array([deg[i] for i in ids]))[:, None]
    spark = entries.sparkSession
    eigen = spark.createDataFrame([(j + 1, float(x)) for j, x in enumerate(e)], "k int, epsilon double")
    modes = spark.createDataFrame([(int(i), a.tolist(), b.tolist()) for i, a, b in zip(ids, u, phi, strict=True)], "id long, u array<double>, phi array<double>")
    return eigen, modes


def distributed_modes(entries: DataFrame, k: int, degrees: DataFrame, seed: int = 0, **how) -> tuple[DataFrame, DataFrame]:
    """``solve_modes`` for any number of vertices: neither entries nor vectors come to the driver."""
    values, vectors = smallest_modes(entries, k, seed, **how)
    vectors = stored(vectors)
    largest = [F.max_by(F.get("u", F.lit(j)), F.struct(F.abs(F.get("u", F.lit(j))), -F.col("id"))).alias(str(j)) for j in range(len(values))]
    signs = [-1.0 if x is not None and x < 0 else 1.0 for x in (vectors.agg(*largest).first() if values else [])]
    turned = F.transform("u", lambda x, j: x * F.get(F.array(*map(F.lit, signs)), j)) if values else F.col("u")
    modes = vectors.select("id", turned.alias("u")).join(degrees.select("id", "degree"), "id").select("id", "u", F.transform("u", lambda x: x / F.sqrt("degree")).alias("phi"))
    modes = stored(modes)
    release(vectors)
    return entries.sparkSession.createDataFrame([(j + 1, float(x)) for j, x in enumerate(values)], "k int, epsilon double"), modes


def residuals(entries: DataFrame, eigen: DataFrame, modes: DataFrame) -> DataFrame:
    """(k, residual): the norm of H u - epsilon u of each mode."""
    levels = [(r["k"], r["epsilon"]) for r in eigen.select("k", "epsilon").orderBy("k").collect()]  # a row for each mode
    if not levels:
        return entries.sparkSession.createDataFrame([], "k int, residual double")
    # All modes of a vertex go with an entry in one row.
    at = lambda k: F.get("u", F.lit(k - 1))
    wide = modes.select(F.col("id").alias("dst"), *(at(k).alias(f"_{k}") for k, _ in levels))
    hx = entries.join(wide, "dst").groupBy(F.col("src").alias("id")).agg(*(F.sum(F.col("value") * F.col(f"_{k}")).alias(f"_{k}") for k, _ in levels))
    gaps = hx.join(modes.select("id", "u"), "id").select(*(F.pow(F.col(f"_{k}") - F.lit(e) * at(k), 2.0).alias(f"_{k}") for k, e in levels))
    sums = gaps.agg(*(F.sqrt(F.sum(f"_{k}")).alias(f"_{k}") for k, _ in levels))
    each = F.array(*(F.struct(F.lit(k).cast(eigen.schema["k"].dataType).alias("k"), F.col(f"_{k}").alias("residual")) for k, _ in levels))
    return sums.select(F.inline(each)).where("residual is not null")


def extend_modes(affinities: DataFrame, modes: DataFrame, potential: DataFrame, eigen: DataFrame, alpha: float = 1.0, beta: float = 1.0, floor: float = 1e-6) -> DataFrame:
    """(id, k, phi, stable): modes (id, k, phi) extended to queries by the operator's own equation.

    phi(x) = alpha sum_j (w_j / d) phi_j / (alpha + beta v(x) - epsilon); the
    denominator keeps its sign and is at least ``floor`` in size.  A mode is stable if
    no query of all comes below the floor.
    """
    levels = [(r["k"], r["epsilon"]) for r in eigen.select("k", "epsilon").orderBy("k").collect()]  # a row for each mode
    if not levels:
        return affinities.sparkSession.createDataFrame([], "id long, k int, phi double, stable boolean")
    # All modes of a vertex go with an edge in one row.
    wide = modes.groupBy(F.col("id").alias("dst")).agg(*(F.sum(F.when(F.col("k") == k, F.col("phi"))).alias(f"_{j}") for j, (k, _) in enumerate(levels)))
    sums = affinities.join(wide, "dst", "left").groupBy("src").agg(F.sum("w").alias("_d"), *(F.sum(F.col("w") * F.col(f"_{j}")).alias(f"_{j}") for j in range(len(levels))))
    each = F.array(*(F.struct(F.lit(k).cast(eigen.schema["k"].dataType).alias("k"), F.lit(e).cast("double").alias("epsilon"), F.col(f"_{j}").alias("_s")) for j, (k, e) in enumerate(levels)))
    rows = sums.join(potential.select(F.col("id").alias("src"), "v"), "src").select("src", "_d", "v", F.inline(each)).where("_s is not null")
    den = F.lit(alpha) + F.lit(beta) * F.col("v") - F.col("epsilon")
    safe = F.when(F.abs(den) >= floor, den).otherwise(F.when(den < 0, F.lit(-floor)).otherwise(F.lit(floor)))
    rows = stored(rows.select(F.col("src").alias("id"), "k", (F.lit(alpha) * F.col("_s") / F.col("_d") / safe).alias("phi"), F.abs(den).alias("_a")))
    stable = rows.groupBy("k").agg((F.min("_a") >= floor).alias("stable"))
    return rows.drop("_a").join(F.broadcast(stable), "k").select("id", "k", "phi", "stable")


def stable_prefix(stable: DataFrame) -> DataFrame:
    """One row: the number of leading modes (k, stable) that are stable."""
    flags = stable.select("k", "stable").distinct()
    return flags.agg((F.coalesce(F.min(F.when(~F.col("stable"), F.col("k"))), F.max("k") + 1) - 1).alias("prefix"))


def extend_stable(affinities: DataFrame, modes: DataFrame, potential: DataFrame, eigen: DataFrame, alpha: float = 1.0, beta: float = 1.0, strict: bool = True) -> DataFrame:
    """(id, k, phi) of the extension; an unstable mode is refused, or ends the common prefix that is returned."""
    ext = extend_modes(affinities, modes, potential, eigen, alpha, beta)
    bad = ext.where(~F.col("stable")).agg(F.min("k")).first()[0]
    if bad is not None and strict:
        raise ArithmeticError(f"mode {bad} is not stable")
    return ext.where(F.col("k") < (bad if bad is not None else 1 << 30)).select("id", "k", "phi")


def states(modes: DataFrame, selected: list[int] | None = None) -> DataFrame:
    """(id, k, a): values of the selected modes of each row, of unit length."""
    rows = modes if selected is None else modes.where(F.col("k").isin(*selected))
    norm = F.sqrt(F.sum(F.col("phi") * F.col("phi")).over(Window.partitionBy("id")) + 1e-12)
    return rows.withColumn("a", F.col("phi") / norm).select("id", "k", "a")


def occupations(state: Column) -> Column:
    """Squares of the components of a state array."""
    return F.transform(state, lambda a: a * a)
