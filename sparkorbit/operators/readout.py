"""Quadratic-form readout: class probabilities p_c = a' M_c a of unit states.

M_c = S^-1/2 E_c S^-1/2 with E_c = B_c' B_c + (rho / C) I and S = sum E_c, so the M_c
are positive semidefinite and add up to the identity.  Up to ``MAX_ROWS`` states are
fitted on the driver; of more, the tasks add up the gradient by M_c, K x K sums for each
class, and only those come to the driver.  Prediction is an expression.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prefix import running_sums
from ..functions.stored import release, stored

MAX_ROWS = 10_000
#: Of matrices M_c: the weighted negative log-likelihood, and its gradient by each M_c.
Likelihood = Callable[[np.ndarray], tuple[float, np.ndarray]]


def lbfgs(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int = 300, memory: int = 10, tol: float = 1e-7) -> tuple[np.ndarray, float]:
    """Limited-memory BFGS with backtracking; f gives value and gradient."""
    value, g = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(g).max() < tol:
            break
        d, held = g.copy(), []
        for s, y in reversed(pairs):
            a = (s @ d) / (y @ s)
            d -= a * y
            held.append(a)
        if pairs:
            s, y = pairs[-1]
            d *= (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(held), strict=True):
            d += (a - (y @ d) / (y @ s)) * s
        step, slope = 1.0 if pairs else min(1.0, 1.0 / np.abs(g).sum()), -(g @ d)
        if slope >= 0:
            d, slope, pairs = g, -(g @ g), []
        while True:
            new, ng = f(x - step * d)
            if new <= value + 1e-4 * step * slope or step < 1e-12:
                break
            step *= 0.5
        s, y = -step * d, ng - g
        x, change = x + s, value - new
        value, g = new, ng
        if s @ y > 1e-12 * np.linalg.norm(s) * np.linalg.norm(y):
            pairs = [*pairs, (s, y)][-memory:]
        if change < 1e-12 * max(1.0, abs(value)):
            break
    return x, value


def inverse_root(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """S^-1/2, eigenvectors and eigenvalues."""
    e, u = np.linalg.eigh((s + s.T) / 2)
    e = np.maximum(e, 1e-12)
    return (u / np.sqrt(e)) @ u.T, u, e


def measurements(b: np.ndarray, rho: float) -> np.ndarray:
    """M_c of the factors b (classes, rank, k)."""
    c, _, k = b.shape
    e = np.einsum("cri,crj->cij", b, b) + rho / c * np.eye(k)
    t, _, _ = inverse_root(e.sum(axis=0))
    return t @ e @ t


@dataclass
class Readout:
    m: np.ndarray
    loss: float

    def check(self) -> None:
        """The M_c add up to the identity and have no negative eigenvalue."""
        if np.abs(self.m.sum(axis=0) - np.eye(self.m.shape[1])).max() > 1e-6 or min(np.linalg.eigvalsh(x).min() for x in self.m) < -1e-8:
            raise ArithmeticError("the measurement is not complete and positive")

    def entries(self, df: DataFrame, c: int = 1) -> DataFrame:
        """(i, j, m) of one class, from 1."""
        k = self.m.shape[1]
        return df.sparkSession.createDataFrame([(i + 1, j + 1, float(self.m[c, i, j])) for i in range(k) for j in range(k)], "i int, j int, m double")


def partial_sums(m: np.ndarray, a: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Likelihood and gradient by M_c of some rows; those of all rows are their sums."""
    own = np.zeros(len(y))
    g = np.zeros_like(m)
    for c in range(len(m)):
        of = y == c
        x = a[of]
        own[of] = np.maximum(((x @ m[c]) * x).sum(axis=1), 1e-12)
        g[c] = -(x * (w[of] / own[of])[:, None]).T @ x
    return float(-(w * np.log(own)).sum()), g


def local_likelihood(a: np.ndarray, y: np.ndarray, w: np.ndarray) -> Likelihood:
    return lambda m: partial_sums(m, a, y, w)


def spread_likelihood(rows: DataFrame, total: float) -> Likelihood:
    """The same over rows (a: array, y, w) of any number: one pass for each value, sums of tasks come together."""

    def value(m: np.ndarray) -> tuple[float, np.ndarray]:
        def part(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros(1 + m.size)
            for batch in it:
                a = batch["a"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, m.shape[1])
                loss, g = partial_sums(m, a, batch["y"].to_numpy(zero_copy_only=False), batch["w"].to_numpy(zero_copy_only=False) / total)
                held[0] += loss
                held[1:] += g.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(held.size)), pa.array(held)], ["at", "value"])

        sums = np.zeros(1 + m.size)
        for r in rows.select("a", "y", "w").mapInArrow(part, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
            sums[r["at"]] = r["value"]
        return float(sums[0]), sums[1:].reshape(m.shape)

    return value


def penalized(b: np.ndarray, likelihood: Likelihood, rho: float, l2: float) -> tuple[float, np.ndarray]:
    """Negative log-likelihood plus l2 of factors b, and its gradient, flat.

    The derivative of S^-1/2 is a Hadamard product in the eigenbasis of S.
    """
    classes, _, k = b.shape
    e = np.einsum("cri,crj->cij", b, b) + rho / classes * np.eye(k)
    t, u, s = inverse_root(e.sum(axis=0))
    loss, g = likelihood(t @ e @ t)
    q = sum(g[c] @ t @ e[c] + e[c] @ t @ g[c] for c in range(classes))
    root = np.sqrt(s)
    kernel = -1 / (root[:, None] * root[None, :] * (root[:, None] + root[None, :]))
    r = u @ (kernel * (u.T @ q @ u)) @ u.T
    grad = np.stack([2 * b[c] @ (t @ g[c] @ t + (r + r.T) / 2) for c in range(classes)]) + 2 * l2 * b
    return loss + l2 * float((b * b).sum()), grad.ravel()


def loss_and_gradient(b: np.ndarray, a: np.ndarray, y: np.ndarray, w: np.ndarray, rho: float, l2: float) -> tuple[float, np.ndarray]:
    return penalized(b, local_likelihood(a, y, w), rho, l2)


def fit_measurement(likelihood: Likelihood, classes: int, k: int, rank: int = 0, rho: float = 1e-3, l2: float = 1e-4, restarts: int = 2, seed: int | tuple[int, ...] = 0, steps: int = 300) -> Readout:
    """The best of the restarts, of at most ``steps`` each; ``rank`` 0 takes two factors, or one if there is one mode."""
    rank = min(rank or 2, k)
    best = None
    for run in range(max(1, restarts)):
        start = np.random.default_rng([*np.atleast_1d(seed), run]).normal(0, 0.5, classes * rank * k)
        x, loss = lbfgs(lambda x: penalized(x.reshape(classes, rank, k), likelihood, rho, l2), start, steps=steps)
        if best is None or loss < best[1]:
            best = (x, loss)
    out = Readout(measurements(best[0].reshape(classes, rank, k), rho), best[1])
    out.check()
    return out


def fit_readout(a: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None, **how) -> Readout:
    """A readout of states on the driver."""
    if len(a) > MAX_ROWS:
        raise ValueError(f"a readout is fitted on the driver on at most {MAX_ROWS} rows: use fit_states")
    w = np.ones(len(y)) if weights is None else weights
    classes = max(2, int(y.max()) + 1 if len(y) else 2)
    return fit_measurement(local_likelihood(a, y, w / w.sum()), classes, a.shape[1], **how)


def fit_states(states: DataFrame, **how) -> Readout:
    """A readout of states (id, a: array, y [, w]), any number of them.

    Labels are 0, 1, ...; states are arrays of one size without nulls, weights are not
    negative.  Rows without a label or with a weight of 0 take no part.
    """
    weight = F.col("w").cast("double") if "w" in states.columns else F.lit(1.0)
    rows = states.select("id", F.col("a").cast("array<double>").alias("a"), F.col("y").cast("int").alias("y"), weight.alias("w")).where("y is not null and w <> 0")
    rows = stored(rows)
    wrong = (F.col("y") < 0) | (F.col("w") < 0) | F.isnan("w") | F.exists("a", lambda x: x.isNull() | F.isnan(x)) | F.col("a").isNull()
    size = rows.agg(F.count("*").alias("n"), F.max("y").alias("y"), F.sum("w").alias("w"), F.min(F.size("a")).alias("k"), F.max(F.size("a")).alias("most"), F.max(wrong).alias("wrong")).first()
    if not size["n"] or size["wrong"] or size["k"] != size["most"]:
        raise ValueError("states need labels from 0, weights that are not negative, and arrays of one size without nulls")
    classes = max(2, size["y"] + 1)
    if size["n"] <= MAX_ROWS:
        held = sorted(rows.collect(), key=lambda r: (r["id"], r["a"], r["y"], r["w"]))
        a, y, w = (np.array([r[c] for r in held]) for c in ("a", "y", "w"))
        likelihood = local_likelihood(a, y, w / size["w"])
    else:
        likelihood = spread_likelihood(rows, size["w"])
    out = fit_measurement(likelihood, classes, size["k"], **how)
    release(rows)
    return out


def quadratic(state: Column, m: np.ndarray) -> Column:
    """a' M a of a state array."""
    rows = [sum((F.get(state, F.lit(j)) * float(v) for j, v in enumerate(r) if v), F.lit(0.0)) for r in m]
    return sum((F.get(state, F.lit(i)) * r for i, r in enumerate(rows)), F.lit(0.0))


def probability(state: DataFrame, measurement: DataFrame) -> DataFrame:
    """(id, p, diagonal, cross): a' M a of rows (id, k, a) and entries (i, j, m), split by i = j and i <> j."""
    rows = state.withColumnRenamed("k", "i").join(F.broadcast(measurement), "i")
    rows = rows.join(state.select("id", F.col("k").alias("j"), F.col("a").alias("_b")), ["id", "j"])
    term = F.col("a") * F.col("m") * F.col("_b")
    out = rows.groupBy("id").agg(F.sum(term).alias("p"), F.sum(F.when(F.col("i") == F.col("j"), term).otherwise(0.0)).alias("diagonal"))
    return out.withColumn("cross", F.col("p") - F.col("diagonal"))


def hard_examples(df: DataFrame, n: int, key: str, score: str = "score", label: str = "y") -> DataFrame:
    """The ``n`` background rows of the highest and signal rows of the lowest scores."""
    order = Window.partitionBy(label).orderBy(F.when(F.col(label) == 1, F.col(score)).otherwise(-F.col(score)), key)
    return df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def decomposition(state: DataFrame, m0: DataFrame, m1: DataFrame) -> DataFrame:
    """(id, p, diagonal, diagonal_only, cross) of class 1: parts over the sum of both classes, ``diagonal_only`` over that of the diagonals."""
    zero, one = (probability(state, m).select("id", F.col("p").alias(f"_p{c}"), F.col("diagonal").alias(f"_d{c}")) for c, m in enumerate((m0, m1)))
    both = zero.join(one, "id")
    all_, diagonal = F.greatest(F.col("_p0") + F.col("_p1"), F.lit(1e-12)), F.greatest(F.col("_d0") + F.col("_d1"), F.lit(1e-12))
    return both.select("id", (F.col("_p1") / all_).alias("p"), (F.col("_d1") / all_).alias("diagonal"), (F.col("_d1") / diagonal).alias("diagonal_only"), ((F.col("_p1") - F.col("_d1")) / all_).alias("cross"))


def summary(r: Readout) -> dict:
    """For each class the weight off the diagonal and the smallest eigenvalue; how far the matrices are from a complete set."""
    norm = np.linalg.norm
    rows = [{"class": c, "off_diagonal_norm": float(norm(m - np.diag(np.diag(m)))), "off_diagonal_share": float(norm(m - np.diag(np.diag(m))) / max(norm(m), 1e-12)), "least_eigenvalue": float(np.linalg.eigvalsh(m).min())} for c, m in enumerate(r.m)]
    return {"classes": rows, "completeness_error": float(np.abs(r.m.sum(axis=0) - np.eye(r.m.shape[1])).max()), "loss": r.loss}


def compactness(selected: list[int], dimensions: dict[str, int]) -> dict:
    """The number of selected modes against the dimensions of the stages before."""
    k = len(selected)
    return {"modes": k, "selected": sorted(selected), "dimensions": dimensions, "ratios": {n: k / d for n, d in dimensions.items()}, "reduces": {n: k < d for n, d in dimensions.items()}}


def bounded_rows(states: DataFrame, most: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """States (id, a: array, y) of a bounded table as arrays, in the order of the id; more rows are refused."""
    rows = states.select("id", "a", "y").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a readout is fitted on at most {most} rows")
    rows.sort(key=lambda r: r["id"])
    return np.array([r["a"] for r in rows], float), np.array([r["y"] for r in rows], int)


def hardest(df: DataFrame, n: int, key: str, score: str = "score", label: str = "y") -> DataFrame:
    """The rows of ``hard_examples`` without their place, for any ``n``: no task orders a class.

    Running sums over the score find the cut; rows that tie there are taken by ``key``.
    """
    rows = df.withColumn("_s", F.when(F.col(label) == 1, F.col(score)).otherwise(-F.col(score))).withColumn("_one", F.lit(1))
    better = running_sums(rows, "_s", {"_below": "_one"}, (label,), inclusive=False)
    upto = running_sums(rows.groupBy(label, "_s").agg(F.count("*").alias("_n")), "_s", {"_upto": "_n"}, (label,)).select(label, "_s", F.col("_upto").alias("_upto"))
    better = better.where(F.col("_below") < n).join(upto.where(F.col("_upto") > n).groupBy(label).agg(F.min("_s").alias("_cut")), label, "left")
    whole = better.where(F.col("_cut").isNull() | (F.col("_s") < F.col("_cut"))).select(*df.columns)
    tied = running_sums(better.where(F.col("_s") == F.col("_cut")), key, {"_before": "_one"}, (label,), inclusive=False)
    return whole.unionByName(tied.where(F.col("_below") + F.col("_before") < n).select(*df.columns))


def fit_with_hard_examples(train: DataFrame, mining: DataFrame, iterations: int = 2, share: float = 0.1, weight: float = 3.0, seed: int = 0, **how) -> tuple[Readout, list[dict]]:
    """A readout fitted again with the hardest rows of ``mining`` at a higher weight; and the losses of the fits.

    Both tables have (id, a, y) and both classes, and any number of rows.  In every
    iteration the background rows of the highest and the signal rows of the lowest
    probability, ceil(share * smaller class) of each, join the training rows.  A fit's
    record has its rows and loss, those of hard rows also their mean probability before it.
    """
    columns = lambda df, w: df.select("id", "a", "y", F.lit(float(w)).alias("w"))
    own, other = ({r["y"]: r["n"] for r in df.groupBy("y").agg(F.count("*").alias("n")).collect()} for df in (train, mining))
    if set(own) != {0, 1} or (iterations and set(other) != {0, 1}):
        raise ValueError("both tables need both classes")
    out = fit_states(columns(train, 1), seed=(seed, 0), **how)
    fits = [{"rows": sum(own.values()), "hard": 0, "loss": out.loss}]
    most = max(1, -int(-share * min(other.values()) // 1)) if iterations else 0
    for k in range(1, iterations + 1):
        hard = stored(hardest(mining.withColumn("score", quadratic(F.col("a"), out.m[1])), most, "id"))
        seen = hard.agg(F.count("*").alias("n"), F.avg("score").alias("p")).first()
        out = fit_states(columns(train, 1).union(columns(hard, weight)), seed=(seed, k), **how)
        fits.append({"rows": sum(own.values()) + seen["n"], "hard": seen["n"], "loss": out.loss, "mean_probability": seen["p"]})
        release(hard)
    return out, fits
