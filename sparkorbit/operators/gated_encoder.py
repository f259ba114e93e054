"""A track encoder whose input branches can close, and a parallel search among its shapes.

A jet is a list of tracks, each the branches of ``tracks.node_inputs`` side by side
(its own fields first, which stay open).  Branches pass gates; a tanh layer, attention
heads and a mean pool the tracks; with the jet's context they pass 1 to 3 tanh layers,
the last of which is the geometry, and a logistic unit.  A gate is the hard-concrete
gate of Louizos et al. (2018) without noise: a stretched sigmoid cut to [0, 1], whose
chance to be open is penalized.

A fit minimizes over all rows: tasks add up loss and gradient of theirs, and only those
sums, as many as parameters, come to the driver.  So the result does not depend on how
rows are partitioned, but for rounding, and no sample is drawn.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from ..functions.stored import release, stored
from .readout import lbfgs
from .roles import split_fraction

#: Limits and temperature of a hard-concrete gate.
LOW, HIGH, TEMPERATURE = -0.1, 1.1, 2 / 3
#: Share of the events, by hash, whose loss decides when a fit has been best.
HELD = 0.1
#: Bytes of the sample that every trial of a search holds.
SAMPLE_BYTES = 256 << 20


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass(frozen=True)
class Jets:
    """Rows as arrays: tracks of all jets, where each jet begins, context, label and whether its event is held out."""

    x: np.ndarray
    begin: np.ndarray
    context: np.ndarray
    y: np.ndarray
    held: np.ndarray

    def take(self, rows: np.ndarray) -> Jets:
        size = np.diff(self.begin)[rows]
        begin = np.concatenate(([0], np.cumsum(size)))
        at = np.repeat(self.begin[:-1][rows] - begin[:-1], size) + np.arange(begin[-1])
        return Jets(self.x[at], begin, self.context[rows], self.y[rows], self.held[rows])


def jets_of(batch: pa.RecordBatch | pa.Table, width: int) -> Jets:
    """Rows (nodes, context [, y, held]); a jet without tracks has one of zeros."""

    def one(name: str) -> pa.Array:
        c = batch[name]
        return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c

    nodes, rows = one("nodes"), batch.num_rows
    size = np.nan_to_num(nodes.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    flat = nodes.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    begin = np.concatenate(([0], np.cumsum(np.maximum(size, 1))))
    x = np.zeros((begin[-1], width))
    x[np.repeat(size > 0, np.maximum(size, 1))] = flat
    number = lambda name: one(name).to_numpy(zero_copy_only=False).astype(float) if name in batch.schema.names else np.zeros(rows)
    context = one("context").flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)
    if not (np.isfinite(x).all() and np.isfinite(context).all()):
        raise ValueError("a track or context value is null or not finite")
    return Jets(x, begin, context, number("y"), number("held") > 0)


@dataclass(frozen=True)
class Shape:
    """Sizes of an encoder: fields of a branch, branches, context values, and what a search chooses."""

    fields: int
    branches: int
    context: int
    hidden: int = 16
    geometry: int = 16
    depth: int = 1
    heads: int = 1

    def __post_init__(self) -> None:
        if self.depth not in (1, 2, 3) or self.heads not in (1, 2, 4):
            raise ValueError("an encoder has 1 to 3 layers and 1, 2 or 4 heads")

    def parts(self) -> dict[str, tuple[int, ...]]:
        pooled = (self.heads + 1) * self.hidden + self.context
        layers = {}
        for k in range(self.depth):
            layers |= {f"layer{k}": (self.geometry if k else pooled, self.geometry), f"bias{k}": (self.geometry,)}
        return {"node": (self.fields * self.branches, self.hidden), "node0": (self.hidden,), "attend": (self.hidden, self.heads), **layers, "out": (self.geometry,), "out0": (1,), "gates": (self.branches - 1,)}

    def parameters(self) -> int:
        return sum(int(np.prod(s)) for s in self.parts().values())

    def unpack(self, theta: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, size in self.parts().items():
            n = int(np.prod(size))
            out[name], at = theta[at : at + n].reshape(size), at + n
        return out

    def pack(self, w: dict[str, np.ndarray]) -> np.ndarray:
        return np.concatenate([w[name].ravel() for name in self.parts()])

    def start(self, seed: int = 0) -> np.ndarray:
        rng = np.random.default_rng(seed)
        w = {n: rng.normal(0, s[0] ** -0.5, s) if len(s) == 2 else np.zeros(s) for n, s in self.parts().items()}
        return self.pack(w | {"out": rng.normal(0, self.geometry**-0.5, self.geometry), "gates": np.ones(self.branches - 1)})


def gate_values(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gates and their slopes by the logits; chances to be open and theirs."""
    s = _sigmoid(logits / TEMPERATURE)
    wide = s * (HIGH - LOW) + LOW
    inside = (wide > 0) & (wide < 1)
    open_ = _sigmoid(logits - TEMPERATURE * np.log(-LOW / HIGH))
    return np.clip(wide, 0, 1), inside * (HIGH - LOW) * s * (1 - s) / TEMPERATURE, open_, open_ * (1 - open_)


def forward(shape: Shape, w: dict[str, np.ndarray], gates: np.ndarray, d: Jets) -> dict:
    """All that the gradient needs, with ``layers`` (the last one is the geometry) and ``p``."""
    size = np.diff(d.begin)
    of = np.repeat(np.arange(len(size)), size)
    gated = d.x * np.repeat(gates, shape.fields)
    h = np.tanh(gated @ w["node"] + w["node0"])
    e = h @ w["attend"] / np.sqrt(shape.hidden)
    e = np.exp(e - np.maximum.reduceat(e, d.begin[:-1])[of]) if len(size) else e
    a = e / np.add.reduceat(e, d.begin[:-1])[of] if len(size) else e
    total = lambda v: np.add.reduceat(v, d.begin[:-1]) if len(size) else np.zeros((0, v.shape[1]))
    pooled = [total(a[:, [m]] * h) for m in range(shape.heads)]
    layers = [np.concatenate([*pooled, total(h) / size[:, None], d.context], axis=1)]
    for k in range(shape.depth):
        layers.append(np.tanh(layers[-1] @ w[f"layer{k}"] + w[f"bias{k}"]))
    return {"of": of, "size": size, "gated": gated, "h": h, "a": a, "total": total, "layers": layers, "p": _sigmoid(layers[-1] @ w["out"] + w["out0"][0])}


def loss_sum(shape: Shape, theta: np.ndarray, d: Jets, hard: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """Summed log loss of some jets and its gradient; those of all jets are their sums.

    ``hard`` fixes the gates; their logits then have no gradient.
    """
    w = shape.unpack(theta)
    soft, slope, _, _ = gate_values(w["gates"])
    gates = np.concatenate(([1.0], soft)) if hard is None else hard
    f = forward(shape, w, gates, d)
    p = np.clip(f["p"], 1e-12, 1 - 1e-12)
    loss = float(-(d.y * np.log(p) + (1 - d.y) * np.log(1 - p)).sum())
    back = f["p"] - d.y
    g = {"out": f["layers"][-1].T @ back, "out0": np.array([back.sum()])}
    flow = back[:, None] * w["out"]
    for k in reversed(range(shape.depth)):
        flow = flow * (1 - f["layers"][k + 1] ** 2)
        g[f"layer{k}"], g[f"bias{k}"] = f["layers"][k].T @ flow, flow.sum(axis=0)
        flow = flow @ w[f"layer{k}"].T
    h, a, of, n = f["h"], f["a"], f["of"], shape.hidden
    dh = (flow[:, shape.heads * n : (shape.heads + 1) * n] / f["size"][:, None])[of]
    de = np.zeros_like(a)
    for m in range(shape.heads):
        by_track = flow[:, m * n : (m + 1) * n][of]
        dh += a[:, [m]] * by_track
        s = (h * by_track).sum(axis=1, keepdims=True)
        de[:, m] = (a[:, [m]] * (s - f["total"](a[:, [m]] * s)[of]))[:, 0]
    de /= np.sqrt(n)
    g["attend"] = h.T @ de
    dh = (dh + de @ w["attend"].T) * (1 - h * h)
    g["node"], g["node0"] = f["gated"].T @ dh, dh.sum(axis=0)
    by_gate = ((dh @ w["node"].T) * d.x).sum(axis=0).reshape(shape.branches, shape.fields).sum(axis=1)[1:]
    g["gates"] = by_gate * slope if hard is None else np.zeros(shape.branches - 1)
    return loss, shape.pack(g)


def penalty(shape: Shape, theta: np.ndarray, l2: float, l0: float, hard: bool) -> tuple[float, np.ndarray]:
    """Ridge of the weights that are matrices, and the chances of the gates to be open."""
    w = shape.unpack(theta)
    _, _, open_, slope = gate_values(w["gates"])
    ridge = {n: v if v.ndim == 2 or n == "out" else np.zeros_like(v) for n, v in w.items()}
    g = {n: l2 * v for n, v in ridge.items()} | {"gates": np.zeros_like(open_) if hard else l0 * slope}
    return l2 / 2 * sum(float((v * v).sum()) for v in ridge.values()) + (0.0 if hard else l0 * float(open_.sum())), shape.pack(g)


#: Of parameters: mean log loss of the fitted rows, its gradient, and the mean log loss of the held rows.
Evaluate = Callable[[np.ndarray, np.ndarray | None], tuple[float, np.ndarray, float]]


def local_evaluate(shape: Shape, d: Jets) -> Evaluate:
    own, held = d.take(np.flatnonzero(~d.held)), d.take(np.flatnonzero(d.held))

    def value(theta: np.ndarray, hard: np.ndarray | None) -> tuple[float, np.ndarray, float]:
        loss, g = loss_sum(shape, theta, own, hard)
        n = max(1, len(own.y))
        return loss / n, g / n, loss_sum(shape, theta, held, hard)[0] / max(1, len(held.y))

    return value


def spread_evaluate(shape: Shape, rows: DataFrame, n: int, n_held: int) -> Evaluate:
    """The same over rows (nodes, context, y, held) of any number, by sums of tasks."""

    def value(theta: np.ndarray, hard: np.ndarray | None) -> tuple[float, np.ndarray, float]:
        def part(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(len(theta) + 2)
            for batch in it:
                d = jets_of(batch, shape.fields * shape.branches)
                loss, g = loss_sum(shape, theta, d.take(np.flatnonzero(~d.held)), hard)
                sums[0] += loss
                sums[1] += loss_sum(shape, theta, d.take(np.flatnonzero(d.held)), hard)[0]
                sums[2:] += g
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)], ["at", "value"])

        out = np.zeros(len(theta) + 2)
        for r in rows.mapInArrow(part, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
            out[r["at"]] = r["value"]
        return out[0] / n, out[2:] / n, out[1] / max(1, n_held)

    return value


def harden(soft: np.ndarray, threshold: float, least: int) -> np.ndarray:
    """Gates of 0 and 1, the first one open: those at the threshold or above, and the largest ``least`` in any case."""
    keep = soft >= threshold
    keep[np.argsort(-soft, kind="stable")[:least]] = True
    return np.concatenate(([1.0], keep.astype(float)))


@dataclass
class GatedEncoder:
    """``fit`` on rows (event, y, nodes, context), then ``transform`` rows with nodes and context."""

    shape: Shape
    steps: int = 40
    refit_steps: int = 15
    l2: float = 1e-4
    l0: float = 2e-3
    threshold: float = 0.5
    least_branches: int = 1
    seed: int = 0
    theta: np.ndarray | None = None
    trained: np.ndarray | None = None  # parameters before the gates were hardened
    gates: np.ndarray | None = None
    soft: np.ndarray | None = None
    loss: float = float("nan")
    path: list[dict] = field(default_factory=list)

    def _stage(self, evaluate: Evaluate, theta: np.ndarray, steps: int, hard: np.ndarray | None, keep_last: bool) -> np.ndarray:
        """Minimize; the parameters of the least held-out loss, or the last ones."""
        best = [np.inf, theta]

        def value(x: np.ndarray) -> tuple[float, np.ndarray]:
            loss, g, held = evaluate(x, hard)
            more, gm = penalty(self.shape, x, self.l2, self.l0, hard is not None)
            self.path.append({"hard": hard is not None, "loss": loss, "held": held})
            if held < best[0]:
                best[:] = held, x.copy()
            return loss + more, g + gm

        last, _ = lbfgs(value, theta, steps=steps)
        return last if keep_last else best[1]

    def fit_with(self, evaluate: Evaluate) -> GatedEncoder:
        """Fit with soft gates to the end, so that the penalty can close them; harden; fit the rest again."""
        self.path = []
        theta = self._stage(evaluate, self.shape.start(self.seed) if self.theta is None else self.theta, self.steps, None, True)
        self.trained = theta
        self.soft = np.concatenate(([1.0], gate_values(self.shape.unpack(theta)["gates"])[0]))
        self.gates = harden(self.soft[1:], self.threshold, min(self.least_branches, self.shape.branches - 1))
        self.theta = self._stage(evaluate, theta, self.refit_steps, self.gates, False)
        self.loss = evaluate(self.theta, self.gates)[2]
        return self

    def fit(self, df: DataFrame) -> GatedEncoder:
        """Every row takes part; a tenth of the events, by hash, only decides which parameters are kept.

        Null labels, and tracks or contexts of another size, null or not finite, are
        refused; a null or empty list of tracks is one track of zeros.
        """
        rows = stored(labelled(df))
        n, n_held = check_rows(rows, self.shape)
        self.fit_with(spread_evaluate(self.shape, rows.select("nodes", "context", "y", "held"), n, n_held))
        release(rows)
        return self

    def parameters(self) -> int:
        """Parameters that are in use: those of closed branches are not."""
        closed = int((self.gates == 0).sum()) if self.gates is not None else 0
        return self.shape.parameters() - closed * self.shape.fields * self.shape.hidden - (self.shape.branches - 1 if self.gates is not None else 0)

    def closed(self) -> list[int]:
        """Numbers of the closed branches; branch 0, the tracks' own fields, never is."""
        return np.flatnonzero(self.gates == 0).tolist()

    def transform(self, df: DataFrame, name: str = "geometry", p: str = "p") -> DataFrame:
        """``df`` with the geometry of every jet and its probability of label 1."""
        shape, theta, gates = self.shape, self.theta, self.gates
        schema = StructType([*df.schema.fields]).add(name, ArrayType(DoubleType())).add(p, DoubleType())

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w = shape.unpack(theta)
            for batch in it:
                f = forward(shape, w, gates, jets_of(batch.select(["nodes", "context"]), shape.fields * shape.branches))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(f["layers"][-1]), pa.list_(pa.float64())), pa.array(f["p"])], schema.fieldNames())

        return df.mapInArrow(run, schema)


def labelled(df: DataFrame) -> DataFrame:
    """(nodes, context, y, held) of rows with event, y, nodes and context."""
    nodes, context = F.col("nodes").cast("array<array<double>>"), F.col("context").cast("array<double>")
    return df.select(nodes.alias("nodes"), context.alias("context"), F.col("y").cast("int").alias("y"), split_fraction(F.col("event"), HELD).alias("held"))


def check_rows(rows: DataFrame, shape: Shape) -> tuple[int, int]:
    """Rows that are fitted and held out; refuses what a fit cannot use."""
    width = shape.fields * shape.branches
    wrong = F.col("y").isNull() | ~F.col("y").isin(0, 1) | (F.coalesce(F.size("context"), F.lit(-1)) != shape.context)
    wrong |= F.coalesce(F.exists("nodes", lambda t: F.coalesce(F.size(t), F.lit(-1)) != width), F.lit(False))
    own = ~F.coalesce("held", F.lit(False))
    r = rows.agg(F.sum(own.cast("long")).alias("n"), F.sum((~own).cast("long")).alias("held"), F.max(wrong).alias("wrong"), F.countDistinct(F.when(own, F.col("y"))).alias("classes")).first()
    if not r["n"] or r["wrong"] or r["classes"] != 2:
        raise ValueError(f"an encoder needs both classes, {width} values for each track and {shape.context} of context")
    return r["n"], r["held"]


def search(df: DataFrame, shape: Shape, candidates: list[dict], rungs: tuple[int, ...] = (5, 15, 40), keep: float = 0.5, finalists: int = 3, sample: int = 80_000, seed: int = 0, **how) -> DataFrame:
    """(arm, settings, rung, steps, loss, score, parameters, closed, error, rank): encoders of many shapes, tried in parallel.

    Every candidate, settings of ``shape``, is a task over the same broadcast sample: the
    ``sample`` rows (event, y, nodes, context, key) of the smallest hash, of at most
    ``SAMPLE_BYTES``.  After each rung the better share ``keep`` goes on, at least the
    ``finalists``, from where it was, with more steps.  The score is the held-out loss +
    0.15 * the mean change of a probability when a jet loses every fifth track + 0.005 *
    ln(1 + parameters / 1000).  A trial that fails is recorded with its error and goes no
    further.  ``rank`` orders by rung, the last first, then by score, parameters and arm.
    """
    spark = df.sparkSession
    picked = df.orderBy(F.xxhash64("key", F.lit(seed)), "key").limit(sample)
    rows = stored(labelled(picked))
    check_rows(rows, shape)
    bytes_ = rows.agg(F.sum(F.coalesce(F.size("nodes"), F.lit(0)) + 2)).first()[0] * shape.fields * shape.branches * 8
    if bytes_ > SAMPLE_BYTES:
        raise ValueError(f"the sample has {bytes_} bytes, more than {SAMPLE_BYTES}: take fewer rows")
    held = spark.sparkContext.broadcast(jets_of(rows.toArrow(), shape.fields * shape.branches))
    release(rows)

    def trial(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = held.value
        for frame in it:
            out = []
            for r in frame.itertuples():
                made = {"arm": r.arm, "loss": None, "score": None, "parameters": None, "closed": None, "error": None, "theta": None}
                try:
                    own = replace(shape, **candidates[r.arm])
                    m = GatedEncoder(own, steps=r.steps, refit_steps=max(2, r.steps // 3), seed=seed, theta=None if r.theta is None else np.array(r.theta), **how)
                    m.fit_with(local_evaluate(own, d))
                    if not np.isfinite(m.loss):
                        raise ArithmeticError("the loss is not finite")
                    made |= {"loss": m.loss, "parameters": m.parameters(), "closed": len(m.closed()), "theta": m.trained.tolist()}
                    made["score"] = m.loss + 0.15 * shift(m, d) + 0.005 * np.log1p(m.parameters() / 1000)
                except Exception as e:  # noqa: BLE001  a trial that fails is a result
                    made["error"] = f"{type(e).__name__}: {e}"[:300]
                out.append(made)
            yield pd.DataFrame(out, columns=["arm", "loss", "score", "parameters", "closed", "error", "theta"])

    kind = "arm int, loss double, score double, parameters long, closed int, error string, theta array<double>"
    alive, theta, rows_ = list(range(len(candidates))), {}, []
    for k, steps in enumerate(rungs):
        todo = spark.createDataFrame([(i, steps, theta.get(i)) for i in alive], "arm int, steps int, theta array<double>")
        got = todo.repartitionByRange(len(alive), "arm").mapInPandas(trial, kind).collect()  # a row for each candidate
        rows_ += [(r["arm"], str(sorted(candidates[r["arm"]].items())), k, steps, r["loss"], r["score"], r["parameters"], r["closed"], r["error"]) for r in got]
        fine = sorted((r for r in got if r["error"] is None), key=lambda r: (r["score"], r["parameters"], r["arm"]))
        theta = {r["arm"]: r["theta"] for r in fine}
        alive = [r["arm"] for r in fine[: max(finalists, int(np.ceil(keep * len(alive))))]]
        if not alive:
            break
    last = {r[0]: r for r in rows_}
    order = sorted(last.values(), key=lambda r: (r[8] is not None, -r[2], r[5] if r[5] is not None else 0, r[6] or 0, r[0]))
    return spark.createDataFrame([(*r, i + 1) for i, r in enumerate(order)], "arm int, settings string, rung int, steps int, loss double, score double, parameters long, closed int, error string, rank int")


def shift(model: GatedEncoder, d: Jets) -> float:
    """Mean change of the probability of held-out jets that lose every fifth track; the first track stays."""
    d = d.take(np.flatnonzero(d.held))
    if not len(d.y):
        return 0.0
    size = np.diff(d.begin)
    place = np.arange(len(d.x)) - np.repeat(d.begin[:-1], size)
    left = place % 5 != 4
    begin = np.concatenate(([0], np.cumsum(np.add.reduceat(left.astype(np.int64), d.begin[:-1]))))
    w = model.shape.unpack(model.theta)
    before, after = (forward(model.shape, w, model.gates, x)["p"] for x in (d, replace(d, x=d.x[left], begin=begin)))
    return float(np.abs(before - after).mean())

