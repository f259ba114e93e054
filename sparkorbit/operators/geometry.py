"""A learnt geometry: a tanh network fitted on a bounded sample, applied in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MAX_ROWS = 80_000
ARCHITECTURES = ((32, 8), (64, 16), (64, 32, 8), (128, 32))


@dataclass
class Geometry:
    weights: list[tuple[np.ndarray, np.ndarray]]
    mean: np.ndarray
    scale: np.ndarray
    loss: float

    def hidden(self, x: np.ndarray) -> np.ndarray:
        for w, b in self.weights[:-1]:
            x = np.tanh(x @ w + b)
        return x

    def embed(self, x: np.ndarray) -> np.ndarray:
        """The standardized last hidden layer."""
        return (self.hidden(x) - self.mean) / self.scale

    def transform(self, df: DataFrame, vector_col: str, name: str = "embedding") -> DataFrame:
        """``df`` with the embedding of its vector column."""
        at = df.columns.index(vector_col)

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                x = np.array(batch.column(at).to_pylist(), np.float64)
                out = self.embed(x).tolist() if len(x) else []
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))], [*batch.schema.names, name])

        from pyspark.sql.types import ArrayType, DoubleType, StructType

        return df.mapInArrow(run, StructType([*df.schema.fields]).add(name, ArrayType(DoubleType())))


def fit_geometry(x: np.ndarray, y: np.ndarray, groups: np.ndarray, layers: tuple[int, ...] = ARCHITECTURES[0], epochs: int = 60, batch: int = 256, rate: float = 1e-3, patience: int = 8, decay: float = 1e-4, seed: int = 0) -> Geometry:
    """Adam on the log loss; every tenth group (by hash) stops the fit early."""
    if len(x) > MAX_ROWS:
        raise ValueError(f"a geometry is fitted on at most {MAX_ROWS} rows")
    rng = np.random.Generator(np.random.PCG64(seed))
    sizes = [x.shape[1], *layers, 1]
    p = [v for a, b in zip(sizes, sizes[1:], strict=False) for v in (rng.normal(0, np.sqrt(1 / a), (a, b)), np.zeros(b))]
    held = (groups.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(10) == 0
    if held.all() or not held.any():
        held = np.arange(len(x)) % 10 == 0
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    fit, step, best, since = np.flatnonzero(~held), 0, (np.inf, [a.copy() for a in p]), 0

    def forward(rows: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        acts = [rows]
        for i in range(0, len(p) - 2, 2):
            acts.append(np.tanh(acts[-1] @ p[i] + p[i + 1]))
        return acts, 1 / (1 + np.exp(-np.clip((acts[-1] @ p[-2] + p[-1])[:, 0], -30, 30)))

    def loss(rows: np.ndarray) -> float:
        q = np.clip(forward(x[rows])[1], 1e-7, 1 - 1e-7)
        return float(-(y[rows] * np.log(q) + (1 - y[rows]) * np.log(1 - q)).mean())

    for _ in range(epochs):
        rng.shuffle(fit)
        for i in range(0, len(fit), batch):
            rows = fit[i : i + batch]
            acts, q = forward(x[rows])
            d, grads = ((q - y[rows]) / len(rows))[:, None], []
            for layer in range(len(p) // 2 - 1, -1, -1):
                a = acts[layer]
                grads = [a.T @ d + decay * p[2 * layer], d.sum(axis=0), *grads]
                if layer:
                    d = (d @ p[2 * layer].T) * (1 - a * a)
            step += 1
            for k, g in enumerate(grads):
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        now = loss(np.flatnonzero(held))
        if now < best[0] - 1e-5:
            best, since = (now, [a.copy() for a in p]), 0
        elif (since := since + 1) >= patience:
            break
    weights = list(zip(best[1][::2], best[1][1::2], strict=True))
    out = Geometry(weights, np.zeros(layers[-1]), np.ones(layers[-1]), best[0])
    h = out.hidden(x[~held])
    out.mean, out.scale = h.mean(axis=0), np.maximum(h.std(axis=0), 1e-5)
    return out
