"""A track encoder: a shared map of each track, attention and mean pooling, a geometry layer.

Fitted on a bounded sample of jets; applied in Arrow batches.  Branches (attention,
mean, context) carry gates in [0, 1] that a penalty can close.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, StructType

MAX_JETS = 80_000


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class TrackEncoder:
    """``fit`` on lists of (tracks x fields) arrays with jet context; ``embed`` gives the geometry layer."""

    nodes: int = 16
    layer: int = 8
    epochs: int = 40
    batch: int = 256
    rate: float = 5e-3
    gate_penalty: float = 0.0
    patience: int = 8
    seed: int = 0
    w: dict[str, np.ndarray] = field(default_factory=dict)

    def _flat(self, tracks: list[np.ndarray], fields: int) -> tuple[np.ndarray, np.ndarray]:
        """All tracks with their jets; a jet without tracks has one of zeros."""
        tracks = [t if len(t) else np.zeros((1, fields)) for t in tracks]
        return np.concatenate(tracks), np.concatenate(([0], np.cumsum([len(t) for t in tracks]))).astype(np.int64)

    def _forward(self, x: np.ndarray, b: np.ndarray, context: np.ndarray) -> dict:
        w, of = self.w, np.repeat(np.arange(len(b) - 1), np.diff(b))
        h = np.tanh(x @ w["node"] + w["node0"])
        e = h @ w["att"]
        a = np.exp(e - np.maximum.reduceat(e, b[:-1])[of])
        a /= np.add.reduceat(a, b[:-1])[of]
        n = np.diff(b)[:, None]
        parts = [np.add.reduceat(a[:, None] * h, b[:-1]), np.add.reduceat(h, b[:-1]) / n, context]
        g = _sigmoid(w["gate"])
        z = np.concatenate([p * s for p, s in zip(parts, g, strict=True)], axis=1)
        t = np.tanh(z @ w["geo"] + w["geo0"])
        return {"of": of, "h": h, "a": a, "n": n, "parts": parts, "g": g, "z": z, "t": t, "p": _sigmoid(t @ w["out"] + w["out0"])}

    def _gradient(self, x: np.ndarray, b: np.ndarray, context: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, f = self.w, self._forward(x, b, context)
        d = (f["p"] - y) / len(y)
        dt = d[:, None] * w["out"] * (1 - f["t"] ** 2)
        dz = dt @ w["geo"].T
        cuts = np.cumsum([p.shape[1] for p in f["parts"]])[:-1]
        dparts = np.split(dz, cuts, axis=1)
        gate = np.array([(p * q).sum() for p, q in zip(f["parts"], dparts, strict=True)]) + self.gate_penalty
        of, h, a = f["of"], f["h"], f["a"]
        da, dm = dparts[0] * f["g"][0], dparts[1] * f["g"][1] / f["n"]
        s = (h * da[of]).sum(axis=1)
        de = a * (s - np.add.reduceat(a * s, b[:-1])[of])
        dh = (a[:, None] * da[of] + dm[of] + de[:, None] * w["att"]) * (1 - h * h)
        return {"node": x.T @ dh, "node0": dh.sum(axis=0), "att": h.T @ de, "gate": gate * f["g"] * (1 - f["g"]), "geo": f["z"].T @ dt, "geo0": dt.sum(axis=0), "out": f["t"].T @ d, "out0": np.array([d.sum()])}

    def fit(self, tracks: list[np.ndarray], context: np.ndarray, y: np.ndarray, groups: np.ndarray) -> TrackEncoder:
        """Adam; every tenth group stops the fit early, so no event is on both sides."""
        if len(tracks) > MAX_JETS:
            raise ValueError(f"an encoder is fitted on at most {MAX_JETS} jets")
        rng = np.random.Generator(np.random.PCG64(self.seed))
        fields, k = next((t.shape[1] for t in tracks if len(t)), 1), context.shape[1]
        draw = lambda a, c: rng.normal(0, a**-0.5, (a, c))
        wide = 2 * self.nodes + k
        self.w = {"node": draw(fields, self.nodes), "node0": np.zeros(self.nodes), "att": draw(self.nodes, 1)[:, 0], "gate": np.full(3, 2.0), "geo": draw(wide, self.layer), "geo0": np.zeros(self.layer), "out": draw(self.layer, 1)[:, 0], "out0": np.zeros(1)}
        held = (groups.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(10) == 0
        if held.all() or not held.any():
            held = np.arange(len(y)) % 10 == 0
        rows, check = np.flatnonzero(~held), np.flatnonzero(held)
        moved = {n: [np.zeros_like(v), np.zeros_like(v)] for n, v in self.w.items()}
        step, since, best = 0, 0, (np.inf, {n: v.copy() for n, v in self.w.items()})
        for _ in range(self.epochs):
            rng.shuffle(rows)
            for i in range(0, len(rows), self.batch):
                pick = rows[i : i + self.batch]
                step += 1
                for n, g in self._gradient(*self._flat([tracks[j] for j in pick], fields), context[pick], y[pick]).items():
                    m, v = moved[n]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    self.w[n] -= self.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            p = np.clip(self.predict([tracks[j] for j in check], context[check]), 1e-7, 1 - 1e-7)
            loss = float(-(y[check] * np.log(p) + (1 - y[check]) * np.log(1 - p)).mean())
            if loss < best[0] - 1e-5:
                best, since = (loss, {n: v.copy() for n, v in self.w.items()}), 0
            elif (since := since + 1) >= self.patience:
                break
        self.w = best[1]
        return self

    def predict(self, tracks: list[np.ndarray], context: np.ndarray) -> np.ndarray:
        return self._forward(*self._flat(tracks, len(self.w["node"])), context)["p"]

    def embed(self, tracks: list[np.ndarray], context: np.ndarray) -> np.ndarray:
        return self._forward(*self._flat(tracks, len(self.w["node"])), context)["t"]

    def parameters(self) -> int:
        return int(sum(v.size for v in self.w.values()))

    def transform(self, df: DataFrame, tracks_col: str, context_col: str, name: str = "embedding") -> DataFrame:
        """``df`` with the embedding of its track array (array of number arrays) and context array."""
        a, c = df.columns.index(tracks_col), df.columns.index(context_col)
        fields = len(self.w["node"])

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                rows = [np.array(t, np.float64).reshape(-1, fields) for t in batch.column(a).to_pylist()]
                out = self.embed(rows, np.array(batch.column(c).to_pylist(), np.float64)).tolist() if rows else []
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))], [*batch.schema.names, name])

        return df.mapInArrow(run, StructType([*df.schema.fields]).add(name, ArrayType(DoubleType())))
