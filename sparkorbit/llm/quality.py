"""Quality classifier: gated-attention multiple-instance learning over passages.

A document is a bag of passages of 64 words that cover its whole text.  Each
passage is described by shares of character classes and punctuation marks, word
repetition and hashed words, and encoded by a tanh layer.  Gated attention
weights, learnt from document labels only, combine the encoded passages; a
logistic unit scores the combination.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from . import textkernel as K
from .shared import materialize

PASSAGE = 64
HASHED = 32
#: Bounds of the fit, parameters of ``fit_quality``: labelled documents, passages of all of them.
MAX_LABELS, MAX_PASSAGES = 4000, 256_000
THRESHOLD = 0.3

_PUNCT = [c for c in range(33, 127) if not chr(c).isalnum()]
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91], _CLASS[48:58], _CLASS[0xC0:] = 1, 2, 3
_CLASS[_PUNCT] = np.arange(4, 4 + len(_PUNCT))
_KINDS = 4 + len(_PUNCT)
FEATURES = 6 + _KINDS - 1 + HASHED


def passage_features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages and their bounds by row; a row without words has one of zeros."""
    n = len(offs) - 1
    starts, ends, row = K.words(data, offs)
    per = np.bincount(row, minlength=n)
    bounds = np.concatenate(([0], np.cumsum(np.maximum(1, -(-per // PASSAGE)))))
    total = int(bounds[-1])
    x = np.zeros((total, FEATURES), np.float32)
    if not len(starts):
        return x, bounds
    begin = np.concatenate(([0], np.cumsum(per)))
    pid = bounds[row] + (np.arange(len(row)) - begin[row]) // PASSAGE
    count = np.bincount(pid, minlength=total)
    some = np.maximum(count, 1)
    size = np.bincount(pid, ends - starts, minlength=total)
    value = K.word_values(data, starts, ends)
    again = np.zeros(len(value))
    again[1:] = (value[1:] == value[:-1]) & (row[1:] == row[:-1])
    order = np.lexsort((value, pid))
    fresh = np.ones(len(order))
    fresh[1:] = (value[order][1:] != value[order][:-1]) | (pid[order][1:] != pid[order][:-1])
    x[:, 0] = np.log1p(count) / 4
    x[:, 1] = size / some / 10
    x[:, 2] = np.bincount(pid, again, minlength=total) / some
    x[:, 3] = np.bincount(pid[order], fresh, minlength=total) / some
    x[:, 4] = np.bincount(pid, ends - starts == 1, minlength=total) / some
    x[:, 5] = np.log1p(per[np.repeat(np.arange(n), np.diff(bounds))]) / 8
    kind = _CLASS[data]
    at = np.flatnonzero(kind)
    where = pid[np.searchsorted(starts, at, "right") - 1]
    marks = np.bincount(where * _KINDS + kind[at], minlength=total * _KINDS).reshape(total, _KINDS)[:, 1:]
    x[:, 6 : 6 + _KINDS - 1] = np.sqrt(marks / some[:, None])
    slot = (value >> np.uint64(59)).astype(np.int64)
    sign = 1.0 - 2.0 * (value & np.uint64(1)).astype(np.float64)
    x[:, -HASHED:] = np.bincount(pid * HASHED + slot, sign, minlength=total * HASHED).reshape(total, HASHED) / np.sqrt(some)[:, None]
    return x, bounds


class Attention:
    """Encoder, gated attention and output unit; all sizes are fixed."""

    def __init__(self, hidden: int = 16, gate: int = 8, seed: int = 11):
        rng = np.random.Generator(np.random.PCG64(seed))
        draw = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
        self.w = {"enc": draw(FEATURES, hidden), "enc0": np.zeros(hidden), "tan": draw(hidden, gate), "sig": draw(hidden, gate), "att": draw(gate, 1)[:, 0], "out": draw(hidden, 1)[:, 0], "out0": np.zeros(1)}
        self.mean, self.scale, self.constant = np.zeros(FEATURES), np.ones(FEATURES), None

    def _forward(self, x: np.ndarray, bounds: np.ndarray) -> dict:
        w, of = self.w, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        h = np.tanh(x @ w["enc"] + w["enc0"])
        t, g = np.tanh(h @ w["tan"]), 1 / (1 + np.exp(-(h @ w["sig"])))
        e = (t * g) @ w["att"]
        a = np.exp(e - np.maximum.reduceat(e, bounds[:-1])[of])
        a /= np.add.reduceat(a, bounds[:-1])[of]
        s = h @ w["out"]
        return {"of": of, "h": h, "t": t, "g": g, "a": a, "s": s, "z": np.add.reduceat(a * s, bounds[:-1]) + w["out0"][0]}

    def score(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(bounds) - 1, self.constant)
        z = self._forward(np.clip((x - self.mean) / self.scale, -5, 5), bounds)["z"]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def fit(self, x: np.ndarray, bounds: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.02, decay: float = 1e-4) -> Attention:
        """Adam on the whole sample; labels of one kind, or none, give a constant score."""
        if not len(y) or y.min() == y.max():
            self.constant = float((y.sum() + 1) / (len(y) + 2)) if len(y) else 0.5
            return self
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
        x = np.clip((x - self.mean) / self.scale, -5, 5)
        w, moved = self.w, {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.w.items()}
        for step in range(1, rounds + 1):
            f = self._forward(x, bounds)
            of, h, t, g, a, s = (f[k] for k in ("of", "h", "t", "g", "a", "s"))
            err = ((1 / (1 + np.exp(-np.clip(f["z"], -30, 30))) - y) / len(y))[of]
            de = a * err * (s - np.add.reduceat(a * s, bounds[:-1])[of])
            dt = de[:, None] * w["att"] * g * (1 - t * t)
            dg = de[:, None] * w["att"] * t * g * (1 - g)
            dh = (err * a)[:, None] * w["out"] + dt @ w["tan"].T + dg @ w["sig"].T
            dp = dh * (1 - h * h)
            grad = {"enc": x.T @ dp, "enc0": dp.sum(axis=0), "tan": h.T @ dt, "sig": h.T @ dg, "att": (de[:, None] * t * g).sum(axis=0), "out": h.T @ (err * a), "out0": np.array([np.add.reduceat(err * a, bounds[:-1]).sum()])}
            for k, d in grad.items():
                m, v = moved[k]
                d = d + decay * w[k]
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                w[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self


def held_out(id_col: str) -> Column:
    """Rows never learnt from: crc32 of the id as text, a null one as empty, divisible by 5."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def fit_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_labels: int = MAX_LABELS, max_passages: int = MAX_PASSAGES) -> Attention:
    """Fit on at most ``max_labels`` labelled documents that are not held out.

    They are chosen by a hash of their id and learnt from whole: documents are taken
    in that order until they have ``max_passages`` passages.  Null labels are no
    labels; several labels of a document are averaged; several rows of a document
    count as one.
    """
    known = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("double").alias("y")).where("y is not null and label_id is not null")
    known = known.where(~held_out("label_id")).groupBy("label_id").agg(F.avg("y").alias("y"))
    known = known.orderBy(F.xxhash64("label_id"), "label_id").limit(max_labels)
    rows = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("passages")).join(F.broadcast(known), "label_id")

    def described(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, offs = K.utf8(batch.column(2))
            x, n = [], []
            for i, j in K.chunks(offs):
                f, b = passage_features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                for k in range(j - i):
                    x.append(f[b[k] : b[k + 1]].tobytes())
                    n.append(int(b[k + 1] - b[k]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(x, pa.binary())], ["label_id", "y", "n", "x"])

    kind = rows.schema["label_id"].dataType.simpleString()
    bags = materialize(rows.select("label_id", "y", "passages").mapInArrow(described, f"label_id {kind}, y double, n long, x binary"), "bags")
    # A repeated document is learnt from once: of rows of one id the text with the largest features counts.
    bags = materialize(bags.groupBy("label_id").agg(F.max(F.struct("n", "x", "y")).alias("b")).select("label_id", "b.n", "b.x", "b.y"), "bags")
    before = Window.orderBy("o", "label_id").rowsBetween(Window.unboundedPreceding, -1)
    ids = bags.select("label_id", "n", F.xxhash64("label_id").alias("o"))  # max_labels rows at most
    ids = ids.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("first") < max_passages).select("label_id")
    got = bags.join(F.broadcast(ids), "label_id").select("label_id", "y", "x").collect()
    got = sorted(got, key=lambda r: (r["label_id"], bytes(r["x"])))
    bags = [np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES) for r in got]
    y = np.array([r["y"] for r in got])
    bounds = np.concatenate(([0], np.cumsum([len(b) for b in bags]))).astype(np.int64)
    return Attention().fit(np.concatenate(bags).astype(np.float64) if bags else np.zeros((0, FEATURES)), bounds, y)


def quality_scores(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **bounds: int) -> DataFrame:
    """All columns of ``docs`` with ``held_out``, ``score`` and ``predicted`` (replaced if there).

    The score reads the text alone.  Null and empty texts get the score of an
    empty passage; without labels every score is 0.5.
    """
    model = fit_quality(docs, labels, label_col, id_col, text_col, **bounds)
    docs = docs.drop("held_out", "score", "predicted")
    at = docs.columns.index(text_col)

    def scored(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, offs = K.utf8(batch.column(at))
            out = np.zeros(batch.num_rows)
            for i, j in K.chunks(offs):
                out[i:j] = model.score(*passage_features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.round(out, 6))], [*batch.schema.names, "score"])

    schema = StructType([*docs.schema.fields]).add("score", DoubleType())
    out = docs.mapInArrow(scored, schema)
    return out.select(*docs.columns, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
