import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkorbit.llm import quality
from sparkorbit.llm.mixing import MADE, apply_mix, mix_sources
from sparkorbit.llm.quality import Attention, FEATURES, quality_scores


def test_held_out_accuracy(spark, sf):
    big = sf.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{big}/labels.parquet")
    got = quality_scores(docs, labels).join(labels, "doc_id").collect()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == r["quality"] for r in held]) >= 0.95


def test_scores_read_the_text_alone(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (3, 0), (7, 1), (9, 0), (2, None), (None, 1), (1, 1)], "doc_id long, quality int")
    got = quality_scores(odd_docs, labels)
    assert got.columns == [*odd_docs.columns, "held_out", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == odd_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r["text"], set()).add(r["score"])
    assert all(len(v) == 1 for v in by.values())
    assert by[""] == by[None]
    assert quality_scores(no_docs, labels).count() == 0
    none = quality_scores(odd_docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}


def test_gradient_of_the_attention_model():
    rng = np.random.default_rng(0)
    x, bounds, y = rng.normal(size=(9, FEATURES)), np.array([0, 2, 5, 9]), np.array([0.0, 1.0, 1.0])
    model = Attention().fit(x, bounds, y, rounds=200, rate=0.05)
    assert (np.abs(model.score(x, bounds) - y) < 0.2).all()


def water(sizes, share=1.5, limit=2, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if w[s] * level > limit * sizes[s]}
        if not over:
            return out | {s: w[s] * level for s in free}
        for s in over:
            out[s] = limit * sizes[s]
            left -= out[s]
        free -= over
    return out


@pytest.mark.parametrize("parts", [3, 11])
def test_mix_meets_targets(spark, parts):
    rng = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(int(rng.paretovariate(1.2) * 20))), rng.choice(["a", "b", "é", "z", None, ""]) if i % 3 else "hot") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
    got = mix_sources(docs).collect()
    assert len(got) == len(rows)
    size, taken, biggest = {}, {}, {}
    for r in got:
        s = r["source"]
        assert r["size"] == len(r["text"].split()) and 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        size[s] = size.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    want = water(size)
    for r in got:
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * want[r["source"]]
    for s in size:
        assert abs(taken[s] - want[s]) <= 0.03 * want[s] + 2, s
    rest = mix_sources(docs.repartition(2)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in rest) == sorted((r["doc_id"], r["taken"]) for r in got)


def test_mix_odd_rows(spark, odd_docs, no_docs):
    got = mix_sources(odd_docs)
    assert set(odd_docs.columns) <= set(got.columns)
    rows = got.collect()
    assert len(rows) == odd_docs.count() and all(r["copies"] in (0, 1, 2) for r in rows)
    assert {r["taken"] for r in rows if not (r["text"] or "").split()} == {0}
    assert mix_sources(no_docs).count() == 0
    clash = odd_docs.withColumns({c: F.lit("own") for c in (*MADE, "copy", "mx_copy", "row", "k", "u", "v", "sid", "up", "again", "of")})
    mixed = apply_mix(clash).collect()
    assert len(mixed) == sum(r["copies"] for r in rows)
    assert all({r[c] for r in mixed} == {"own"} for c in MADE)
    assert got.select(F.sum("taken")).first()[0] > 0


def test_one_document_many_times_meets_its_target(spark):
    rows = [(7, "x " * 55, "b") for _ in range(300)] + [(i, "w " * random.Random(i).randint(1, 90), "a") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mix_sources(docs).collect()
    taken = sum(r["taken"] for r in got if r["source"] == "b")
    target = next(r["target"] for r in got if r["source"] == "b")
    assert len(got) == 700 and abs(taken - target) <= 0.03 * target
    again = mix_sources(docs.repartition(2)).collect()
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(map(key, again)) == sorted(map(key, got))


def test_rates_match_a_solver_of_one_source(spark):
    """The rates are those of a bisection on lambda, and the rounding keeps them within one copy."""
    rng = random.Random(4)
    rows = [(i, "w " * int(rng.paretovariate(1.1) * 15), "abc"[i % 3]) for i in range(600)]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in "abc":
        mine = [r for r in got if r["source"] == s]
        size = np.array([r["size"] for r in mine], float)
        x, target = (size / size.mean()) ** 0.25, mine[0]["target"]
        words = lambda lam: (size * np.minimum(2, np.exp(lam * x))).sum()  # noqa: B023, E731
        low, high = -60.0, 60.0
        for _ in range(200):
            low, high = ((low + high) / 2, high) if words((low + high) / 2) < target else (low, (low + high) / 2)
        want = np.minimum(2, np.exp(low * x)) if target < 2 * size.sum() * (1 - 1e-9) else np.full(len(size), 2.0)
        assert np.allclose([r["rate"] for r in mine], want, rtol=1e-6)
        assert all(r["copies"] >= np.floor(r["rate"] + 1e-9) for r in mine)


def test_a_repeated_document_is_learnt_from_once(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(quality.Attention, "fit", lambda self, x, bounds, y: seen.update(y=y) or self)
    ids = [i for i in range(1, 30) if zlib.crc32(str(i).encode()) % 5][:6]
    docs = spark.createDataFrame([(i, f"some text {i}") for i in ids for _ in range(50)], "doc_id long, text string")
    quality.fit_quality(docs, spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int"))
    assert len(seen["y"]) == 6


def test_scores_match_a_scalar_model():
    """One passage at a time, by plain sums; the gradient of the fit by differences."""
    rng = np.random.default_rng(2)
    model = Attention(seed=3)
    x, bounds = rng.normal(size=(7, FEATURES)), np.array([0, 3, 4, 7])
    w = model.w
    for d in range(3):
        weights, values = [], []
        for p in x[bounds[d] : bounds[d + 1]]:
            p = np.clip(p, -5, 5)
            h = [math.tanh(sum(a * b for a, b in zip(p, w["enc"][:, j])) + w["enc0"][j]) for j in range(16)]
            gate = 0.0
            for g in range(8):
                t = math.tanh(sum(a * b for a, b in zip(h, w["tan"][:, g])))
                gate += w["att"][g] * t / (1 + math.exp(-sum(a * b for a, b in zip(h, w["sig"][:, g]))))
            weights.append(math.exp(gate))
            values.append(sum(a * b for a, b in zip(h, w["out"])))
        z = sum(a * b for a, b in zip(weights, values)) / sum(weights) + w["out0"][0]
        assert abs(model.score(x, bounds)[d] - 1 / (1 + math.exp(-z))) < 1e-9


def test_fit_reads_every_passage_of_a_long_document(spark, monkeypatch):
    seen = {}

    def fit(self, x, bounds, y, **how):
        seen.update(x=x, bounds=bounds)
        return self

    monkeypatch.setattr(quality.Attention, "fit", fit)
    ids = [i for i in range(1, 60) if zlib.crc32(str(i).encode()) % 5][:8]
    docs = spark.createDataFrame([(i, " ".join(f"w{j % 89}" for j in range(64 * 100))) for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    quality.fit_quality(docs, labels)
    assert np.diff(seen["bounds"]).tolist() == [100] * 8 and len(seen["x"]) == 800
    quality.fit_quality(docs, labels, max_passages=300)
    assert np.diff(seen["bounds"]).tolist() == [100] * 3
