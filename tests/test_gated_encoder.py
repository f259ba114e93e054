import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkorbit.operators import gated_encoder as G
from sparkorbit.operators import tracks as tk
from sparkorbit.plans.catalog import QUERIES

SHAPE = G.Shape(fields=2, branches=4, context=2, hidden=5, geometry=4, depth=2, heads=2)


def made(n, seed=1):
    """Jets whose label shows in branch 2 alone; branches 1 and 3 are noise."""
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    nodes = [rng.normal(0, 0.5, size=(int(rng.integers(0, 6)), 8)) for _ in y]
    for t, c in zip(nodes, y, strict=True):
        if len(t):
            t[:, 4] += 2.5 * c
    return [(i, i // 2, int(c), t.tolist(), rng.normal(size=2).tolist()) for i, (t, c) in enumerate(zip(nodes, y, strict=True))]


def frame(spark, rows):
    return spark.createDataFrame(rows, "key long, event long, y int, nodes array<array<double>>, context array<double>")


def arrays(spark, rows):
    return G.jets_of(G.labelled(frame(spark, rows)).toArrow(), 8)


@pytest.mark.parametrize("depth, heads, hard", [(1, 1, False), (2, 2, False), (3, 4, False), (2, 2, True)])
def test_all_gradients(spark, depth, heads, hard):
    shape = G.replace(SHAPE, depth=depth, heads=heads)
    d = arrays(spark, made(40))
    rng = np.random.default_rng(3)
    theta = shape.start(1) + 0.1 * rng.normal(size=shape.parameters())
    gates = np.array([1.0, 0.0, 1.0, 1.0]) if hard else None

    def value(x):
        loss, g = G.loss_sum(shape, x, d, gates)
        more, gm = G.penalty(shape, x, 0.01, 0.3, hard)
        return loss + more, g + gm

    g = value(theta)[1]
    for i in [*rng.integers(0, len(theta), 40), *range(len(theta) - 3, len(theta))]:
        e = np.zeros(len(theta))
        e[i] = 1e-6
        assert g[i] == pytest.approx((value(theta + e)[0] - value(theta - e)[0]) / 2e-6, abs=2e-6, rel=1e-5)
    assert not hard or not g[-3:].any()


def test_sums_do_not_depend_on_partitions(spark):
    rows = made(300)
    theta = SHAPE.start(2)
    near = G.local_evaluate(SHAPE, arrays(spark, rows))(theta, None)
    for parts in (1, 5):
        df = G.labelled(frame(spark, rows)).repartition(parts)
        n, held = G.check_rows(df, SHAPE)
        far = G.spread_evaluate(SHAPE, df, n, held)(theta, None)
        assert abs(near[0] - far[0]) < 1e-12 and np.abs(near[1] - far[1]).max() < 1e-12 and abs(near[2] - far[2]) < 1e-12


def test_fit_closes_noise_and_transforms(spark):
    df = frame(spark, made(500))
    model = G.GatedEncoder(SHAPE, steps=25, refit_steps=6, l0=0.05).fit(df)
    assert model.gates[0] == 1 and 2 not in model.closed() and set(model.closed()) & {1, 3}
    assert model.parameters() == SHAPE.parameters() - 3 - len(model.closed()) * 2 * 5
    assert {p["hard"] for p in model.path} == {True, False} and model.loss == min(p["held"] for p in model.path if p["hard"])
    out = model.transform(df.where("size(nodes) > 0")).collect()
    assert np.mean([(r["p"] > 0.5) == r["y"] for r in out]) > 0.9 and {len(r["geometry"]) for r in out} == {4}
    empty = model.transform(frame(spark, [(1, 1, 0, [], [0.0, 0.0]), (2, 1, 0, None, [0.0, 0.0])])).collect()
    assert empty[0]["p"] == empty[1]["p"]


def test_refusals(spark):
    good = made(40)
    for bad in ([(1, 1, None, [], [0.0, 0.0])], [(1, 1, 0, [[1.0]], [0.0, 0.0])], [(1, 1, 0, [], [0.0])], [(1, 1, 0, [], None)]):
        with pytest.raises(ValueError, match="both classes"):
            G.GatedEncoder(SHAPE).fit(frame(spark, good + bad))
    with pytest.raises(ValueError):
        G.Shape(1, 1, 1, depth=4)
    assert G.harden(np.array([0.2, 0.4, 0.1]), 0.5, 1).tolist() == [1, 0, 1, 0]


def test_search_halves_and_records_failures(spark):
    df = frame(spark, made(240))
    arms = [{"hidden": 3}, {"hidden": 6, "heads": 2}, {"depth": 7}, {"geometry": 3, "depth": 2}, {"hidden": 8}]
    rows = G.search(df, SHAPE, arms, rungs=(3, 6), keep=0.5, finalists=2).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == [1, 2, 3, 4, 5] and len({r["arm"] for r in rows}) == 5
    bad = rows[-1]
    assert bad["arm"] == 2 and "layers" in bad["error"] and bad["loss"] is None
    assert [r["rung"] for r in rows] == [1, 1, 1, 0, 0] and all(r["parameters"] > 0 for r in rows[:4])
    again = G.search(df.repartition(7), SHAPE, arms, rungs=(3, 6), keep=0.5, finalists=2).orderBy("rank").collect()
    assert [r["arm"] for r in again] == [r["arm"] for r in rows]
    with pytest.raises(ValueError, match="bytes"):
        old, G.SAMPLE_BYTES = G.SAMPLE_BYTES, 10
        try:
            G.search(df, SHAPE, arms)
        finally:
            G.SAMPLE_BYTES = old


def test_on_relation_inputs(spark, sf):
    rows = QUERIES["architecture_search"](spark, sf).collect()
    assert len(rows) == 6 and sorted(r["rank"] for r in rows) == list(range(1, 7)) and all(r["error"] is None and 0 < r["loss"] < 1 for r in rows)
    tracks = spark.createDataFrame([(1, 1, 0.5, 1.0, 0.0, 0.0), (1, 2, 1.0, 0.0, 1.0, 0.0), (2, 1, 2.0, 2.0, 2.0, 0.0)], "jet long, slot int, s double, z double, u double, v double")
    nodes = tk.node_inputs(tracks, "jet", "slot", ["s", "z"], "hybrid", ["u", "v"], 2, 1.0)
    assert {len(r["x"]) for r in nodes.collect()} == {10}
    assert nodes.groupBy("jet").agg(F.collect_list("x")).count() == 2
