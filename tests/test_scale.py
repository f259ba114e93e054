"""Operators without a bound on rows: the pivot join, the distributed eigensolver and readout, against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkorbit.operators import graph, metric_join, readout, spectrum
from sparkorbit.operators.eigensolver import smallest_modes


def brute(queries, points, k, exclude):
    out = []
    for i, x in queries:
        near = sorted((float(((np.array(x) - np.array(p)) ** 2).sum()), j) for j, p in points if not (exclude and i == j))[:k]
        out += [(i, j, r + 1, d) for r, (d, j) in enumerate(near)]
    return sorted(out)


def rows(df):
    return sorted((r["src"], r["dst"], r["rank"], r["d2"]) for r in df.collect())


def same(got, want):
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert np.allclose([x[3] for x in got], [x[3] for x in want], rtol=1e-12, atol=1e-300)


@pytest.mark.parametrize("exclude", [True, False])
def test_pivot_join_with_copies_ties_and_clusters(spark, exclude):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 5)) * 30
    points = [(i, (centres[i % 6] + rng.normal(size=5)).tolist()) for i in range(500)]
    points += [(1000 + i, points[3][1]) for i in range(250)]  # a third of all equal
    points += [(2000 + i, [float(i % 2), 0.0, 0.0, 0.0, float(i % 3)]) for i in range(60)]  # ties
    df = spark.createDataFrame(points, "vec_id long, embedding array<double>").repartition(5)
    same(rows(metric_join.knn_by_pivots(df, df, 4, exclude_self=exclude, block_rows=40)), brute(points, points, 4, exclude))


def test_pivot_join_of_other_queries_and_few_points(spark):
    points = [(i, [float(i), 1e150]) for i in range(3)]
    queries = [(7, [0.4, 1e150]), (7, [0.4, 1e150]), (1, [1.0, 1e150])]
    p, q = (spark.createDataFrame(x, "vec_id long, embedding array<double>") for x in (points, queries))
    want = sorted((i, j, r, (j - x[0]) ** 2) for i, x in queries for r, j in enumerate(sorted(range(3), key=lambda j: (abs(j - x[0]), j)), 1))
    same(rows(metric_join.knn_by_pivots(q, p, 5, block_rows=1)), want)
    assert metric_join.knn_by_pivots(q, p.limit(0), 5).count() == 0 and metric_join.knn_by_pivots(q.limit(0), p, 5).count() == 0
    for bad in ([(1, None)], [(1, [1.0])], [(1, [float("nan"), 0.0])], [(None, [1.0, 1.0])]):
        with pytest.raises(Exception, match="components|finite|no id"):
            metric_join.knn_by_pivots(spark.createDataFrame(bad, "vec_id long, embedding array<double>"), p, 1).collect()


def test_few_copies_are_made_of_queries_in_clusters(spark):
    """A query in a tight cluster meets the blocks of its cluster only."""
    rng = np.random.default_rng(1)
    x = np.repeat(np.eye(8) * 1000, 200, axis=0) + rng.normal(size=(1600, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    cells = metric_join._Cells(x[::200].copy())
    cells.cell, cells.count, cells.least, cells.most = np.arange(8), np.full(8, 200), np.zeros(8), np.full(8, 10.0)
    asked = df.select(F.col("id").alias("q"), "v", F.lit(16.0).alias("d2"))
    assert metric_join._wanted(asked, cells, 9, False).count() == 1600
    assert metric_join._wanted(asked, cells, 9, True).count() == 0
    assert metric_join._wanted(asked.withColumn("d2", F.lit(None).cast("double")), cells, 9, True).count() == 1600 * 7


def test_large_graphs_take_the_pivot_join(spark, sf, monkeypatch):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    want = rows(graph.knn(e, e, 6, exclude_self=True))
    monkeypatch.setattr(graph, "MAX_LANDMARKS", 10)
    monkeypatch.setattr(metric_join, "BLOCK_BYTES", 8 * 64 * 64)
    same(rows(graph.knn(e, e, 6, exclude_self=True)), want)


def test_dense_affinities_of_more_landmarks_than_are_broadcast(spark, monkeypatch, rows=20):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(90, 4))
    x[30:37] = x[2]  # copies: distances of zero, and scales that take the median
    df = spark.createDataFrame([(5 * i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    queries, marks = df.where("vec_id % 2 = 1").union(df.where("vec_id in (10, 150)")), df.where("vec_id % 2 = 0")
    near = graph.dense_affinities(queries, marks)
    want = {r["src"]: np.array(r["w"]) for r in near.collect()}
    totals = {r["src"]: r for r in graph.affinity_totals(near, 7).collect()}
    monkeypatch.setattr(graph, "MAX_LANDMARKS", 10)
    monkeypatch.setattr(graph, "TILE_ROWS", rows)
    tiles = graph.dense_affinities(queries, marks)
    got = {}
    for r in sorted(tiles.collect(), key=lambda r: r["first"]):
        assert len(r["w"]) <= rows and len(got.setdefault(r["src"], [])) == r["first"]
        got[r["src"]] += r["w"]
    assert got.keys() == want.keys() and all(np.allclose(got[i], want[i], rtol=1e-9, atol=1e-300) for i in want)
    for r in graph.affinity_totals(tiles, 7).collect():
        w, one = want[r["src"]], totals[r["src"]]
        assert r["n"] == one["n"] == len(w) == 45 and r["most"] == pytest.approx(one["most"]) == pytest.approx(w.max())
        assert r["total"] == pytest.approx(one["total"]) == pytest.approx(w.sum()) and r["placed"] == pytest.approx(one["placed"]) == pytest.approx(w @ (np.arange(45) % 7))


def test_neighbours_of_a_graph_are_computed_once(spark, monkeypatch):
    """Edges and extended modes read what was written; copies of vectors of single precision are moved as such."""
    from sparkorbit.operators import spectrum

    rng = np.random.default_rng(12)
    x = rng.normal(size=(150, 4)).astype(np.float32).astype(float)
    x[20:29] = x[3]  # distances of zero: scales that take the median
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    want = {(r["src"], r["dst"]): r["w"] for r in graph.self_tuning_graph(df)[0].collect()}
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    edges, scales = graph.self_tuning_graph(df)
    assert "MapInArrow" not in plan(edges) and "MapInArrow" not in plan(scales)
    d2 = ((x[:, None] - x) ** 2).sum(axis=2) + np.diag(np.full(150, np.inf))
    sigma = np.sqrt(np.sort(d2, axis=1)[:, 3])
    sigma = np.where(sigma > 0, sigma, np.median(sigma[sigma > 0]))
    assert [r["sigma"] for r in scales.orderBy("id").collect()] == pytest.approx(sigma.tolist())
    monkeypatch.setattr(graph, "MAX_LANDMARKS", 10)
    moved = []
    monkeypatch.setattr(metric_join, "_meet", lambda asked, wanted, points, *a, f=metric_join._meet: moved.append((asked.schema["v"].dataType.simpleString(), points.schema["v"].dataType.simpleString())) or f(asked, wanted, points, *a))
    edges = graph.self_tuning_graph(df)[0]
    assert "MapInArrow" not in plan(edges) and "Window" not in plan(edges)
    assert moved == [("array<float>", "array<float>")] * 2
    got = {(r["src"], r["dst"]): r["w"] for r in edges.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-300) for k in want)
    graph.knn(df.withColumn("embedding", F.transform("embedding", lambda v: v / 3)), df, 2).collect()
    assert moved[2:] == [("array<double>", "array<float>")] * 2
    assert metric_join._group_rows(615_420, 64) == 16_384 and metric_join._group_rows(51_282, 64) == 8192

    modes = spark.createDataFrame([(i, k, math.cos(k * i)) for i in range(0, 150, 2) for k in (1, 2, 3)], "id long, k int, phi double")
    pot = spark.createDataFrame([(i, 0.4 - 1 if i == 7 else 0.5) for i in range(149)], "id long, v double")
    eigen = spark.createDataFrame([(1, 0.1), (2, 0.4), (3, 0.3), (4, 0.2)], "k int, epsilon double")
    out = spectrum.extend_modes(edges, modes, pot, eigen)
    assert "Exchange hashpartitioning(dst" not in plan(out)
    rows = {(r["id"], r["k"]): (r["phi"], r["stable"]) for r in out.collect()}
    total: dict = {}
    sums: dict = {}
    for (i, j), w in want.items():
        total[i] = total.get(i, 0) + w
        for k in (1, 2, 3) if j % 2 == 0 else ():
            sums[i, k] = sums.get((i, k), 0) + w * math.cos(k * j)
    assert rows.keys() == {key for key in sums if key[0] < 149}
    for (i, k), (phi, stable) in rows.items():
        den = 1 + (0.4 - 1 if i == 7 else 0.5) - {1: 0.1, 2: 0.4, 3: 0.3}[k]
        den = den if abs(den) >= 1e-6 else (-1e-6 if den < 0 else 1e-6)
        assert phi == pytest.approx(sums[i, k] / total[i] / den, rel=1e-7, abs=1e-12) and stable == (k != 2)


def ring(spark, n, seed):
    """The Laplacian of a ring with chords, and a potential."""
    rng = np.random.default_rng(seed)
    w = np.zeros((n, n))
    for i in range(n):
        for j in ((i + 1) % n, int(rng.integers(n))):
            if i != j:
                w[i, j] = w[j, i] = rng.uniform(0.2, 1)
    d = w.sum(axis=1)
    h = np.eye(n) - w / np.sqrt(d[:, None] * d[None, :]) + np.diag(rng.uniform(0, 0.3, n))
    at = np.argwhere(h)
    df = spark.createDataFrame([(int(i) * 3, int(j) * 3, float(h[i, j])) for i, j in at], "src long, dst long, value double")
    return h, d, df.repartition(3)


def test_modes_equal_dense_ones(spark, block_entries=300):
    h, d, entries = ring(spark, 120, 2)
    want, u = np.linalg.eigh(h)
    values, vectors = smallest_modes(entries, 6, block_entries=block_entries)
    assert np.allclose(values, want[:6], atol=1e-9)
    got = np.array([r["u"] for r in sorted(vectors.collect(), key=lambda r: r["id"])])
    assert np.abs(got.T @ got - np.eye(6)).max() < 1e-8 and np.linalg.norm(h @ got - got * values, axis=0).max() < 1e-7
    assert np.abs(np.abs((got * u[:, :6]).sum(axis=0)) - 1).max() < 1e-6


def test_degenerate_and_small_operators(spark):
    blocks = [(i, j, 2.0 if i == j else -1.0) for b in range(5) for i in range(4 * b, 4 * b + 4) for j in range(4 * b, 4 * b + 4) if abs(i - j) < 2]
    df = spark.createDataFrame(blocks, "src long, dst long, value double")
    h = np.zeros((20, 20))
    for i, j, v in blocks:
        h[i, j] = v
    values, vectors = smallest_modes(df, 7)
    assert np.allclose(values, np.linalg.eigvalsh(h)[:7], atol=1e-8)
    one = spark.createDataFrame([(5, 5, 0.25)], "src long, dst long, value double")
    values, vectors = smallest_modes(one, 3)
    assert values == pytest.approx([0.25]) and abs(abs(vectors.first()["u"][0]) - 1) < 1e-12


def test_basis_finds_clustered_modes_in_few_products(spark, monkeypatch):
    """Each product shuffles the vectors of one block, no wider than the pairs; what is shuffled is gone when it is written."""
    from sparkorbit.operators import eigensolver

    kept = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: [b for b in kept.getAllBlocks().mkString(",").split(",") if b.startswith("shuffle_")]
    before, seen = set(files()), []
    monkeypatch.setattr(eigensolver, "_product", lambda *a, f=eigensolver._product: seen.append(set(files()) - before) or f(*a))
    n, rng = 160, np.random.default_rng(8)
    lam = np.concatenate([np.linspace(0.37, 0.4, 16), np.linspace(0.8, 2.4, n - 16)])  # more modes at the lower end than are asked for
    entries = spark.createDataFrame([(i, i, float(x)) for i, x in enumerate(rng.permutation(lam))], "src long, dst long, value double")
    values, vectors = smallest_modes(entries, 4, block_entries=80)
    assert np.allclose(values, lam[:4], atol=1e-9)
    got = np.array([r["u"] for r in vectors.collect()])
    assert np.abs(got.T @ got - np.eye(4)).max() < 1e-8
    assert len(seen) <= 45 and max(map(len, seen)) <= 20


def test_a_full_basis_starts_another(spark):
    h, d, entries = ring(spark, 120, 2)
    values, vectors = smallest_modes(entries, 6, basis=84)
    assert np.allclose(values, np.linalg.eigvalsh(h)[:6], atol=1e-9)
    got = np.array([r["u"] for r in sorted(vectors.collect(), key=lambda r: r["id"])])
    assert np.linalg.norm(h @ got - got * values, axis=0).max() < 1e-7


def test_residuals_of_all_modes_in_one_row(spark):
    h, d, entries = ring(spark, 40, 3)
    rng = np.random.default_rng(2)
    u, e = rng.normal(size=(40, 3)), [0.1, 0.7, 1.3]
    modes = spark.createDataFrame([(3 * i, x.tolist()) for i, x in enumerate(u)], "id long, u array<double>")
    eigen = spark.createDataFrame([(k + 1, x) for k, x in enumerate(e)], "k int, epsilon double")
    out = spectrum.residuals(entries, eigen, modes)
    assert out.columns == ["k", "residual"] and "Generate explode" not in (plan := out._jdf.queryExecution().executedPlan().toString()) and "posexplode" not in plan
    assert {r["k"]: r["residual"] for r in out.collect()} == pytest.approx(dict(enumerate(np.linalg.norm(h @ u - u * e, axis=0), 1)))


def test_solve_modes_beyond_the_driver(spark, monkeypatch):
    h, d, entries = ring(spark, 90, 5)
    degrees = spark.createDataFrame([(3 * i, float(x)) for i, x in enumerate(d)], "id long, degree double")
    near = spectrum.solve_modes(entries, 4, degrees)
    monkeypatch.setattr(spectrum, "MAX_LANDMARKS", 10)
    far = spectrum.solve_modes(entries, 4, degrees)
    e1, e2 = ({r["k"]: r["epsilon"] for r in x[0].collect()} for x in (near, far))
    assert e1.keys() == e2.keys() and all(abs(e1[k] - e2[k]) < 1e-9 for k in e1)
    m1, m2 = ({r["id"]: (r["u"], r["phi"]) for r in x[1].collect()} for x in (near, far))
    assert m1.keys() == m2.keys() and max(np.abs(np.array(m1[i]) - np.array(m2[i])).max() for i in m1) < 1e-6


def unit_states(spark, n, k, seed):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(n, k))
    a /= np.linalg.norm(a, axis=1)[:, None]
    y = (a[:, 0] ** 2 + 0.1 * rng.normal(size=n) > a[:, 1] ** 2).astype(int)
    w = rng.uniform(0.5, 2, n)
    df = spark.createDataFrame([(i, v.tolist(), int(c), float(x)) for i, (v, c, x) in enumerate(zip(a, y, w, strict=True))], "id long, a array<double>, y int, w double")
    return a, y, w, df


def test_gradient_of_spread_rows(spark):
    a, y, w, df = unit_states(spark, 900, 5, 3)
    b = np.random.default_rng(1).normal(size=(2, 2, 5))
    near = readout.penalized(b, readout.local_likelihood(a, y, w / w.sum()), 1e-3, 1e-3)
    for parts in (1, 7):
        far = readout.penalized(b, readout.spread_likelihood(df.repartition(parts), w.sum()), 1e-3, 1e-3)
        assert abs(near[0] - far[0]) < 1e-12 and np.abs(near[1] - far[1]).max() < 1e-12


def test_fit_of_any_number_of_rows(spark, monkeypatch):
    _, _, _, df = unit_states(spark, 400, 4, 5)
    near = readout.fit_states(df, restarts=1, steps=15)
    monkeypatch.setattr(readout, "MAX_ROWS", 50)
    far = readout.fit_states(df.repartition(3), restarts=1, steps=15)
    assert abs(near.loss - far.loss) < 1e-8 and np.abs(near.m - far.m).max() < 1e-6  # the same steps
    for bad in ("array(1D, null, 0D, 0D)", "array(1D)", "cast(null as array<double>)"):
        with pytest.raises(ValueError, match="one size"):
            readout.fit_states(df.withColumn("a", F.when(F.col("id") == 3, F.expr(bad)).otherwise(F.col("a"))))


@pytest.mark.parametrize("n", [1, 7, 20, 90, 500])
def test_hardest_rows_with_ties(spark, n):
    rows = [(i, (i * 7 % 5) / 4, int(i % 3 == 0)) for i in range(200)] + [(300 + i, 0.5, 0) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, score double, y int")
    want = sorted(r["id"] for r in readout.hard_examples(df, n, "id").collect())
    assert sorted(r["id"] for r in readout.hardest(df, n, "id").collect()) == want
