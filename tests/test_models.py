import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkorbit.operators import align, geometry, graph, readout, spectrum
from sparkorbit.operators.estimator import OrbitalClassifier
from sparkorbit.plans import proxies as px
from sparkorbit.plans.catalog import QUERIES
from sparkorbit.sources import tables
from sparkorbit.streaming.scoring import score_stream, windowed_rates


def test_modes_solve_the_operator(spark, sf, monkeypatch):
    p = px.points(spark, sf)
    edges, _ = graph.self_tuning_graph(p)
    lap = graph.laplacian(edges).persist()
    eigen, modes = spectrum.solve_modes(lap, 8, graph.degrees(edges))
    assert max(r["residual"] for r in spectrum.residuals(lap, eigen, modes).collect()) < 1e-8
    e = [r["epsilon"] for r in eigen.orderBy("k").collect()]
    assert abs(e[0]) < 1e-9 and e == sorted(e)
    monkeypatch.setattr(spectrum, "DENSE", 10)
    other, _ = spectrum.solve_modes(lap, 8, graph.degrees(edges))
    assert [r["epsilon"] for r in other.orderBy("k").collect()] == pytest.approx(e, abs=1e-6)


def test_graph_ignores_itself_and_ties(spark):
    rows = [(i, [float(i // 2), 0.0]) for i in range(10)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    near = graph.knn(df, df, 3, exclude_self=True).collect()
    assert all(r["src"] != r["dst"] for r in near) and len(near) == 30
    edges, scales = graph.self_tuning_graph(df, 3, 1)
    assert all(r["sigma"] > 0 for r in scales.collect())
    w = {(r["src"], r["dst"]): r["w"] for r in edges.collect()}
    assert all(w[b, a] == v for (a, b), v in w.items())
    with pytest.raises(ValueError):
        graph.self_tuning_graph(df.limit(2))


def test_readout_gradient_and_fit():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(140, 5))
    a /= np.linalg.norm(a, axis=1)[:, None]
    y = (a[:, 0] ** 2 > a[:, 1] ** 2).astype(int)
    r = readout.fit_readout(a, y)
    assert np.allclose(r.m.sum(axis=0), np.eye(5), atol=1e-6) and np.linalg.eigvalsh(r.m[1]).min() > -1e-8
    p = np.einsum("ni,ij,nj->n", a, r.m[1], a)
    assert ((p > 0.5) == y).mean() > 0.8
    b, w = rng.normal(size=(2, 3, 5)), np.full(140, 1 / 140)
    _, g = readout.loss_and_gradient(b, a, y, w, 1e-3, 1e-3)
    for i in rng.integers(0, 30, 8):
        d = np.zeros(30)
        d[i] = 1e-6
        hi, lo = (readout.loss_and_gradient((b.ravel() + s * d).reshape(b.shape), a, y, w, 1e-3, 1e-3)[0] for s in (1, -1))
        assert g[i] == pytest.approx((hi - lo) / 2e-6, abs=1e-6)
    f = lambda x: (float((x**4).sum() + x @ x), 4 * x**3 + 2 * x)
    x, v = readout.lbfgs(f, np.ones(6))
    assert v < 1e-10 and np.abs(x).max() < 1e-4


def test_classifier_on_separable_points(spark):
    rng = np.random.default_rng(8)
    y = rng.integers(0, 2, 400)
    x = rng.normal(size=(400, 4)) + 4 * y[:, None]
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y, strict=True))], "id long, x array<double>, y int")
    model = OrbitalClassifier(modes=6, betas=(1.0,)).fit(df)
    got = {r["id"]: r["p"] for r in model.predict_proba(df).collect()}
    assert len(got) == 400 and np.mean([(got[i] > 0.5) == y[i] for i in range(400)]) > 0.95


def test_geometry(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 6))
    y = (x[:, 0] + x[:, 1] > 0.2).astype(float)
    g = geometry.fit_geometry(x, y, np.arange(600), (32, 8), epochs=80, rate=3e-3)
    assert g.loss < 0.5 and g.embed(x).shape == (600, 8)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:20])], "id long, x array<double>")
    rows = g.transform(df, "x").orderBy("id").collect()
    assert np.allclose([r["embedding"] for r in rows], g.embed(x[:20]))


def test_eigen_residual_and_bands(spark, sf):
    assert max(r["residual"] for r in QUERIES["eigen_residual"](spark, sf).collect()) < 1e-6
    for r in QUERIES["clopper_pearson_bands"](spark, sf).collect():
        assert 0 <= r["low"] < r["high"] <= 1


def test_alignment_refuses(spark):
    a = spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "source_row long, event_number long, y int")
    b = a.withColumn("score", F.lit(0.4))
    assert align.align_predictions(a, b, "score", "p").count() == 2
    for bad in (b.union(b), b.limit(1), b.withColumn("score", F.lit(1.4))):
        with pytest.raises(align.AlignmentError):
            align.align_predictions(a, bad, "score", "p")


def test_sources(spark, tmp_path):
    path = str(tmp_path / "h.csv")
    with open(path, "w") as f:
        f.write("EventId,Label,DER_a,PRI_b,Weight\n1,s,2.5,x,1\n2,b,-999,,1\n")
    df = tables.read_header_csv(spark, path, "Label")
    assert df.columns == ["Label", "DER_a", "y"] and sorted(r["y"] for r in df.collect()) == [0, 1]
    path = str(tmp_path / "w.csv")
    with open(path, "w") as f:
        f.write("id,f_1,f_0\n1,2,1\n2,2,1\n3,5,5\n")
    wide = tables.read_wide_csv(spark, path).collect()
    assert sorted(r["x"] for r in wide) == [[1.0, 2.0], [1.0, 2.0], [5.0, 5.0]] and len({r["group_id"] for r in wide}) == 2
    with pytest.raises(tables.SchemaError):
        tables.check_schema(df, ["nope"])
    tables.write_table(df, str(tmp_path / "out"), "csv")
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 2
    tables.write_json({"a": np.float64("nan"), "b": [np.int64(3)]}, str(tmp_path / "x.json"))
    assert (tmp_path / "x.json").read_text() == '{\n "a": null,\n "b": [\n  3\n ]\n}'


def test_streaming_equals_batch(spark, tmp_path):
    rows = [(f"2024-01-01 00:0{i % 6}:00", [0.6, 0.8] if i % 2 else [1.0, 0.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "ts string, s array<double>").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    m = np.array([[0.2, 0.1], [0.1, 0.9]])
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    rates = windowed_rates(score_stream(stream, "s", m), "ts", "2 minutes", "1 minute", "p", 0.5)
    q = rates.writeStream.outputMode("complete").format("memory").queryName("rates").start()
    q.processAllAvailable()
    q.stop()
    got = {str(r["start"]): (r["n"], r["rate"]) for r in spark.table("rates").collect()}
    want = {str(r["start"]): (r["n"], r["rate"]) for r in windowed_rates(score_stream(df, "s", m), "ts", "2 minutes", "1 minute", "p", 0.5).collect()}
    assert got == want and sum(n for n, _ in got.values()) == 30


def test_track_encoder(spark):
    from sparkorbit.operators.encoder import TrackEncoder

    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 500).astype(float)
    tracks = [rng.normal(size=(rng.integers(0, 6), 3)) for _ in y]
    for t, c in zip(tracks, y, strict=True):
        if len(t) and c:
            t[0, 0] += 4
    ctx = rng.normal(size=(500, 2))
    enc = TrackEncoder(epochs=3).fit(tracks, ctx, y, np.arange(500))
    x, b = enc._flat(tracks[:20], 3)
    grad = enc._gradient(x, b, ctx[:20], y[:20])

    def loss():
        p = np.clip(enc._forward(x, b, ctx[:20])["p"], 1e-12, 1 - 1e-12)
        return -(y[:20] * np.log(p) + (1 - y[:20]) * np.log(1 - p)).mean()

    for name, g in grad.items():
        at = tuple(0 for _ in g.shape)
        old = enc.w[name][at]
        enc.w[name][at] = old + 1e-6
        hi = loss()
        enc.w[name][at] = old - 1e-6
        lo = loss()
        enc.w[name][at] = old
        assert g[at] == pytest.approx((hi - lo) / 2e-6, abs=1e-6), name
    enc = TrackEncoder(epochs=60, rate=1e-2).fit(tracks, ctx, y, np.arange(500))
    some = np.array([len(t) > 0 for t in tracks])
    assert ((enc.predict(tracks, ctx) > 0.5) == y)[some].mean() > 0.9
    df = spark.createDataFrame([(i, t.tolist(), c.tolist()) for i, (t, c) in enumerate(zip(tracks[:9], ctx[:9], strict=True))], "id long, tracks array<array<double>>, ctx array<double>")
    rows = enc.transform(df, "tracks", "ctx").orderBy("id").collect()
    assert np.allclose([r["embedding"] for r in rows], enc.embed(tracks[:9], ctx[:9]))


def test_baselines(spark):
    from sparkorbit.operators.baselines import logistic_scores, risk_audit

    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 300)
    x = rng.normal(size=(300, 4)) + 2 * y[:, None]
    df = spark.createDataFrame([(i, v.tolist(), v[:1].tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y, strict=True))], "id long, x array<double>, s array<double>, y int")
    for k in (0, 2):
        got = logistic_scores(df, df, components=k).collect()
        assert np.mean([(r["score"] > 0.5) == r["y"] for r in got]) > 0.9
    row = risk_audit(df, df, "x", "s").first()
    assert row["difference"] > 0 and row["upper"] > row["difference"]


@pytest.mark.parametrize("shift", [0.0, 1e7])
def test_neighbours_are_exact_among_copies_and_far_from_the_origin(spark, shift):
    rng = np.random.default_rng(5)
    family = np.tile(rng.normal(0, 1, 6), (60, 1))
    x = np.concatenate([family, rng.normal(0, 1, (40, 6)) * (1.0 if shift == 0 else 1e-2)]) + shift
    ids = rng.permutation(len(x))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = {}
    for r in graph.knn(df, df, 8, exclude_self=True).collect():
        got.setdefault(r["src"], []).append((r["rank"], r["dst"]))
    for i, v in zip(ids, x, strict=True):
        d2 = ((v - x) ** 2).sum(axis=1)
        want = [int(ids[j]) for j in np.lexsort((ids, d2)) if ids[j] != i][:8]
        assert [d for _, d in sorted(got[int(i)])] == want
