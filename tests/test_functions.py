import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkorbit.functions import scalars as sc
from sparkorbit.functions.intervals import beta_cdf, clopper_pearson, paired_binomial
from sparkorbit.operators import bootstrap, evaluate, features, roles
from sparkorbit.functions.prefix import quantiles, running_sums


def splitmix(x, seed):
    m = (1 << 64) - 1
    z = (x + seed + 0x9E3779B97F4A7C15) & m
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & m
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & m
    return z ^ (z >> 31)


def test_splitmix_wraps_like_64_bits(spark):
    ids = [0, 1, 7, 10**12, 2**62 + 5, 2**63 - 1]
    df = spark.createDataFrame([(i,) for i in ids], "x long")
    rows = df.select("x", sc.splitmix64(F.col("x"), 3).alias("h"), sc.unsigned_mod(sc.splitmix64(F.col("x"), 3), 10_000).alias("m")).collect()
    for r in rows:
        h = splitmix(r["x"], 3)
        assert r["h"] % (1 << 64) == h and r["m"] == h % 10_000


def test_intervals():
    assert clopper_pearson(0, 10) == (0.0, pytest.approx(1 - 0.15865 ** 0.1, abs=1e-4))
    assert clopper_pearson(10, 10)[1] == 1.0 and clopper_pearson(0, 0) == (0.0, 1.0)
    low, high = clopper_pearson(3, 20, 0.95)
    assert (low, high) == (pytest.approx(0.0320709, abs=1e-6), pytest.approx(0.3789268, abs=1e-6))
    k, n, p = 4, 9, 0.37
    tail = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))
    assert beta_cdf(k, n - k + 1, p) == pytest.approx(tail, rel=1e-12)
    assert paired_binomial(0, 0) == 1.0 and paired_binomial(1, 7) == pytest.approx(2 * 9 / 256)


def test_sentinels_and_scores(spark):
    df = spark.createDataFrame([(-999.0, 1.0, 1.0), (-999.005, 0.0, 0.0), (-998.9, 3.0, 1.0), (float("inf"), 1.0, 0.0), (None, 0.0, 2.0)], "x double, b double, u double")
    rows = df.select(sc.clean_sentinel(F.col("x")).alias("c"), sc.binary_score(F.col("b"), F.col("u")).alias("s"), sc.finite_ratio(F.col("b"), F.col("u")).alias("r")).collect()
    assert [r["c"] for r in rows] == [None, None, -998.9, None, None]
    assert [r["s"] for r in rows] == [0.5, 0.5, 0.75, 1.0, 0.0]
    assert [r["r"] for r in rows] == [1.0, None, 3.0, None, 0.0]


def test_running_sums_do_not_depend_on_ranges(spark):
    rng = np.random.default_rng(0)
    rows = [(str(g), float(v), 1) for g, v in zip(rng.integers(0, 2, 300), rng.integers(0, 40, 300), strict=True)]
    df = spark.createDataFrame(rows, "g string, v double, n int").groupBy("g", "v").agg(F.sum("n").alias("n"))
    a = {(r["g"], r["v"]): r["c"] for r in running_sums(df, "v", {"c": "n"}, ("g",)).collect()}
    b = {(r["g"], r["v"]): r["c"] for r in running_sums(df, "v", {"c": "n"}, ("g",), ranges=1).collect()}
    want = {(g, v): sum(1 for h, x, _ in rows if h == g and x <= v) for g, v, _ in rows}
    assert a == b == want


def test_metrics_by_hand(spark):
    rows = [("m", 1, s) for s in (0.9, 0.8, 0.7, 0.4)] + [("m", 0, s) for s in (0.6, 0.4, 0.3, 0.1)] + [("one", 1, 0.5)]
    df = spark.createDataFrame(rows, "method string, y int, score double")
    auc = {r["method"]: r["auc"] for r in evaluate.roc_auc(df).collect()}
    assert auc == {"m": pytest.approx(14.5 / 16), "one": None}
    w = {r["efficiency"]: r for r in evaluate.working_points(df.where("method = 'm'"), [0.75, 1.0]).collect()}
    assert w[0.75]["mistags"] == 0 and w[0.75]["censored"] and w[0.75]["rejection"] is None
    assert w[1.0]["selected"] == 4 and w[1.0]["rejection"] == 2.0


def test_feature_maps(spark):
    df = spark.createDataFrame([(float(i), -999.0 if i % 5 == 0 else float(i * i), 3.0) for i in range(50)], "a double, b double, c double")
    out = features.RobustMap(["a", "c"]).fit(df).transform(df)
    q = np.quantile(np.arange(50), [0.1, 0.5, 0.9])
    assert [r["a"] for r in out.orderBy("a").collect()] == pytest.approx(((np.arange(50) - q[1]) / (q[2] - q[0])).tolist())
    assert {r["c"] for r in out.collect()} == {0.0}
    m = features.ImputeMap(["a", "b"]).fit(df)
    assert m.flagged == ["b"] and m.transform(df).where("b_missing = 1").count() == 10
    with pytest.raises(ValueError):
        m.robust.transform(df.drop("a"))


def test_samples_are_stable(spark):
    df = spark.range(500).select(F.col("id").alias("source_row"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    a = {r[0] for r in roles.balanced_sample(df, 60, "source_row", seed=1).select("source_row").collect()}
    b = {r[0] for r in roles.balanced_sample(df.repartition(7), 60, "source_row", seed=1).select("source_row").collect()}
    assert a == b and len(a) == 60 and sum(x % 3 == 0 for x in a) == 30
    with pytest.raises(ValueError):
        roles.balanced_sample(df, 7, "source_row")
    with pytest.raises(ValueError):
        roles.balanced_sample(df, 400, "source_row")


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [("ab"[k % 2], float(v)) for k, v in enumerate(rng.integers(0, 30, 201))] + [("a", None), ("c", 4.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = [0.0, 0.1, 0.5, 0.841, 1.0]
    for r in quantiles(df, "v", shares, ("g",)).collect():
        mine = [v for g, v in rows if g == r["g"] and v is not None]
        assert r["n"] == len(mine) and r["q"] == pytest.approx(np.quantile(mine, shares).tolist())
    assert quantiles(df, "v", [0.5]).first()["q"] == [float(np.median([v for _, v in rows if v is not None]))]
    assert quantiles(df.limit(0), "v", [0.5], ("g",)).collect() == [] and quantiles(df.limit(0), "v", [0.5]).first()["n"] is None


def test_scores_without_a_place_are_refused(spark):
    for bad in (None, float("nan"), float("inf")):
        df = spark.createDataFrame([("m", 1, 0.5), ("m", 0, bad)], "method string, y int, score double")
        for f in (evaluate.roc_auc, evaluate.average_precision, evaluate.roc_table):
            with pytest.raises(Exception, match="null or not finite"):
                f(df).collect()
        assert evaluate.score_validity(df).first()["n_invalid"] == 1


def test_bands_hold_the_binomial_tails(spark):
    rng = np.random.default_rng(1)
    rows = [("m", int(y), float(round(v + 0.3 * y, 1))) for y, v in zip(rng.integers(0, 2, 60), rng.random(60), strict=True)]
    got = evaluate.roc_bands(spark.createDataFrame(rows, "method string, y int, score double")).collect()
    n1 = sum(y for _, y, _ in rows)
    tail = lambda k, n, p, low: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in (range(k, n + 1) if low else range(k + 1)))
    for r in got:
        for k, n, a, b in ((r["tp"], n1, r["tpr_low"], r["tpr_high"]), (r["fp"], 60 - n1, r["fpr_low"], r["fpr_high"])):
            assert a == 0.0 if k == 0 else tail(k, n, a, True) == pytest.approx(0.16, abs=1e-6)
            assert b == 1.0 if k == n else tail(k, n, b, False) == pytest.approx(0.16, abs=1e-6)
        assert r["rejection_low"] == pytest.approx(1 / r["fpr_high"])
        assert r["rejection_high"] is None if r["fp"] == 0 else r["rejection_high"] == pytest.approx(1 / r["fpr_low"])


def test_bootstrap_draws(spark):
    rows = [("m", k, k // 3, int(k % 30 == 0), k / 90) for k in range(90)]
    df = spark.createDataFrame(rows, "method string, source_row long, event_number long, y int, score double")
    drawn = bootstrap.drawn_rows(df, 40, "event_number").groupBy("replicate").agg(F.sum("w").alias("n"), F.max("y").alias("one"), F.min("y").alias("zero")).collect()
    assert sorted(r["replicate"] for r in drawn) == list(range(40))  # 30 events, three with signal: some are drawn again
    assert all(r["n"] == 90 and r["one"] == 1 and r["zero"] == 0 for r in drawn)
    with pytest.raises(ValueError):
        bootstrap.drawn_rows(df.where("y = 0"), 3, "event_number", attempts=2)
    assert bootstrap.class_sizes({0: 90, 1: 10}, 20) == {0: 18, 1: 2} and bootstrap.class_sizes({0: 99, 1: 1}, 10) == {0: 9, 1: 1}
    one = bootstrap.stratified_bootstrap(df, 5, most=30).collect()
    assert len(one) == 5 and all(0 <= r["auc"] <= 1 for r in one)
    with pytest.raises(ValueError):
        bootstrap.class_sizes({0: 5, 1: 0})


def test_screening_measurement(spark):
    from sparkorbit.operators import dimension

    rng = np.random.default_rng(4)
    a = rng.normal(size=(40, 3))
    y = rng.integers(0, 2, 40)
    state = spark.createDataFrame([(i, k + 1, float(a[i, k])) for i in range(40) for k in range(3)], "id long, k int, a double")
    m = np.array(dimension.screening_measurement(state, spark.createDataFrame([(i, int(c)) for i, c in enumerate(y)], "id long, y int"), 3))
    e = np.array([a[y == c].T @ a[y == c] / (y == c).sum() + 5e-4 * np.eye(3) for c in (0, 1)])
    value, vector = np.linalg.eigh(e.sum(axis=0))
    t = vector @ np.diag(value**-0.5) @ vector.T
    assert np.allclose(m, t @ e @ t) and np.allclose(m.sum(axis=0), np.eye(3))


def test_column_quantiles_count_only_what_is_near(spark, monkeypatch):
    """Exact quantiles by sketch and brackets, with ties, gaps and missing values, and of brackets that miss."""
    from sparkorbit.operators import features

    rng = np.random.default_rng(8)
    n = 9000
    x = {"a": rng.normal(size=n), "ties": rng.integers(0, 3, n).astype(float), "few": np.where(np.arange(n) % 900 == 0, rng.normal(size=n), np.nan), "none": np.full(n, np.inf), "sorted": np.arange(n) / 7.0}
    df = spark.createDataFrame([tuple(float(v[i]) for v in x.values()) for i in range(n)], ", ".join(f"{c} double" for c in x)).repartition(3)
    shares = [0.0, 0.1, 0.5, 0.9, 1.0]
    want = {c: np.quantile(v[np.isfinite(v)], shares) if np.isfinite(v).any() else np.zeros(5) for c, v in x.items()}
    monkeypatch.setattr(features, "BUFFER_ROWS", 500)
    monkeypatch.setattr(features, "STEP", 4)
    for slack in (0.05, 1e-9):
        monkeypatch.setattr(features, "SLACK", slack)
        counts = {}
        got = features.column_quantiles(df, {c: F.col(c) for c in x}, shares, counts)
        assert counts == {c: int(np.isfinite(v).sum()) for c, v in x.items()}
        assert all(np.allclose(got[c], want[c], rtol=0, atol=1e-12) for c in x)
    near = features._bracketed(df.select("a"), [(0, -0.01, 0.01)]).count()
    assert near < n / 50  # the other values are only counted
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "65535"


def test_imputed_map_is_fitted_in_two_passes(spark, monkeypatch):
    """Medians and the quantiles of the filled columns are found together, as if the columns had been filled first."""
    from sparkorbit.operators import features

    rng = np.random.default_rng(9)
    x = {"whole": rng.normal(size=3001), "gaps": np.where(rng.random(3001) < 0.35, -999.0, rng.normal(size=3001)), "most": np.where(rng.random(3001) < 0.97, np.nan, rng.integers(0, 9, 3001)), "ties": np.where(rng.random(3001) < 0.3, -999.0, rng.integers(0, 3, 3001)), "none": np.full(3001, np.nan)}
    df = spark.createDataFrame([tuple(float(v[i]) for v in x.values()) for i in range(3001)], ", ".join(f"{c} double" for c in x)).repartition(3)
    passes = []
    monkeypatch.setattr(features, "BUFFER_ROWS", 500)
    monkeypatch.setattr(features, "STEP", 4)
    for name in ("_sketch", "_bracketed"):
        monkeypatch.setattr(features, name, lambda *a, f=getattr(features, name): passes.append(1) or f(*a))
    for slack, most in ((0.08, 2), (0.0, 3)):
        passes.clear()
        monkeypatch.setattr(features, "SLACK", slack)
        fitted = features.ImputeMap(list(x), scale_flags=True).fit(df)
        assert len(passes) <= most
        assert fitted.flagged == ["gaps", "most", "ties", "none"]
        for c, v in x.items():
            known = np.isfinite(v) & (v != -999.0)
            median = np.median(v[known]) if known.any() else 0.0
            low, middle, high = np.quantile(np.where(known, v, median), [0.1, 0.5, 0.9])
            assert fitted.medians[c] == pytest.approx(median, abs=1e-12)
            assert fitted.robust.params[c] == pytest.approx((middle, high - low if high > low else 1.0), abs=1e-12)
            if c in fitted.flagged:
                low, middle, high = np.quantile((~known).astype(float), [0.1, 0.5, 0.9])
                assert fitted.robust.params[f"{c}_missing"] == pytest.approx((middle, high - low if high > low else 1.0), abs=1e-12)


def test_node_inputs_take_one_shuffle_and_keep_nulls(spark):
    from sparkorbit.operators import tracks as tk

    rows = [(1, 1, 0.5, 1.0), (1, 2, None, 2.0), (1, 3, 2.5, 4.0), (2, 1, 7.0, 0.0)]
    df = spark.createDataFrame(rows, "jet long, slot int, f double, c double")
    out = tk.node_inputs(df, "jet", "slot", ["f"], "graph", ["c"], 2)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 1
    got = {(r["jet"], r["slot"]): r["x"] for r in out.collect()}
    w = {(i, j): math.exp(-0.5 * (a - b) ** 2) for i, a in ((1, 1.0), (2, 2.0), (3, 4.0)) for j, b in ((1, 1.0), (2, 2.0), (3, 4.0)) if i != j}
    one, two, three = w[1, 3] / (w[1, 2] + w[1, 3]) * 2.5, (w[2, 1] * 0.5 + w[2, 3] * 2.5) / (w[2, 1] + w[2, 3]), w[3, 1] / (w[3, 1] + w[3, 2]) * 0.5
    assert got[1, 1] == pytest.approx([0.5, one, 0.5 - one, 0.5 * one]) and got[1, 3] == pytest.approx([2.5, three, 2.5 - three, 2.5 * three])
    assert got[1, 2] == [None, pytest.approx(two), None, None] and got[2, 1] == [7.0, 0.0, 7.0, 0.0]


def test_parallel_messages_equal_the_joins_in_one_shuffle(spark, monkeypatch):
    """Also of null values and coordinates, of a track alone in its jet, and of jets dealt over several blocks of pairs."""
    from sparkorbit.operators import tracks as tk

    rng = np.random.default_rng(3)
    maybe = lambda v: None if rng.random() < 0.15 else float(v)
    rows = [(j, s, maybe(rng.normal()), maybe(rng.normal()), float(rng.normal())) for j in range(40) for s in range(1, 2 + j % 6)]
    rows += [(90, 1, None, 0.0, 0.0), (90, 2, None, 1.0, 0.0), (91, 1, 1.0, math.nan, 0.0), (91, 2, 2.0, 0.0, 0.0), (91, 3, math.nan, 0.0, 0.0), (None, 1, 1.0, 0.0, 0.0), (None, 2, 1.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "jet long, slot int, s double, a double, b double")
    joined = tk.messages(tk.parallel_adjacency(tk.relations(df, "jet", "slot", ["a", "b"]), "jet", 1.5), df, "jet", "slot", "s", 2)
    want = {(r["jet"], r["slot"], r["step"]): r["s"] for r in joined.collect()}
    for pairs in (tk.PAIRS, 7):
        monkeypatch.setattr(tk, "PAIRS", pairs)
        out = tk.parallel_messages(df, "jet", "slot", ["a", "b"], "s", 1.5, 2)
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 1
        got = out.collect()
        assert len(got) == len(want) and want[90, 1, 1] is None and not any(r["jet"] is None for r in got)
        for r in got:
            w = want[r["jet"], r["slot"], r["step"]]
            assert r["s"] is None if w is None else r["s"] == pytest.approx(w, abs=1e-12, nan_ok=True)


def test_shift_of_scores_reads_its_rows_once(spark):
    from sparkorbit.operators import evaluate
    from sparkorbit.operators import tracks as tk

    rng = np.random.default_rng(5)
    a, b = rng.random(500), rng.random(500)
    rows = [(i, float(x), None if i % 50 == 0 else float(y)) for i, (x, y) in enumerate(zip(a, b, strict=True))]
    df = spark.createDataFrame(rows, "jet long, before double, after double")
    d = np.abs(a - b)[np.arange(500) % 50 != 0]
    r = evaluate.score_shift(df).collect()
    assert len(r) == 1 and r[0]["n"] == len(d) and r[0]["p95_shift"] == pytest.approx(np.quantile(d, 0.95), abs=1e-12) and r[0]["mean_shift"] == pytest.approx(d.mean())
    # tracks are kept by the same hash as SplitMix64 of the jet and the place
    t = spark.createDataFrame([(j, [{"s": float(k)} for k in range(j % 9)]) for j in [*range(60), -5, 1 << 40]], "jet long, tracks array<struct<s: double>>").withColumn("tracks", F.when(F.col("jet") != 3, F.col("tracks")))
    place = F.transform("tracks", lambda x, i: F.struct(x.alias("t"), sc.unsigned_mod(sc.splitmix64(F.col("jet") * 1000 + i, 5), 10_000).alias("h")))
    kept = F.transform(F.filter(place, lambda x: x["h"] < 7000), lambda x: x["t"])
    want = F.when(F.size(kept) > 0, kept).otherwise(F.slice("tracks", 1, 1))
    for r in t.select("jet", tk.dropout(F.col("tracks"), F.col("jet"), 0.7, 5).alias("got"), want.alias("want")).collect():
        assert r["got"] == r["want"], r
