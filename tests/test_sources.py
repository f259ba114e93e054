import hashlib
import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkorbit.functions import plain
from sparkorbit.functions.stored import release, shared_dir, stored
from sparkorbit.operators import align, features, readout, roles
from sparkorbit.operators import tracks as tk
from sparkorbit.operators.estimator import OrbitalClassifier
from sparkorbit.plans import proxies as px
from sparkorbit.sources import artifacts, guards, tables
from sparkorbit.sources import jets as scan


def write(path, text):
    path.write_text(text)
    return str(path)


def test_susy_rows_in_file_order(spark, tmp_path):
    rows = [[k % 2, *(k + j / 10 for j in range(18))] for k in range(40)]
    path = write(tmp_path / "susy.csv", "\n".join(",".join(map(str, r)) for r in rows) + "\n")
    got = tables.read_susy(spark, path, 10).orderBy("source_row").collect()
    assert [r["source_row"] for r in got] == list(range(10)) and [r["lep1_pt"] for r in got] == [float(k) for k in range(10)]
    assert tables.read_dataset(spark, "susy", path).count() == 40
    with pytest.raises(tables.SchemaError):
        tables.read_susy(spark, path, 1)
    with pytest.raises(ValueError):
        tables.read_dataset(spark, "none", path)
    wide = write(tmp_path / "wide.csv", "1,2,3\n")
    with pytest.raises(Exception):
        tables.read_susy(spark, wide).collect()


def test_samples_keep_classes_and_groups(spark, tmp_path):
    path = write(tmp_path / "h.csv", "EventId,Label,DER_a\n" + "".join(f"{k},{'s' if k % 4 == 0 else 'b'},{k}\n" for k in range(80)))
    got = [r["y"] for r in tables.read_dataset(spark, "higgs", path, sample=20).collect()]
    assert len(got) == 20 and sum(got) == 5
    path = write(tmp_path / "d.csv", "image_path,label,f_0001,f_0000\n" + "".join(f"p{k},{k // 2 % 2},{k // 2},1\n" for k in range(60)))
    got = tables.read_dataset(spark, "densenet", path, sample=20)
    groups = {r["group_id"]: r["n"] for r in got.groupBy("group_id").agg(F.count("*").alias("n")).collect()}
    assert set(groups.values()) == {2} and len(groups) == 10
    mixed = write(tmp_path / "m.csv", "label,f_0\n0,1\n1,1\n0,2\n")
    with pytest.raises(tables.SchemaError):
        tables.read_dataset(spark, "densenet", mixed)


def test_locked_predictions(spark, tmp_path):
    good = write(tmp_path / "p.csv", "source_row,y,score\n1,0,0.2\n2,1,0.8\n")
    assert tables.read_predictions(spark, good, ["score"]).count() == 2
    for text in ("source_row,y,score\n1,0,0.2\n1,1,0.8\n", "source_row,y,score\n1,0,0.2\n2,0,0.8\n", "source_row,score\n1,0.2\n"):
        with pytest.raises(tables.SchemaError):
            tables.read_predictions(spark, write(tmp_path / "q.csv", text), ["score"])


def test_digests_and_file_checks(spark, tmp_path):
    path = write(tmp_path / "a.bin", "some content")
    assert guards.file_sha256(path) == hashlib.sha256(b"some content").hexdigest()
    adler = f"{zlib.adler32(b'some content'):08x}"
    assert guards.check_file(path, 12, adler)["size"] == 12
    for size, digest in ((11, adler), (12, "00000000")):
        with pytest.raises(guards.GuardError):
            guards.check_file(path, size, digest)
    with pytest.raises(guards.GuardError):
        guards.check_published(path)
    (tmp_path / "src").mkdir()
    write(tmp_path / "src" / "x.py", "1")
    before = guards.tree_sha256(tmp_path / "src")
    write(tmp_path / "src" / "x.py", "2")
    assert guards.tree_sha256(tmp_path / "src") != before
    assert guards.index_sha256([1, 2]) == hashlib.sha256(np.array([1, 2], "<i8").tobytes()).hexdigest()
    one, two = (spark.range(10).repartition(k).selectExpr("id", "id * 2 as x") for k in (1, 4))
    assert guards.digest_of(one) == guards.digest_of(two) != guards.digest_of(one.limit(9))


def test_input_discovery(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    first = write(tmp_path / "a" / "m.json", "{}")
    assert str(guards.resolve_input(first, [], "m.json")) == first
    write(tmp_path / "b" / "m.json", "{}")
    assert guards.resolve_input(None, [str(tmp_path)], "m.json").name == "m.json"
    write(tmp_path / "b" / "m.json", "{1}")
    with pytest.raises(guards.GuardError):
        guards.resolve_input(None, [str(tmp_path)], "m.json")
    with pytest.raises(FileNotFoundError):
        guards.resolve_input(None, [str(tmp_path)], "none.json")


def test_a_test_is_scored_once(spark, tmp_path):
    path = tmp_path / "status.json"
    guards.freeze_context(path, {"tree": "a", "size": 3})
    with pytest.raises(guards.GuardError, match="tree"):
        guards.score_once(path, {"tree": "b", "size": 3})
    guards.score_once(path, {"tree": "a", "size": 3})
    with pytest.raises(guards.GuardError, match="already"):
        guards.score_once(path, {"tree": "a", "size": 3})
    with pytest.raises(guards.GuardError):
        guards.freeze_context(path, {})


def test_cached_scores(spark, tmp_path):
    keys = spark.range(5).withColumnRenamed("id", "source_row")
    calls, shift = [], [0.0]

    def score():
        calls.append(1)
        return keys.withColumn("p", F.col("source_row") / 10 + F.lit(shift[0]))

    path = str(tmp_path / "scores")
    for check, n in ((False, 1), (False, 1), (True, 2)):
        assert guards.cached_scores(spark, path, "m", keys, score, check=check).count() == 5 and len(calls) == n
    shift[0] = 1e-3
    with pytest.raises(guards.GuardError, match="differ"):
        guards.cached_scores(spark, path, "m", keys, score, check=True)
    for model, rows in (("other", keys), ("m", keys.limit(4))):
        with pytest.raises(guards.GuardError):
            guards.cached_scores(spark, path, model, rows, score)


def test_manifest():
    good = {"inputs": {"fields": 19, "context_fields": 4, "tracks": 20}, "roles": {"train": 5}, "test_used_for_selection": False, "training": {"completed": 3, "requested": 3, "whole": True}}
    assert guards.check_manifest(good, 19, 4, 20, {"train": 5}) == good
    for change in ({"roles": {}}, {"test_used_for_selection": True}, {"training": {"completed": 0, "requested": 3}}, {"training": {"completed": 2, "requested": 3, "whole": True}}, {"inputs": {}}):
        with pytest.raises(guards.GuardError):
            guards.check_manifest(good | change, 19, 4, 20, {"train": 5})
    held = guards.environment()
    assert held["pyspark"] and held["python"] and "h5py" in held


def test_frozen_split(spark, tmp_path):
    residue = {"base": 1, "operator_validation": 6, "derivative_gate": 8, "wp_validation": 18, "independent_test": 9}
    rows = [(k, residue[list(residue)[k % 5]] + 100 * (k // 5), list(residue)[k % 5], "encoder_train" if k % 5 == 0 and k < 10 else None) for k in range(50)]
    schema = "source_row long, event_number long, role string, part string"
    path = str(tmp_path / "split")
    artifacts.write_split(spark.createDataFrame(rows, schema), path)
    assert artifacts.read_split(spark, path).count() == 50
    bad = [
        [*rows, rows[0]],
        [(50, 7, "base", None), *rows],
        [(50, 1, "wp_validation", None), *rows],
        [(50, 209, "independent_test", "encoder_train"), *rows],
        [(50, 209, "other", None), *rows],
    ]
    for b in bad:
        artifacts.write_split(spark.createDataFrame(b, schema), path)
        with pytest.raises(tables.SchemaError):
            artifacts.read_split(spark, path)
    arrays = {n: np.array([k for k in range(50) if k % 5 == j]) for j, n in enumerate(residue)}
    sampled = {"sampled_source_rows": np.arange(50) * 3, "sampled_event_numbers": np.array([r[1] for r in rows])}
    np.savez(tmp_path / "s.npz", **sampled, **arrays)
    got = {(r["source_row"], r["event_number"], r["role"]) for r in artifacts.read_split_arrays(spark, str(tmp_path / "s.npz")).collect()}
    assert got == {(3 * k, e, r) for k, e, r, _ in rows}
    for change in ({"base": np.array([0, 60])}, {"base": np.array([0])}, {"sampled_source_rows": np.arange(50)[::-1]}):
        np.savez(tmp_path / "t.npz", **(sampled | arrays | change))
        with pytest.raises(tables.SchemaError):
            artifacts.read_split_arrays(spark, str(tmp_path / "t.npz"))


def test_states_are_aligned_strictly(spark):
    rows = spark.createDataFrame([(k, k, k % 2) for k in range(4)], "source_row long, event_number long, y int")
    states = rows.selectExpr("*", "source_row / 2 as phi_2", "1.5D as phi_10", "0.5D as phi_1")
    out = artifacts.align_states(rows, states)
    assert out.columns == [*align.KEYS, "orbital_1", "orbital_2", "orbital_3"] and {r["orbital_3"] for r in out.collect()} == {1.5}
    for bad in (states.limit(3), states.limit(3).union(states.limit(1)), states.withColumn("phi_1", F.lit(float("nan")))):
        with pytest.raises(align.AlignmentError):
            artifacts.align_states(rows, bad)
    with pytest.raises(align.AlignmentError):
        artifacts.with_features(rows.union(rows), states, "source_row")
    with pytest.raises(align.AlignmentError):
        artifacts.with_features(rows, states.limit(2).drop("event_number", "y"), complete=True)


def test_fitted_objects_come_back(spark, tmp_path):
    rng = np.random.default_rng(8)
    y = rng.integers(0, 2, 300)
    x = rng.normal(size=(300, 4)) + 4 * y[:, None]
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y, strict=True))], "id long, x array<double>, y int")
    model = OrbitalClassifier(modes=6, betas=(0.5, 1.0)).fit(df)
    assert [c["beta"] for c in model.candidates] == [0.5, 1.0]
    artifacts.save_classifier(model, str(tmp_path / "model"))
    again = artifacts.load_classifier(spark, str(tmp_path / "model"))
    a, b = ({r["id"]: r["p"] for r in m.predict_proba(df).collect()} for m in (model, again))
    assert a == pytest.approx(b)
    t = spark.createDataFrame([(float(k), None if k % 3 else float(k * k)) for k in range(30)], "a double, b double")
    for kind in ("robust", "standard", "impute"):
        fitted = features.make_map(kind, ["a", "b"]).fit(t)
        features.save_map(fitted, str(tmp_path / "map.json"))
        back = features.load_map(str(tmp_path / "map.json"))
        assert sorted(map(str, back.transform(t).collect())) == sorted(map(str, fitted.transform(t).collect()))
    with pytest.raises(ValueError):
        features.make_map("none", [])


def test_exported_tables(spark, tmp_path):
    from sparkorbit.operators import graph, spectrum

    p = spark.createDataFrame([(i, [float(i % 7), float(i % 5)], i % 2) for i in range(40)], "vec_id long, embedding array<double>, y int")
    edges, _ = graph.self_tuning_graph(p, 4, 2)
    post = graph.kernel_posterior(edges, p.select(F.col("vec_id").alias("id"), "y"))
    pot, lap = graph.information_potential(post), graph.laplacian(edges)
    artifacts.write_matrix(lap, str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "l")).count() == lap.count()
    eigen, modes = spectrum.solve_modes(lap, 3, graph.degrees(edges))
    long = modes.select("id", F.posexplode("phi").alias("k", "phi")).withColumn("k", F.col("k") + 1)
    artifacts.write_vertices(str(tmp_path / "v"), post, pot, long, eigen, [1, 3])
    rows = spark.read.parquet(str(tmp_path / "v" / "vertices")).collect()
    assert len(rows) == 40 and all(len(r["phi"]) == 3 for r in rows)
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "v" / "eigen")).where("selected").collect()) == [1, 3]


def test_scan_refuses(spark, sf):
    j = px.jets(spark, sf)
    with pytest.raises(ValueError, match="both classes"):
        scan.jet_index(j.where("event_number % 10 <> 9 or label_raw = 5"), 0)
    with pytest.raises(tables.SchemaError):
        scan.check_inputs(["d0", "GN2v01_pb"])
    index, audit = scan.jet_index(j, 100, max_events=120)
    assert index.count() == 100 == audit["n_sample"] and audit["n_rows"] >= audit["n_pass"]
    assert {r["y"]: r["n"] for r in index.groupBy("y").agg(F.count("*").alias("n")).collect()} == {0: 50, 1: 50}
    with pytest.raises(Exception, match="neither 0 nor 5"):
        tk.known_flavours(j).collect()
    with pytest.raises(Exception, match="differs"):
        scan.labels_and_events(j, index.withColumn("y", 1 - F.col("y"))).collect()


def test_roles_refuse(spark):
    df = spark.createDataFrame([(k, k // 2, k % 2) for k in range(20)], "source_row long, g long, y int")
    with pytest.raises(ValueError, match="labels"):
        roles.group_folds(df, "g", "y", 2)
    with pytest.raises(ValueError, match="fewer"):
        roles.group_folds(df.withColumn("g", F.col("source_row")), "g", "y", 11)
    with pytest.raises(ValueError):
        roles.fixed_roles(df, {"a": 15, "b": 6}, "source_row")
    got = roles.fixed_roles(df, {"a": 15, "b": 5}, "source_row").groupBy("role").count().collect()
    assert {r["role"]: r["count"] for r in got} == {"a": 15, "b": 5}
    same = df.withColumn("g", F.lit(4).cast("long"))
    assert roles.event_halves(same, "g").select("half").distinct().count() == 1
    odd = spark.createDataFrame([(3,), (5,), (5,)], "g long")
    for seed in range(8):
        halves = {r["g"]: r["half"] for r in roles.event_halves(odd, "g", seed).collect()}
        assert set(halves.values()) == {0, 1}


def test_hard_examples_enter_the_fit(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(200, 4))
    a /= np.linalg.norm(a, axis=1)[:, None]
    y = (a[:, 0] ** 2 + 0.1 * rng.normal(size=200) > a[:, 1] ** 2).astype(int)
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(a, y, strict=True))], "id long, a array<double>, y int")
    out, path = readout.fit_with_hard_examples(df.where("id < 120"), df.where("id >= 120"), 2, 0.1)
    hard = -(-min(int((y[120:] == c).sum()) for c in (0, 1)) // 10)
    assert [p["rows"] for p in path] == [120, 120 + 2 * hard, 120 + 2 * hard] and [p["hard"] for p in path] == [0, 2 * hard, 2 * hard]
    out.check()
    held = readout.summary(out)
    assert held["completeness_error"] < 1e-6 and all(0 <= r["off_diagonal_share"] <= 1 and r["least_eigenvalue"] > -1e-8 for r in held["classes"])
    assert readout.compactness([1, 3], {"raw": 8, "geometry": 2})["reduces"] == {"raw": True, "geometry": False}
    with pytest.raises(ValueError):
        readout.fit_with_hard_examples(df.where("y = 1"), df)
    with pytest.raises(ValueError):
        readout.bounded_rows(df, 10)
    assert path[1]["mean_probability"] > 0 and path[0].get("mean_probability") is None


def test_track_scaler_keeps_missing_at_zero(spark, tmp_path):
    rows = [(j, [(float(j + k), float("nan") if k else None) for k in range(j % 4)]) for j in range(30)]
    df = spark.createDataFrame(rows, "jet long, tracks array<struct<s:double,z:double>>")
    fitted = features.TrackScaler(["s", "z"]).fit(df)
    values = np.array([j + k for j in range(30) for k in range(j % 4)], float)
    a, m, b = np.quantile(values, [0.1, 0.5, 0.9])
    for r in fitted.transform(df).collect():
        for k, t in enumerate(r["tracks"]):
            assert t["z"] == 0.0 and t["s"] == pytest.approx((r["jet"] + k - m) / (b - a))
    features.save_map(fitted, str(tmp_path / "m.json"))
    assert features.load_map(str(tmp_path / "m.json")).params == fitted.params
    flat = spark.createDataFrame([([(5.0,), (5.0,)],)], "tracks array<struct<s:double>>")
    assert features.TrackScaler(["s"]).fit(flat).params["s"] == (5.0, 1e-6)
    with pytest.raises(Exception, match="not finite"):
        features.IdentityMap(["x"]).transform(spark.createDataFrame([(float("inf"),)], "x double")).collect()


def test_plain_helpers():
    assert plain.parse_grid("8, 4,8") == (4, 8)
    with pytest.raises(ValueError):
        plain.parse_grid("1,4")
    rates = [plain.learning_rate(e, 11, 0.1, 1.0, 0.01) for e in range(11)]
    assert rates[0] == 0.1 and rates[4] == pytest.approx(1.0) and rates[8] == pytest.approx(0.1) and rates[10] == pytest.approx(0.01)
    assert plain.latex_text("a_b & 5%") == r"a\_b \& 5\%"
    assert [plain.number_text(v) for v in (None, float("nan"), float("inf"), 3, 0.123456)] == ["--", "--", r"$\infty$", "3", "0.1235"]
    assert plain.latex_macros({"auc": 0.5}) == r"\newcommand{\auc}{0.5}"
    assert plain.latex_table(["m_1"], [("a&b",)]).splitlines()[1:3] == [r"m\_1 \\ \hline", r"a\&b \\"]
    with pytest.raises(ValueError):
        plain.latex_macros({"a1": 1})


def test_stored_tables_are_released(spark):
    df = stored(spark.range(4))
    assert df.count() == 4 and df._stored.startswith(shared_dir(spark))
    release(df)
    with pytest.raises(Exception):
        df.count()


def test_reports_are_plain_json(tmp_path):
    tables.write_json({"k": {np.int64(3): float("inf")}}, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"k": {"3": None}}
