"""The jobs over growing copies of their input, and their queries against SQL."""

import glob
import logging
import os
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import feature_screen, frozen_roles
from jobs.queries import ORACLE, QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
KIND = frozen_roles.SCHEMA


def held(df):
    return sorted(map(str, df.drop("batch").collect()))


def add(spark, rows, folder):
    spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(folder)


ODD = [
    (1, "One  text\nof many", "en", "a", 17),
    (2, "one text of MANY ", "de", "b", 17),
    (3, None, None, None, None),
    (4, "", "en", "a", 0),
    (5, " \t\n", "en", "a", 3),
    (None, "no id", "en", None, 5),
    (6, "é" * 50_000, "fr", "c", 50_000),
]


def test_roles_of_growing_input(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO)
    docs, out, mark = (f"file://{tmp_path}/{n}" for n in ("docs", "out", "mark"))
    add(spark, ODD[:3], docs)
    first = frozen_roles.run(spark, docs, out, mark)
    assert first["batches"] == 1 and first["read"] == 3
    before = held(frozen_roles.read_ledger(spark, out))
    assert "read 3 rows" in caplog.text

    again = frozen_roles.run(spark, docs, out, mark)
    assert again["batches"] == 0 and again["held"] == first["held"] and held(frozen_roles.read_ledger(spark, out)) == before

    add(spark, ODD[3:], docs)
    add(spark, [(7, "One text of many", "en", "z", 16)], docs)
    more = frozen_roles.run(spark, docs, out, mark, files_per_batch=1)
    assert more["batches"] == 2 and more["read"] == 5 and sum(more["held"].values()) == 8
    now = frozen_roles.read_ledger(spark, out)
    assert set(before) < set(held(now))
    rows = {r["doc_id"]: r for r in now.collect()}
    assert len({(rows[k]["event"], rows[k]["role"], rows[k]["half"], rows[k]["stop"]) for k in (1, 2, 7)}) == 1
    assert [rows[k]["role"] for k in (3, 4, 5)] == ["outside"] * 3 and rows[3]["event"] is None and rows[3]["half"] is None
    assert rows[None]["role"] in frozen_roles.ROLES[:4]

    whole = f"file://{tmp_path}/whole"
    frozen_roles.run(spark, docs, f"{whole}/out", f"{whole}/mark")
    assert held(frozen_roles.read_ledger(spark, f"{whole}/out")) == held(now)
    assert {r["role"] for r in frozen_roles.read_ledger(spark, out, "outside").collect()} == {"outside"}


def test_a_batch_that_broke_off_runs_again(spark, tmp_path):
    docs, out, mark = (f"file://{tmp_path}/{n}" for n in ("docs", "out", "mark"))
    add(spark, ODD, docs)
    frozen_roles.run(spark, docs, out, mark)
    before = held(frozen_roles.read_ledger(spark, out))
    for p in glob.glob(f"{tmp_path}/mark/commits/*") + glob.glob(f"{tmp_path}/mark/commits/.*crc"):
        os.remove(p)
    again = frozen_roles.run(spark, docs, out, mark)
    assert again["batches"] == 1 and again["read"] == len(ODD) and sum(again["held"].values()) == len(ODD)
    assert held(frozen_roles.read_ledger(spark, out)) == before


def test_frozen_settings_and_no_input(spark, tmp_path):
    docs, out, mark = (f"file://{tmp_path}/{n}" for n in ("docs", "out", "mark"))
    spark.createDataFrame([], KIND).write.parquet(docs)
    assert frozen_roles.run(spark, docs, out, mark, seed=1)["read"] == 0
    with pytest.raises(ValueError, match="frozen"):
        frozen_roles.run(spark, docs, out, mark, seed=2)


def test_the_shares_of_the_roles(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"), F.lit(9).alias("n_chars"))
    rows = frozen_roles.with_roles(docs, 7, 0.2)
    n = {r["role"]: r["count"] for r in rows.groupBy("role").count().collect()}
    assert all(abs(n[role] - share * 20_000) < 400 for role, share in (("base", 0.6), ("operator", 0.2), ("dimension", 0.1), ("test", 0.1)))
    assert abs(rows.where("stop").count() - 4000) < 300 and abs(rows.where("half = 1").count() - 10_000) < 400


def test_screen_twice_and_grown(spark, tmp_path):
    docs, labels, out = (f"file://{tmp_path}/{n}" for n in ("docs", "labels", "out"))
    rows = [(i, None if i == 5 else f"Word{'!' * (i % 4)} " * (1 + i % 7 + 9 * (i % 2)), [None, "en", "de"][i % 3], "s", 1) for i in range(60)]
    add(spark, rows, docs)
    spark.createDataFrame([(i, i % 2 if i % 10 else None, 0) for i in range(50)] + [(None, 1, 1), (999, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(labels)
    wrote = feature_screen.run(spark, docs, labels, out)
    before = held(feature_screen.read_screen(spark, out))
    assert feature_screen.run(spark, docs, labels, out) == wrote and held(feature_screen.read_screen(spark, out)) == before
    rows_ = feature_screen.read_screen(spark, out).collect()
    everywhere = {r["feature"]: r for r in rows_ if r["axis"] == "all"}
    assert len(everywhere) == 9 and everywhere["words"]["n_pos"] + everywhere["words"]["n_neg"] == 45
    assert everywhere["words"]["auc"] == 0.96  # of the 25 long texts all but the null one
    assert sum(r["strongest"] for r in rows_) == len({(r["axis"], r["slice"]) for r in rows_ if r["auc"] is not None})
    assert {r["slice"] for r in rows_ if r["axis"] == "lang"} == {"-", "en", "de"}
    points = spark.read.orc(f"{out}/working_points").where("axis = 'all' and feature = 'words'").collect()
    assert sorted(r["efficiency"] for r in points) == [0.5, 0.7, 0.9] and all(r["low"] <= (r["mistag_rate"] or 0) <= r["high"] for r in points)
    add(spark, [(999, "late " * 40, "en", "s", 200)], docs)
    feature_screen.run(spark, docs, labels, out)
    assert feature_screen.read_screen(spark, out).where("axis = 'all' and feature = 'words'").first()["n_pos"] == everywhere["words"]["n_pos"] + 1


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    rel, df = con.sql(ORACLE[name]), QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert sorted(str([plain(r[c]) for c in cols]) for r in df.collect()) == sorted(str([plain(r[k]) for k in at]) for r in rel.fetchall())


def test_command_line(sf, tmp_path):
    """The command line makes and ends a session of its own; a second call takes nothing new."""
    docs = tmp_path / "docs"
    docs.mkdir()
    os.symlink(f"{sf}/documents.parquet", docs / "documents.parquet")
    call = [sys.executable, "-m", "jobs.frozen_roles", "--documents", str(docs), "--output", str(tmp_path / "out"), "--checkpoint", str(tmp_path / "mark")]
    env = os.environ | {"PYTHONPATH": ROOT, "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"}
    for want in ("done: {'batches': 1", "done: {'batches': 0"):
        done = subprocess.run(call, env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0 and want in done.stderr, done.stderr[-2000:]


def test_features_read_labelled_texts_without_arrays_of_matches(spark):
    import re

    from pyspark.sql import functions as F

    from sparkorbit.operators import evaluate

    texts = [None, "", " \t\n", "a", "  One two\x0bthree.\n\nA1 B2!  ", "x " * 50 + "\r\n " * 30, "\u00e9t\u00e9 \U0001f600 Z\u00a09?", "\n", "$1 \\ (a)"]
    docs = spark.createDataFrame([(i, "en" if i % 2 else None, t) for i, t in enumerate(texts)], "doc_id long, lang string, text string")
    names = list(feature_screen.features(F.col("text")))
    got = {r["doc_id"]: r for r in docs.select("doc_id", *(c.alias(n) for n, c in feature_screen.features(F.col("text")).items())).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        count = lambda p: len(re.findall(p, t))  # noqa: B023, E731
        words, n = count(r"[^\x20\x09-\x0D]+"), len(t)
        lines = t.split("\n")
        want = [n, words, n / words if words else 0, len(lines), len(set(lines)) / len(lines), *(count(p) / n if n else 0 for p in ("[A-Za-z]", "[A-Z]", "[0-9]", "[.!?]"))]
        assert [got[i][c] for c in names] == pytest.approx(want), t
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)] + [(4, 7)], "doc_id long, quality int")
    rows = feature_screen.scored_rows(docs, labels, "quality", [2, 5])
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan  # each text is read through once, however many slices it is in
    assert rows.count() == 4 * 3 * len(names)

    scores = spark.createDataFrame([(m, (k * 7 + len(m)) % 3 // 2 if m != "one" else 1, float(k % 5)) for m in ("a", "bb", "one") for k in range(40)], "method string, y int, score double")
    area = {r["method"]: r for r in evaluate.roc_areas(scores).collect()}
    for r in evaluate.roc_auc(scores).join(evaluate.average_precision(scores), "method").collect():
        a = area[r["method"]]
        assert a["n_pos"] == r["n_pos"] and a["n_neg"] == r["n_neg"] and a["average_precision"] == pytest.approx(r["average_precision"], abs=1e-14)
        assert a["auc"] is None if r["auc"] is None else a["auc"] == pytest.approx(r["auc"], abs=1e-14)
