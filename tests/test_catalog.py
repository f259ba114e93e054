"""Every query of the catalogue against its SQL in DuckDB."""

import glob
import math
import os

import duckdb
import pytest

from sparkorbit.plans.catalog import QUERIES
from sparkorbit.plans.oracles import ORACLES


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    v = float(v)
    return None if math.isnan(v) else round(v, 5) + 0.0


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    rel = con.sql(ORACLES[name])
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    got = ordered(tuple(plain(r[c]) for c in cols) for r in df.collect())
    want = ordered(tuple(plain(r[k]) for k in at) for r in rel.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-5) for x, y in zip(a, b, strict=True)), (a, b)


def test_queries_without_sql():
    assert set(QUERIES) - set(ORACLES) == {"eigen_residual", "fit_predict_small", "clopper_pearson_bands", "roc_bands", "architecture_search", "gated_branches"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, sf, name):
    rows = QUERIES[name](spark, sf).collect()
    assert rows and all(v is None or v == v for r in rows for v in r)
    if name == "gated_branches":
        assert [r["branch"] for r in rows] == [0, 1, 2, 3, 4] and rows[0]["open"] and rows[0]["gate"] == 1
    if name == "eigen_residual":
        assert len(rows) == 12 and max(r["residual"] for r in rows) < 1e-6
    if name == "fit_predict_small":
        assert all(0 <= r["p"] <= 1 for r in rows)
    if name == "roc_bands":
        assert all(0 <= r["fpr_low"] <= r["fpr_high"] <= 1 and 0 <= r["tpr_low"] <= r["tpr_high"] <= 1 for r in rows)
