import glob
import hashlib
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkorbit.llm import merkle as M
from sparkorbit.llm import shared

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(row):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return H(*(part(v) for v in row))


def tree(leaves):
    """The root, and the siblings of every leaf, level by level."""
    proofs, places = [[] for _ in leaves], list(range(len(leaves)))
    while len(leaves) > 1:
        for k, i in enumerate(places):
            run = i // 16 * 16
            proofs[k].append(("".join(leaves[run:i]), "".join(leaves[i + 1 : run + 16])))
        leaves = [H(*leaves[i : i + 16]) for i in range(0, len(leaves), 16)]
        places = [i // 16 for i in places]
    return leaves[0], proofs


def brute(rows):
    """Rows (id, leaf, subroot, root, proof), by plain loops."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    made = {s: tree([x[2] for x in sorted(groups[s])]) for s in order}
    root, upper = tree([made[s][0] for s in order])
    return sorted((str(i if has else None), h, made[s][0], root, [*p, *u]) for s, u in zip(order, upper, strict=True) for (has, i, h), p in zip(sorted(groups[s]), made[s][1], strict=True)), root


def run(df):
    out = M.merkle_manifest(df, M.leaf_digest(*map(F.col, FIELDS)), F.col("source"), F.col("doc_id"), {"doc_id": F.col("doc_id")})
    good = out.select("*", M.fold(F.col("proof"), F.col("leaf")).alias("folded"), M.proof_digest(F.col("proof")).alias("d")).collect()
    for r in good:
        assert r["folded"] == r["root"] and r["d"] == H(*(a + b for a, b in r["proof"]))
    return sorted((str(r["doc_id"]), r["leaf"], r["subroot"], r["root"], [tuple(p) for p in r["proof"]]) for r in good)


def plain(df):
    return [tuple(r) for r in df.select(*FIELDS).collect()]


def test_odd_rows(spark, odd_docs, no_docs):
    got = run(odd_docs)
    assert got == brute(plain(odd_docs))[0]
    assert run(no_docs) == []
    one = odd_docs.where("doc_id = 7")
    (only,) = run(one)
    assert only[1] == only[2] == only[3] and only[4] == []


@pytest.mark.parametrize("parts, size", [(1, 300), (7, 40), (3, 1)])
def test_groups_over_partitions(spark, monkeypatch, parts, size):
    """A hot source over several ranges, sources of every size about 16 and 256, ties, null ids; broadcast or not."""
    rng = random.Random(parts)
    sizes = {None: 1, "": 15, "a": 16, "é": 17, "b": 255, "zz": 256, "c": 257, "hot": 900, **{f"s{i}": 1 for i in range(40)}}
    rows = [(rng.randrange(10_000) if rng.random() < 0.95 else None, s, "en", i, f"text {i % 7}") for s, n in sizes.items() for i in range(n)]
    rows += [rows[-1], rows[0], *[(None, "hot", None, None, None)] * 300]
    rng.shuffle(rows)
    monkeypatch.setattr(M, "RANGE_ROWS", size)
    monkeypatch.setattr(M, "OUT_ROWS", 100)
    if parts == 7:
        monkeypatch.setattr(shared, "BROADCAST_BYTES", 10)
    if size == 1:
        rows = rows[:30]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(parts)
    assert run(df) == brute(rows)[0]


def test_a_change_is_found(spark, odd_docs):
    out = M.merkle_manifest(odd_docs, M.leaf_digest(*map(F.col, FIELDS)), F.col("source"), F.col("doc_id"), {"doc_id": F.col("doc_id"), "leaf": F.lit("kept ones give way")})
    bad = out.withColumn("folded", M.fold(F.col("proof"), F.sha2("leaf", 256))).where("folded = root").count()
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof"] and bad == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 5000), st.data())
def test_pieces_cover_and_are_complete(n, data):
    cuts = sorted(data.draw(st.lists(st.integers(0, n), max_size=5)))
    at = 0
    for a, b in zip([0, *cuts], [*cuts, n], strict=True):
        for level, idx, size in M.pieces(a, b, n):
            assert idx * 16**level == at and size == min(16**level, n - at) and level <= M.LOCAL
            at += size
    assert at == n


def test_no_checkpoint_is_left(spark, odd_docs):
    before = spark.sparkContext.getCheckpointDir() or shared.shared_dir(spark)
    run(odd_docs)
    root = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    assert before and not [p for p in glob.glob(f"{root}/rdd-*") if os.listdir(p)]


def test_no_task_takes_the_equal_rows(spark):
    """A third of all rows equal: the sorted ranges stay even."""
    rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.lit("+x")).otherwise(F.concat(F.lit("+"), F.col("id") % 50)).alias("g"), F.when(F.col("id") % 3 != 0, F.col("id")).alias("o"))
    rows = rows.select("g", "o", F.unhex(F.sha2(F.coalesce(F.col("o").cast("string"), F.lit("same")), 256)).alias("leaf"), F.struct("o").alias("own")).repartition(4)
    sizes = [r["n"] for r in M._in_ranges(rows, 400_000).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 9000 and len(sizes) == 8 and max(sizes) < 2 * 9000 / 8
