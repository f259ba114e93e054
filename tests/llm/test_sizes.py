"""Sides too large to broadcast, and keys that count as heavy, change no row."""

import random

import pytest

from sparkorbit.llm import shared
from sparkorbit.llm.decontaminate import contained_items
from sparkorbit.llm.line_dedup import dedup_lines
from sparkorbit.llm.mixing import mix_sources
from sparkorbit.llm.near_dup import near_duplicates
from sparkorbit.llm.secrets import scan_secrets
from sparkorbit.llm.sharding import shard_documents


def _docs(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(80)]
    base = [[rng.choice(words) for _ in range(30)] for _ in range(6)]
    rows = []
    for i in range(90):
        w = list(base[0] if i % 3 else rng.choice(base))
        if i % 4 == 0:
            w[rng.randrange(30)] = "changed"
        line = f"one line of many that is common to all {i % 5}"
        rows.append((i, f"{' '.join(w)}\n{line}\nsecret: abcdef{i:03d}", f"s{i % 4}" if i % 3 else "hot"))
    rows += [rows[0]] * 5
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.mark.parametrize(
    "run",
    [
        lambda s, d: contained_items(d, s.createDataFrame([(1, "one line of many that is common"), (2, "secret: abcdef003")], "item_id long, text string")),
        lambda s, d: scan_secrets(d),
        lambda s, d: shard_documents(d, 4).drop("g"),
        lambda s, d: dedup_lines(d),
        lambda s, d: near_duplicates(d).select("doc_id", "n_shingles", "component_id", "kept"),
        lambda s, d: mix_sources(d),
    ],
    ids=["decontaminate", "secrets", "sharding", "lines", "near_dup", "mixing"],
)
def test_rows_do_not_depend_on_sizes(spark, monkeypatch, run):
    docs = _docs(spark)
    want = sorted(map(str, run(spark, docs).collect()))
    for name, value in (("BROADCAST_ROWS", 3), ("BROADCAST_BYTES", 10), ("HEAVY_ROWS", 2)):
        monkeypatch.setattr(shared, name, value)
    assert sorted(map(str, run(spark, docs).collect())) == want


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session())


def test_discarded_tables_are_gone(spark):
    df = shared.materialize(spark.range(3), "gone")
    path = df._scratch
    shared.discard(df)
    assert (spark, path) not in shared._written and df._scratch is None
