import corpus_pipeline
from pyspark.sql import functions as F
from sparkorbit.llm.decontaminate import contained_items
from sparkorbit.llm.near_dup import near_duplicates
from sparkorbit.llm.shared import materialize


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf), name)
        seen[name] = (before, docs)
        if name != "training_order":
            assert docs.columns == columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    left = {r["doc_id"] for r in seen["quality"][1].collect()}
    known = [d for d in labels if labels[d] is not None]
    assert sum((d in left) == (labels[d] == 1) for d in known) >= 0.9 * len(known)
    unique = near_duplicates(seen["near_duplicates"][1])
    assert unique.where("not kept").count() == 0
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert contained_items(seen["decontamination"][1], benchmark).count() == 0
    bad = {r["doc_id"] for r in contained_items(seen["decontamination"][0], benchmark).collect()}
    gone = {r["doc_id"] for r in seen["decontamination"][0].collect()} - {r["doc_id"] for r in seen["decontamination"][1].collect()}
    assert gone == bad
    slots = sorted(r["slot"] for r in seen["training_order"][1].collect())
    assert slots == list(range(len(slots))) and slots


def test_columns_with_clashing_names_pass_through(spark, sf, clashes):
    own = {c: F.lit("own") for c in [*clashes, "held_out", "score", "predicted", "copies", "taken", "target", "source_size"]}
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns(own)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf), name)
        assert docs.columns == columns
        assert docs.select(*own).distinct().collect() == [tuple(["own"] * len(own))]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() > 0


def test_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf), name)
    assert docs.count() == 0
