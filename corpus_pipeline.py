"""The corpus pipeline: stages over ``documents``, each by one operator of sparkorbit.llm.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns
a DataFrame, which ``run`` writes to the shared folder and reads again as the docs of
the next.  All but the last return the columns of documents, and those that the
table has besides, whatever their names; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkorbit.llm.decontaminate import decontaminate
from sparkorbit.llm.mixing import apply_mix
from sparkorbit.llm.near_dup import drop_duplicates
from sparkorbit.llm.quality import quality_scores
from sparkorbit.llm.shared import fresh, importable, kept, materialize
from sparkorbit.llm.tokens import write_training_order


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; null and empty texts are scored as an empty passage.  The columns stay as they are."""
    importable(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    row = fresh(docs, "row")[0]
    packed = docs.select("doc_id", "text", F.struct("*").alias(row))
    return quality_scores(packed, labels).where("predicted = 1").select(f"{row}.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of the smallest id; so do all without words."""
    importable(spark)
    return drop_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go; with no items, none does."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix has it, its columns unchanged; one without words once."""
    return apply_mix(docs)


def training_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences in shard files; the manifest is returned.  Documents without text have none."""
    importable(spark)
    return write_training_order(docs, kept(spark, "training"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("training_order", training_order),
]

#: A learnt score, MinHash groups and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
