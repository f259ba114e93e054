"""Thin queries opN_<name>: each applies its operator to the whole intended table.

``ORACLE`` has SQL for some; the others are tested against brute force.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import contained_items
from .licenses import scan_licenses
from .line_dedup import dedup_lines
from .merkle import fold, leaf_digest, merkle_manifest, proof_digest
from .mixing import mix_sources
from .near_dup import near_duplicates
from .oracles import ORACLE
from .quality import quality_scores
from .secrets import BASE, joined, scan_secrets
from .sharding import shard_documents
from .shared import importable, kept
from .tokens import count_tokens, write_training_order
from .topk import top_products


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contained_items(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    held = found.groupBy("doc_id", "item_id").agg(F.max("item_shingles").alias("item_shingles"), F.max("hits").alias("hits"))
    return held.withColumn("containment", F.round(F.col("hits") / F.col("item_shingles"), 6))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("secret_spans")
    of = lambda k: F.filter(spans, lambda s: s["kind"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{r.kind}") for k, r in enumerate(BASE)]
    base = F.sha2(joined(F.filter(spans, lambda s: s["kind"] < len(BASE))), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), joined(spans).alias("spans"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_scores(docs, _read(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_read(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", "copies", F.round("rate", 9).alias("rate"))


def op9_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return write_training_order(docs, kept(spark, "training"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(_read(spark, sf_dir, "embeddings"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    head = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    small = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf_digest(*head, small))
    out = merkle_manifest(docs, leaf_digest(*head, F.col("text")), F.col("source"), F.col("doc_id"), {"doc_id": F.col("doc_id"), "changed": F.unhex(changed)})
    folded = fold(F.col("proof"), F.coalesce(F.lower(F.hex("changed")), F.col("leaf")))
    out = out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("license_spans", lambda s: s["base"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    starts = F.transform(base, lambda s: s["start"])
    return found.select(
        "doc_id", F.col("license_words").alias("n_words"), F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("license_spans")).alias("labels"), F.col("license_score").alias("score"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_secrets": op2_secrets,
    "op3_quality": op3_quality,
    "op4_sharding": op4_sharding,
    "op5_token_counts": op5_token_counts,
    "op6_line_dedup": op6_line_dedup,
    "op7_near_dup": op7_near_dup,
    "op8_mixing": op8_mixing,
    "op9_training_order": op9_training_order,
    "op10_topk": op10_topk,
    "op11_manifest": op11_manifest,
    "op12_licenses": op12_licenses,
}

__all__ = ["ORACLE", "QUERIES"]
