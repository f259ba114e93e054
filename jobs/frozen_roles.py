"""Frozen roles of a growing text collection: each document gets a role once, copies of a text the same one.

Training, tuning and locked test rows must not share an event.  Here an event is a text:
letters A-Z lower-cased, white space collapsed, so that copies that arrive years apart
still get the same role.  The choice never looks at labels, source or language.  New files
are taken by a file stream with a checkpoint; a run ends when it has taken all that is there.

Output, below ``output``:

* ``ledger``, Parquet by role and batch: doc_id, source, lang, n_chars, event, half, stop.
  Roles are base, operator, dimension and test, 6, 2, 1 and 1 of ten; ``outside`` holds
  documents without words.  ``half`` halves the events, ``stop`` marks the share of them
  that early stopping may look at.
* ``counts``, Parquet by batch: rows and characters by role and source.
* ``audit``, JSON by role: the sum of the counts.
* ``settings``, JSON: what the roles depend on.  A run with other settings is refused.

A batch that runs again after a failure overwrites its own partitions with the same rows.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkorbit.operators.roles import mod10_role, split_bit, split_fraction

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LEDGER = "doc_id long, source string, lang string, n_chars long, event long, half int, stop boolean, role string, batch long"
COUNTS = "role string, source string, n_rows long, n_chars long, batch long"
ROLES = ("base", "operator", "dimension", "test", "outside")
log = logging.getLogger(__name__)


def event_of(text: Column) -> Column:
    """A number in [0, 2^60) for each text with words, equal for equal words."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    plain = F.regexp_replace(F.regexp_replace(F.translate(text, upper, lower), r"[\x20\x09-\x0D]+", " "), "^ | $", "")
    return F.when(plain != "", F.conv(F.substring(F.sha2(plain, 256), 1, 15), 16, 10).cast("long"))


def with_roles(docs: DataFrame, seed: int, stop_share: float) -> DataFrame:
    """(doc_id, source, lang, n_chars, event, half, stop, role); null event, half and stop without words."""
    out = docs.select("doc_id", "source", "lang", "n_chars", event_of(F.col("text")).alias("event"))
    event, known = F.col("event"), F.col("event").isNotNull()
    return out.withColumns({"half": F.when(known, split_bit(event, seed)), "stop": F.when(known, split_fraction(event, stop_share, seed)), "role": F.when(known, mod10_role(event)).otherwise("outside")})


def _or_none(read: Callable[[], DataFrame]) -> DataFrame | None:
    """What a reader gives; None if nothing is at its path."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _settings(spark: SparkSession, path: str, **now: object) -> None:
    """Write the settings at the first run; refuse others later."""
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'long'}" for k, v in now.items())
    before = _or_none(lambda: spark.read.schema(schema).json(path))
    held = [r.asDict() for r in before.collect()] if before is not None else []
    if not held:  # none yet, or a run that broke off before it had written them
        spark.createDataFrame([tuple(now.values())], schema).coalesce(1).write.mode("overwrite").json(path)
    elif held != [now]:
        raise ValueError(f"the roles in this folder are frozen with {held[0]}, not {now}")


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, seed: int = 7, stop_share: float = 0.2, files_per_batch: int = 100) -> dict:
    """Assign roles to the documents that are new in ``documents``, a folder or a glob of Parquet files."""
    _settings(spark, f"{output}/settings", seed=int(seed), stop_share=float(stop_share))
    ledger, counts = f"{output}/ledger", f"{output}/counts"
    taken = {"batches": 0, "read": 0}

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        rows = with_roles(batch, seed, stop_share).withColumn("batch", F.lit(number))
        rows.hint("rebalance", "role").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("role", "batch").parquet(ledger)
        # Only the folders of this batch are listed; an empty batch has none.
        mine = _or_none(lambda: session.read.schema(LEDGER).option("basePath", ledger).parquet(f"{ledger}/role=*/batch={number}"))
        if mine is None:
            log.info("batch %s of %s: read 0 rows", number, documents)
            taken["batches"] += 1
            return
        held = mine.groupBy("role", "source", "batch").agg(F.count("*").alias("n_rows"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("n_chars"))
        held.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(counts)
        by_role = {r["role"]: r["n"] for r in session.read.schema(COUNTS).parquet(counts).where(F.col("batch") == number).groupBy("role").agg(F.sum("n_rows").alias("n")).collect()}
        log.info("batch %s of %s: read %s rows, wrote %s to %s", number, documents, sum(by_role.values()), by_role, ledger)
        taken["batches"] += 1
        taken["read"] += sum(by_role.values())

    new = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(documents)
    stream = new.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    if not taken["batches"]:
        log.info("nothing new in %s", documents)
    held = _or_none(lambda: spark.read.schema(COUNTS).parquet(counts))
    if held is None:  # no file has come yet
        return taken | {"held": {}}
    held = held.groupBy("role", "source").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_chars").alias("n_chars"))
    held.coalesce(1).write.mode("overwrite").partitionBy("role").json(f"{output}/audit")
    audit = spark.read.schema("source string, n_rows long, n_chars long, role string").json(f"{output}/audit")
    by_role = {r["role"]: r["n"] for r in audit.groupBy("role").agg(F.sum("n_rows").alias("n")).collect()}
    log.info("audit of %s: %s", output, by_role)
    return taken | {"held": by_role}


def read_ledger(spark: SparkSession, output: str, role: str | None = None) -> DataFrame:
    """The roles as they stand, of one role or of all."""
    out = spark.read.schema(LEDGER).parquet(f"{output}/ledger")
    return out if role is None else out.where(F.col("role") == role)


if __name__ == "__main__":
    from jobs.command import main
    from jobs.frozen_roles import run as job

    main(__doc__, job, ("documents", "output", "checkpoint"), "frozen_roles.json")
