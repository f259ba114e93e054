"""Screen of text features: how well each alone separates the labelled classes, over all documents and in slices.

Reads ``documents`` and ``labels`` and measures each feature as a score, in every slice
of language and size: areas under ROC and precision-recall curves, and which feature is
the strongest of its slice, in whichever direction.  Thresholds at fixed signal efficiencies
are set on all labelled rows and then applied in the slices.

Output, below ``output``:

* ``screen``, Parquet by axis: slice, feature, n_pos, n_neg, auc, average_precision, strongest.
  Areas are null in slices with one class; ``strongest`` compares |auc - 1/2|, ties by name.
* ``working_points``, ORC by axis: slice, feature, efficiency, threshold, counts, mistag rate with
  its binomial interval, rejection.

A run overwrites both tables; with the same input it writes the same rows.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkorbit.functions.stored import scope, stored
from sparkorbit.operators.evaluate import best_per_group, roc_areas, thresholds, with_intervals, working_points
from sparkorbit.sources.workers import importable

BY = ("axis", "slice", "feature")
BLANKS = " \t\n\x0b\f\r"
#: Labels, an id and a number each, up to which they are broadcast.
FEW_LABELS = 4_000_000
log = logging.getLogger(__name__)


def features(text: Column) -> dict[str, Column]:
    """Scores of a text: counts, and shares of its characters or lines; 0 without text."""
    text = F.coalesce(text, F.lit(""))
    # What is left of a text is measured: a count of matches would make an array of them.
    left = lambda text, pattern, by: F.length(F.regexp_replace(text, F.lit(pattern), F.lit(by)))
    words = left(F.rtrim(text, F.lit(BLANKS)), r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++", "x")
    n, lines = F.length(text), F.split(text, "\n", -1)
    share = lambda of: F.coalesce(F.try_divide(left(text, f"[^{of}]++", "").cast("double"), n.cast("double")), F.lit(0.0))
    return {
        "characters": n.cast("double"),
        "words": words.cast("double"),
        "word_length": F.coalesce(F.try_divide(n.cast("double"), words.cast("double")), F.lit(0.0)),
        "lines": F.size(lines).cast("double"),
        "distinct_lines": F.size(F.array_distinct(lines)).cast("double") / F.size(lines),
        "letters": share("A-Za-z"),
        "capitals": share("A-Z"),
        "digits": share("0-9"),
        "stops": share(".!?"),
    }


def scored_rows(documents: DataFrame, labels: DataFrame, label: str, size_edges: list[int]) -> DataFrame:
    """(axis, slice, feature, y, score) of the labelled documents: over all, by language, by number of characters.

    Labels other than 0 and 1 are left out; a document of unknown language is in slice ``-``.
    """
    size = F.length(F.coalesce(F.col("text"), F.lit("")))
    named = F.lit(f"{size_edges[-1]}+") if size_edges else F.lit("any")
    for low, high in reversed(list(zip([0, *size_edges], size_edges, strict=False))):
        named = F.when(size < high, f"{low}-{high - 1}").otherwise(named)
    slices = [("all", F.lit("all")), ("lang", F.coalesce("lang", F.lit("-"))), ("size", named)]
    each = F.array(*(F.struct(F.lit(f).alias("feature"), c.alias("score")) for f, c in features(F.col("text")).items()))
    marks = labels.where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("y"))
    few = marks.limit(FEW_LABELS + 1).count() <= FEW_LABELS
    known = documents.select("doc_id", "lang", "text").join(F.broadcast(marks) if few else marks, "doc_id")  # only labelled texts are read through
    slim = stored(known.select("y", F.array(*(F.struct(F.lit(a).alias("axis"), s.alias("slice")) for a, s in slices)).alias("slices"), each.alias("scores")))
    return slim.select("y", F.inline("slices"), "scores").select("y", "axis", "slice", F.inline("scores"))


def run(spark: SparkSession, documents: str, labels: str, output: str, label: str = "quality", efficiencies: tuple[float, ...] = (0.5, 0.7, 0.9), size_edges: tuple[int, ...] = (200, 1000, 5000)) -> dict:
    """Write the screen and the working points of the documents and labels at these paths."""
    importable(spark)
    with scope():
        return _run(spark, documents, labels, output, label, list(efficiencies), list(size_edges))


def _run(spark: SparkSession, documents: str, labels: str, output: str, label: str, efficiencies: list[float], size_edges: list[int]) -> dict:
    rows = stored(scored_rows(spark.read.parquet(documents), spark.read.parquet(labels), label, size_edges))
    everywhere = rows.where("axis = 'all'")
    log.info("read %s and %s: %s labelled documents", documents, labels, everywhere.where("feature = 'words'").count())

    areas = stored(roc_areas(rows, BY))  # a row for each slice and feature
    best = best_per_group(areas.where("auc is not null").withColumn("_edge", F.round(F.col("auc") - 0.5, 9)), ["axis", "slice"], "_edge", "feature").select(*BY, F.lit(True).alias("strongest"))
    screen = areas.join(best, list(BY), "left").select(*BY, "n_pos", "n_neg", F.round("auc", 9).alias("auc"), F.round("average_precision", 9).alias("average_precision"), F.coalesce("strongest", F.lit(False)).alias("strongest"))
    screen.coalesce(1).write.mode("overwrite").partitionBy("axis").parquet(f"{output}/screen")  # a row for each slice and feature

    cuts = thresholds(everywhere, efficiencies, ("feature",))
    points = with_intervals(working_points(rows, efficiencies, BY, within=cuts))
    points.coalesce(1).write.mode("overwrite").partitionBy("axis").orc(f"{output}/working_points")
    wrote = {t: r.count() for t, r in (("screen", read_screen(spark, output)), ("working_points", spark.read.orc(f"{output}/working_points")))}
    log.info("wrote %s below %s", wrote, output)
    return wrote


def read_screen(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema("slice string, feature string, n_pos long, n_neg long, auc double, average_precision double, strongest boolean, axis string").parquet(f"{output}/screen")


if __name__ == "__main__":
    from jobs.command import main
    from jobs.feature_screen import run as job

    main(__doc__, job, ("documents", "labels", "output"), "feature_screen.json")
