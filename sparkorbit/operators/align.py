"""One-to-one joins of prediction tables, and paired comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["source_row", "event_number", "y"]


class AlignmentError(ValueError):
    """Rows that do not match one to one."""


def alignment_faults(expected: DataFrame, frame: DataFrame, keys: list[str] = KEYS, score: str = "score") -> DataFrame:
    """One row: repeated keys on either side, expected rows without a partner, scores outside [0, 1]."""
    twice = lambda d: d.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("n"))
    joined = expected.select(*keys).join(frame.select(*keys, F.col(score).alias("_s"), F.lit(1).alias("_there")), keys, "left")
    bad = joined.agg(F.sum(F.col("_there").isNull().cast("long")).alias("unmatched"), F.sum((F.col("_s").isNotNull() & (F.isnan("_s") | ~F.col("_s").between(0, 1))).cast("long")).alias("invalid"))
    return bad.crossJoin(twice(expected).select(F.col("n").alias("repeated_left"))).crossJoin(twice(frame).select(F.col("n").alias("repeated_right")))


def align_predictions(expected: DataFrame, frame: DataFrame, score: str, name: str, keys: list[str] = KEYS) -> DataFrame:
    """``expected`` with a score column; anything but a complete one-to-one match is refused."""
    faults = alignment_faults(expected, frame, keys, score).first().asDict()
    if any(faults.values()):
        raise AlignmentError(str(faults))
    return expected.join(frame.select(*keys, F.col(score).alias(name)), keys, "left")


def orbital_columns(columns: list[str], prefix: str = "phi_") -> list[str]:
    """Columns prefix + number, in the order of the numbers."""
    found = [c for c in columns if c.startswith(prefix) and c[len(prefix) :].isdigit()]
    return sorted(found, key=lambda c: int(c[len(prefix) :]))


def paired_counts(df: DataFrame, a: str, b: str, threshold_a: float, threshold_b: float) -> DataFrame:
    """One row: background mistagged by both, by one alone, and by none."""
    light = df.where("y = 0")
    x, z = F.col(a) >= threshold_a, F.col(b) >= threshold_b
    n = lambda c: F.sum(c.cast("long"))
    return light.agg(n(x & z).alias("both"), n(x & ~z).alias("only_a"), n(~x & z).alias("only_b"), n(~x & ~z).alias("neither"))


def same_label_violations(a: DataFrame, b: DataFrame, key: str = "source_row", label: str = "y") -> DataFrame:
    """One row: rows of the same key whose labels differ."""
    both = a.select(key, F.col(label).alias("_a")).join(b.select(key, F.col(label).alias("_b")), key)
    return both.agg(F.count("*").alias("n_rows"), F.sum((F.col("_a") != F.col("_b")).cast("long")).alias("n_conflicts"))
