"""Scoring a stream of rows with a fitted readout: an extension, batch semantics unchanged."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.readout import quadratic


def score_stream(stream: DataFrame, state_col: str, m: np.ndarray, name: str = "p") -> DataFrame:
    """The rows of a stream (or table) with the probability of their state array."""
    return stream.withColumn(name, F.least(F.greatest(quadratic(F.col(state_col), m), F.lit(0.0)), F.lit(1.0)))


def windowed_rates(stream: DataFrame, time_col: str, width: str, late: str, score: str, threshold: float) -> DataFrame:
    """Rows and share above the threshold in each window of event time; rows later than ``late`` are left out."""
    passed = (F.col(score) >= threshold).cast("double")
    out = stream.withWatermark(time_col, late).groupBy(F.window(time_col, width)).agg(F.count("*").alias("n"), F.avg(passed).alias("rate"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "rate")
