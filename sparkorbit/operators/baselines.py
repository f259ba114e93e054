"""Comparison models and the risk audit, from Spark's own logistic regression and PCA."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def logistic_scores(train: DataFrame, test: DataFrame, vector_col: str = "x", label: str = "y", c: float = 1.0, components: int = 0) -> DataFrame:
    """``test`` with ``score``: a logistic model of the vectors, or of their first principal components."""
    n = train.count()
    a, b = (d.withColumn("_v", array_to_vector(F.col(vector_col).cast("array<double>"))) for d in (train, test))
    if components:
        model = PCA(k=components, inputCol="_v", outputCol="_p").fit(a)
        a, b = (model.transform(d).drop("_v").withColumnRenamed("_p", "_v") for d in (a, b))
    fit = LogisticRegression(featuresCol="_v", labelCol=label, regParam=1 / (c * max(1, n)), standardization=True, predictionCol="_c", probabilityCol="_q", rawPredictionCol="_r").fit(a)
    return fit.transform(b).withColumn("score", vector_to_array("_q")[1]).select(*test.columns, "score")


def risk_audit(train: DataFrame, test: DataFrame, reference_col: str, state_col: str, key: str = "id", label: str = "y", level: float = 0.95) -> DataFrame:
    """One row: mean paired log-loss difference state - reference, its standard error and upper bound."""
    p = lambda c: F.least(F.greatest(F.col(c), F.lit(1e-7)), F.lit(1 - 1e-7))
    loss = lambda c: -(F.col(label) * F.ln(p(c)) + (1 - F.col(label)) * F.ln(1 - p(c)))
    one = logistic_scores(train, test, reference_col, label).select(key, label, loss("score").alias("_a"))
    two = logistic_scores(train, test, state_col, label).select(key, loss("score").alias("_b"))
    d = one.join(two, key).agg(F.avg(F.col("_b") - F.col("_a")).alias("difference"), (F.stddev_samp(F.col("_b") - F.col("_a")) / F.sqrt(F.count("*"))).alias("se"))
    return d.withColumn("upper", F.col("difference") + NormalDist().inv_cdf(level) * F.col("se"))
