"""Choosing among candidate models (arms): one row for each, so their order is a small sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def screen(arms: DataFrame, k: int, score: str = "score", size: str = "size", name: str = "arm") -> DataFrame:
    """The k arms of the highest score, ties to the smaller one, then by name."""
    return arms.orderBy(F.col(score).desc(), size, name).limit(k)


def least_by(arms: DataFrame, *keys: str | Column) -> DataFrame:
    """The first arm in the order of the keys, compared one after the other."""
    return arms.orderBy(*keys).limit(1)


def simplest_equivalent(arms: DataFrame, lower: str = "lower", score: str = "score", size: str = "size", k: str = "k", name: str = "arm", share: float = 0.99) -> DataFrame:
    """Of the arms whose lower bound is within 1 % of the best one, the smallest; then by score, modes and name."""
    best = F.max(lower).over(Window.partitionBy())
    near = arms.withColumn("_best", best).where(F.col(lower) >= share * F.col("_best")).drop("_best")
    return least_by(near, F.col(size).asc(), F.col(score).desc(), F.col(k).asc(), F.col(name).asc())


def distinct_sets(arms: DataFrame, bank: str, selected: str, k: str = "k", name: str = "arm") -> DataFrame:
    """One arm, the one of the smallest k, then the first by name, of those of a bank that select the same set.

    ``selected`` is an array; its order and repeated members do not matter.
    """
    best = F.min(F.struct(F.col(k).alias("k"), F.col(name).alias("name")))
    out = arms.groupBy(bank, F.array_sort(F.array_distinct(selected)).alias(selected)).agg(best.alias("_b"))
    return out.select(bank, selected, F.col("_b.k").alias(k), F.col("_b.name").alias(name))
