"""Evaluation of scores: ROC, working points, slices, correlation, histograms.

Scores are rows (method, y, score [, weight]); every function handles all methods at
once and reduces to distinct scores before anything is ordered.  Scores that are null
or not finite have no place in an order: they make the query fail, and
``score_validity`` counts them beforehand.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import clopper_pearson
from ..functions.prefix import following, quantiles, running_sums
from ..functions.scalars import clip, finite
from ..functions.stored import stored
from .features import column_quantiles

#: Rows up to which a table of ranks, two numbers a row, is broadcast.
SMALL = 1_000_000
#: Kinematic slices, lower bound included, upper excluded.
PT_SLICES = [(20.0, 40.0), (40.0, 70.0), (70.0, 120.0), (120.0, 250.0), (250.0, None)]
ETA_SLICES = [(0.0, 0.6), (0.6, 1.2), (1.2, 1.8), (1.8, 2.5)]


def score_counts(df: DataFrame, by: tuple[str, ...] = ("method",), weight: str | None = None) -> DataFrame:
    """Weighted positives and negatives of each distinct score."""
    w = F.col(weight) if weight else F.lit(1)
    refused = F.raise_error(F.lit("a score is null or not finite")).cast(df.schema["score"].dataType)
    df = df.withColumn("score", F.when(finite(F.col("score")), F.col("score")).otherwise(refused))
    return df.groupBy(*by, "score").agg(F.sum(w * F.col("y")).alias("pos"), F.sum(w * (1 - F.col("y"))).alias("neg"))


def roc_auc(df: DataFrame, by: tuple[str, ...] = ("method",), weight: str | None = None) -> DataFrame:
    """(by, auc, n_pos, n_neg): area under the ROC curve, ties count one half; null with one class."""
    run = running_sums(score_counts(df, by, weight), "score", {"below": "neg"}, by, inclusive=False)
    out = run.groupBy(*by).agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("area"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return out.select(*by, (F.col("area") / F.nullif(F.col("n_pos") * F.col("n_neg"), F.lit(0))).alias("auc"), "n_pos", "n_neg")


def average_precision(df: DataFrame, by: tuple[str, ...] = ("method",)) -> DataFrame:
    """(by, average_precision): precision at each distinct score, weighted by the recall it adds."""
    run = running_sums(score_counts(df, by), "score", {"tp": "pos", "fp": "neg"}, by, descending=True)
    step = F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))
    return run.groupBy(*by).agg((F.sum(step) / F.nullif(F.sum("pos"), F.lit(0))).alias("average_precision"))


def roc_areas(df: DataFrame, by: tuple[str, ...] = ("method",)) -> DataFrame:
    """(by, n_pos, n_neg, auc, average_precision): ``roc_auc`` and ``average_precision`` from one running sum."""
    run = running_sums(score_counts(df, by), "score", {"tp": "pos", "fp": "neg"}, by, descending=True)
    step = F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))
    lost = F.col("pos") * (F.col("fp") - F.col("neg") / 2)  # pairs whose negative has the higher score, ties one half
    out = run.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(lost).alias("_lost"), F.sum(step).alias("_steps"))
    pairs = F.col("n_pos") * F.col("n_neg")
    return out.select(*by, "n_pos", "n_neg", ((pairs - F.col("_lost")) / F.nullif(pairs, F.lit(0))).alias("auc"), (F.col("_steps") / F.nullif(F.col("n_pos"), F.lit(0))).alias("average_precision"))


def roc_table(df: DataFrame, by: tuple[str, ...] = ("method",), totals: bool = False) -> DataFrame:
    """A row for each distinct score as threshold (score >= threshold passes), and the empty point before them.

    ``rejection`` = 1 / fpr, null and ``censored`` without mistags; ``totals`` adds n_pos and n_neg.
    """
    counts = score_counts(df, by)
    run = running_sums(counts, "score", {"tp": "pos", "fp": "neg"}, by, descending=True)
    sums = run.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    empty = sums.select(*by, F.lit(None).cast("double").alias("threshold"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"))
    out = run.select(*by, F.col("score").cast("double").alias("threshold"), "tp", "fp").unionByName(empty).join(sums, list(by))
    out = out.withColumn("tpr", F.col("tp") / F.nullif(F.col("n_pos"), F.lit(0))).withColumn("fpr", F.col("fp") / F.nullif(F.col("n_neg"), F.lit(0)))
    return out.select(*by, "threshold", "tp", "fp", "tpr", "fpr", F.when(F.col("fp") > 0, 1 / F.nullif(F.col("fpr"), F.lit(0.0))).alias("rejection"), (F.col("fp") == 0).alias("censored"), *(("n_pos", "n_neg") if totals else ()))


def roc_corners(df: DataFrame, by: tuple[str, ...] = ("method",)) -> DataFrame:
    """``roc_table`` without the points in the middle of a line: those after which the counts grow as before them.

    The empty point, the first threshold and the last stay, and so the area is the same.
    """
    counts = following(score_counts(df, by), "score", ["pos", "neg"], by, descending=True)
    first = counts.groupBy(*by).agg(F.max("score").alias("_first"))
    inner = (F.col("next.pos") == F.col("pos")) & (F.col("next.neg") == F.col("neg")) & (F.col("score") != F.col("_first"))
    gone = counts.join(F.broadcast(first), list(by)).where(inner).select(*by, F.col("score").cast("double").alias("threshold"))  # a row for each method
    return roc_table(df, by).join(gone, [*by, "threshold"], "left_anti")


def thresholds(df: DataFrame, efficiencies: list[float], by: tuple[str, ...] = ("method",)) -> DataFrame:
    """(by, efficiency, threshold): linear quantile 1 - efficiency of the signal scores."""
    held = quantiles(df.where("y = 1"), "score", [1 - e for e in efficiencies], by)
    pairs = F.arrays_zip(F.array(*map(F.lit, efficiencies)).alias("efficiency"), F.col("q").alias("threshold"))
    return held.select(*by, F.explode(pairs).alias("p")).select(*by, "p.efficiency", "p.threshold")


def working_points(df: DataFrame, efficiencies: list[float], by: tuple[str, ...] = ("method",), within: DataFrame | None = None) -> DataFrame:
    """Counts and rates at signal efficiencies; ``within`` are thresholds fixed elsewhere.

    ``rejection`` is null and ``censored`` without mistags.
    """
    points = within if within is not None else thresholds(df, efficiencies, by)
    passed = F.col("score") >= F.col("threshold")
    cut = df.join(F.broadcast(points), [c for c in by if c in points.columns])  # a row for each method and efficiency
    out = cut.groupBy(*by, "efficiency", "threshold").agg(F.sum("y").alias("n_signal"), F.sum(1 - F.col("y")).alias("n_background"), F.sum(F.when(passed, F.col("y")).otherwise(0)).alias("selected"), F.sum(F.when(passed, 1 - F.col("y")).otherwise(0)).alias("mistags"))
    out = out.withColumn("signal_efficiency", F.col("selected") / F.nullif(F.col("n_signal"), F.lit(0))).withColumn("mistag_rate", F.col("mistags") / F.nullif(F.col("n_background"), F.lit(0)))
    return out.withColumn("rejection", F.when(F.col("mistags") > 0, F.col("n_background") / F.nullif(F.col("mistags"), F.lit(0)))).withColumn("censored", F.col("mistags") == 0)


def _bounds(level: float):
    """Clopper-Pearson bounds of k / n by batches; equal pairs are solved once."""

    def solve(k: pd.Series, n: pd.Series) -> pd.DataFrame:
        pairs = list(zip(k.tolist(), n.tolist(), strict=True))
        held = {p: clopper_pearson(int(p[0]), int(p[1]), level) for p in set(pairs)}
        return pd.DataFrame([held[p] for p in pairs], columns=["low", "high"], dtype=float)

    return F.pandas_udf(solve, "low double, high double")


def with_intervals(points: DataFrame, k: str = "mistags", n: str = "n_background", level: float = 0.6827) -> DataFrame:
    """Clopper-Pearson bounds ``low`` and ``high`` of k / n."""
    return points.withColumn("_b", _bounds(level)(F.col(k), F.col(n))).select(*points.columns, "_b.low", "_b.high")


def roc_bands(df: DataFrame, by: tuple[str, ...] = ("method",), level: float = 0.68) -> DataFrame:
    """``roc_table`` with binomial bounds of both efficiencies and, from those of the mistag rate, of the rejection.

    A bound of the rejection is null where the mistag rate's is 0, an infinite rejection.
    """
    table = roc_table(df, by, totals=True)
    solve = _bounds(level)
    # Each pair of counts is solved once: thresholds share them.
    for name, k, n in (("fpr", "fp", "n_neg"), ("tpr", "tp", "n_pos")):
        pairs = table.select(k, n).distinct().withColumn("_b", solve(F.col(k), F.col(n)))
        pairs = pairs.select(k, n, F.col("_b.low").alias(f"{name}_low"), F.col("_b.high").alias(f"{name}_high"))
        table = table.join(pairs, [k, n])
    over = lambda c: F.when(F.col(c) > 0, 1 / F.nullif(F.col(c), F.lit(0.0)))
    return table.withColumns({"rejection_low": over("fpr_high"), "rejection_high": over("fpr_low")})


def probability_metrics(df: DataFrame, by: tuple[str, ...] = ("method",), eps: float = 1e-7) -> DataFrame:
    """Log loss, Brier score, accuracy, balanced accuracy and Matthews correlation at one half."""
    p, y = clip(F.col("score"), eps, 1 - eps), F.col("y")
    hit = (F.col("score") >= 0.5).cast("int")
    cell = lambda a, b: F.sum(((hit == a) & (y == b)).cast("long"))
    out = df.groupBy(*by).agg(F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("log_loss"), F.avg((F.col("score") - y) * (F.col("score") - y)).alias("brier"), cell(1, 1).alias("tp"), cell(0, 0).alias("tn"), cell(1, 0).alias("fp"), cell(0, 1).alias("fn"))
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    out = out.withColumn("accuracy", (tp + tn) / (tp + tn + fp + fn))
    out = out.withColumn("balanced_accuracy", (F.try_divide(tp, tp + fn) + F.try_divide(tn, tn + fp)) / 2)
    return out.withColumn("mcc", F.when(root > 0, (tp * tn - fp * fn) / F.nullif(root, F.lit(0.0))).otherwise(F.lit(0.0)))


def classification_summary(df: DataFrame, by: tuple[str, ...] = ("method",)) -> DataFrame:
    """Areas and probability metrics; the latter null where scores leave [0, 1]."""
    bad = df.groupBy(*by).agg(F.max((~F.col("score").between(0, 1)).cast("int")).alias("_bad"))
    out = roc_auc(df, by).join(average_precision(df, by), list(by)).join(probability_metrics(df, by), list(by)).join(bad, list(by))
    names = ["log_loss", "brier", "accuracy", "balanced_accuracy", "mcc"]
    return out.select(*by, "auc", "average_precision", *(F.when(F.col("_bad") == 0, F.col(c)).alias(c) for c in names))


def slice_of(x: Column, edges: list[tuple[float, float | None]]) -> Column:
    """The number of the slice that holds x, null outside."""
    out = F.lit(None).cast("int")
    for k, (low, high) in reversed(list(enumerate(edges))):
        inside = x >= low if high is None else (x >= low) & (x < high)
        out = F.when(inside, F.lit(k)).otherwise(out)
    return out


def in_slices(df: DataFrame, pt: Column, eta: Column) -> DataFrame:
    """Every row once in its momentum and once in its pseudorapidity slice: columns axis, slice."""
    both = F.array(F.struct(F.lit("pt").alias("axis"), slice_of(pt, PT_SLICES).alias("slice")), F.struct(F.lit("abs_eta").alias("axis"), slice_of(F.abs(eta), ETA_SLICES).alias("slice")))
    return df.withColumn("_s", F.explode(both)).where("_s.slice is not null").select(*df.columns, "_s.axis", "_s.slice")


def rank_table(df: DataFrame, column: str, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, column, name): ranks from 1 of the distinct values, ties by their mean."""
    counts = df.groupBy(*by, column).agg(F.count("*").alias("_n"))
    run = running_sums(counts, column, {"_below": "_n"}, by, inclusive=False)
    return run.select(*by, column, (F.col("_below") + (F.col("_n") + 1) / 2).alias(name))


def spearman(df: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """(left, right, rho): rank correlation of every pair of columns, over the rows that have all of them."""
    columns = list(dict.fromkeys([*left, *right]))
    rows = stored(df.select(*columns).where(" and ".join(f"`{c}` is not null" for c in columns)))
    ranked = rows
    for c in columns:
        table = stored(rank_table(rows, c, f"_r_{c}"))  # of the plain rows, so that joins don't nest
        few = table.limit(SMALL + 1).count() <= SMALL
        ranked = ranked.join(F.broadcast(table) if few else table, c)
    cells = [F.corr(f"_r_{a}", f"_r_{b}").alias(f"{a}|{b}") for a in left for b in right]
    row = ranked.agg(*cells)
    pairs = F.array(*(F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"`{a}|{b}`").alias("rho")) for a in left for b in right))
    return row.select(F.explode(pairs).alias("p")).select("p.*")


def best_per_group(rows: DataFrame, by: list[str], value: str, tie: str) -> DataFrame:
    """The row with the largest absolute value of each group, ties by name."""
    order = Window.partitionBy(*by).orderBy(F.abs(value).desc(), tie)
    return rows.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def class_summary(df: DataFrame, value: str, by: list[str], sample: bool = True) -> DataFrame:
    """Count, mean, deviation, median and the central 68 % bounds of a column."""
    std = F.stddev_samp(value) if sample else F.stddev_pop(value)
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), std.alias("std"))
    out = out.join(quantiles(df, value, [0.16, 0.5, 0.84], tuple(by)).drop("n"), by, "left")
    return out.select(*by, "n", "mean", "std", *(F.col("q")[k].alias(c) for k, c in enumerate(("q16", "median", "q84"))))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, by: list[str]) -> DataFrame:
    """Density in equal bins (the last one closed), normalized within ``by``; rows outside are left out."""
    width = (high - low) / bins
    inside = df.where(F.col(value).between(low, high))
    k = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    counts = inside.groupBy(*by, k.alias("bin")).agg(F.count("*").alias("n"))
    total = inside.groupBy(*by).agg(F.count("*").alias("_t"))
    return counts.join(total, by).select(*by, "bin", "n", (F.col("n") / (F.col("_t") * width)).alias("density"))


def histogram_2d(df: DataFrame, x: str, y: str, x_range: tuple[float, float], y_range: tuple[float, float], bins: int) -> DataFrame:
    """Counts (bx, by, n) of a square grid; rows outside are left out."""

    def at(c: str, r: tuple[float, float]) -> Column:
        return F.least(F.floor((F.col(c) - r[0]) / ((r[1] - r[0]) / bins)), F.lit(bins - 1)).cast("int")

    inside = df.where(F.col(x).between(*x_range) & F.col(y).between(*y_range))
    return inside.groupBy(at(x, x_range).alias("bx"), at(y, y_range).alias("by")).agg(F.count("*").alias("n"))


def smoothed(grid: DataFrame, bins: int, sigma: float = 1.0, reach: int = 3) -> DataFrame:
    """A Gaussian smoothing of a grid (bx, by, n) of ``bins`` squared cells, edges repeated."""
    import math

    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    w = [v / sum(w) for v in w]

    def along(g: DataFrame, axis: str, other: str) -> DataFrame:
        # A cell k reads its neighbours clamped to the grid: cell i is read by k once for each offset that leads to it.
        shifts = F.array(*(F.struct(F.lit(k - reach).alias("d"), F.lit(v).alias("w")) for k, v in enumerate(w)))
        cells = grid.sparkSession.range(bins).select(F.col("id").cast("int").alias("k"), F.explode(shifts).alias("s"))
        reads = cells.select("k", F.least(F.greatest(F.col("k") + F.col("s.d"), F.lit(0)), F.lit(bins - 1)).alias(axis), F.col("s.w").alias("w"))
        out = g.join(F.broadcast(reads), axis).groupBy(F.col("k").alias(axis), other).agg(F.sum(F.col("n") * F.col("w")).alias("n"))
        return out.select("bx", "by", "n")

    return along(along(grid, "bx", "by"), "by", "bx")


def enclosed_level(grid: DataFrame, share: float) -> DataFrame:
    """The count of the cell at which the largest cells first hold ``share`` of all."""
    order = Window.orderBy(F.col("n").desc(), "bx", "by")
    run = grid.select("n", F.sum("n").over(order).alias("run"), F.sum("n").over(Window.partitionBy()).alias("total"))
    return run.where(F.col("run") >= share * F.col("total")).agg(F.max("n").alias("level"))


def enough_points(df: DataFrame, order: str, most: int = 2400) -> DataFrame:
    """At most ``most`` rows at evenly spaced places of the order, whose values are distinct."""
    n = df.count()
    if n <= most:
        return df
    ranked = running_sums(df.withColumn("_one", F.lit(1)), order, {"_k": "_one"}, inclusive=False)
    step = (n - 1) / (most - 1)
    place = F.round(F.round(F.col("_k") / step) * step)
    return ranked.where(F.col("_k") == place).select(*df.columns)


def visible(curve: DataFrame, least: float = 0.45) -> DataFrame:
    """Points of ROC curves that a figure shows: efficiencies from ``least`` on, with a finite rejection."""
    return curve.where((F.col("tpr") >= least) & ~F.col("censored"))


def score_validity(df: DataFrame, by: tuple[str, ...] = ("method",)) -> DataFrame:
    """(by, n, n_invalid): scores that are null, not finite or outside [0, 1]."""
    bad = ~finite(F.col("score")) | ~F.col("score").between(0, 1)
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.coalesce(bad, F.lit(True)).cast("long")).alias("n_invalid"))


def score_shift(rows: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """One row: number, 95 % quantile and mean of the change between two scores of a row; null if either is.

    The changes are written once; the quantile counts only the values next to it.
    """
    d = stored(rows.select(F.abs(F.col(before) - F.col(after)).alias("d")))
    p95 = column_quantiles(d, {"d": F.col("d")}, [0.95])["d"][0]
    return d.agg(F.count("d").alias("n"), F.when(F.count("d") > 0, F.lit(p95)).alias("p95_shift"), F.avg("d").alias("mean_shift"))


def dropout_shift(before: DataFrame, after: DataFrame, key: str = "jet", score: str = "score") -> DataFrame:
    """``score_shift`` of the scores of two tables: the change of a score when tracks are dropped."""
    return score_shift(before.select(key, F.col(score).alias("before")).join(after.select(key, F.col(score).alias("after")), key))
