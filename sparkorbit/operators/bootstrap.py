"""Bootstrap draws with replacement: multiplicities of events, or of rows within classes, join the rows of all methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prefix import quantiles
from ..functions.scalars import clip, splitmix64, unsigned_mod
from ..functions.stored import stored
from .evaluate import roc_auc
from .roles import class_counts, ranked

#: Draws that one row of the table of replicates stands for.
SPREAD = 10_000


def draws(spark_df: DataFrame, replicates: int, size: int, among: int, seed: int, first: int = 0) -> DataFrame:
    """(replicate, _r, w): how often each replicate draws the ranks 1 .. among in ``size`` draws with replacement."""
    if not 0 < among < 1 << 31:
        raise ValueError("draws are among 1 to 2^31 - 1 ranks")
    spark = spark_df.sparkSession
    runs = spark.range(first, first + replicates).withColumnRenamed("id", "replicate")
    part = runs.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"), F.lit(SPREAD).cast("long"))))
    part = part.withColumn("t", F.explode(F.sequence("at", F.least(F.col("at") + SPREAD, F.lit(size)) - 1)))
    index = unsigned_mod(splitmix64(F.col("replicate") * (1 << 40) + F.col("t"), seed), among) + 1
    return part.select(F.col("replicate").cast("int").alias("replicate"), index.alias("_r")).groupBy("replicate", "_r").agg(F.count("*").alias("w"))


def drawn_rows(df: DataFrame, replicates: int, event: str, label: str = "y", attempts: int = 20) -> DataFrame:
    """Rows with replicate and w, the times that the replicate draws their event: as many draws as there are events.

    A replicate without one of the classes is drawn again, ``attempts`` times at most.
    """
    events = stored(ranked(df.select(event).distinct().withColumn("_one", F.lit(1)), event, ["_one"], 29).drop("_one"))
    n = events.count()
    if not n:
        return df.withColumns({"replicate": F.lit(0), "w": F.lit(1).cast("long")}).limit(0)
    classes = stored(df.groupBy(event).agg(F.max(label).alias("_1"), F.min(label).alias("_0")).join(events, event).select("_r", "_0", "_1"))
    found, wanted = None, {r: r for r in range(replicates)}  # the draw that stands for a replicate
    for k in range(attempts + 1):
        now = None
        for low, high in _runs(sorted(wanted)):
            part = draws(df, high - low, n, n, 31, low)
            now = part if now is None else now.unionByName(part)
        now = stored(now)
        held = now.join(classes, "_r").groupBy("replicate").agg(F.max("_1").alias("_1"), F.min("_0").alias("_0"))
        bad = sorted(r["replicate"] for r in held.where("_1 = 0 or _0 = 1").collect())  # a row for each replicate
        names = F.create_map(*(F.lit(v) for pair in wanted.items() for v in pair))
        good = (now.where(~F.col("replicate").isin(*bad)) if bad else now).withColumn("replicate", names[F.col("replicate")].cast("int"))
        found = good if found is None else found.unionByName(good)
        wanted = {(k + 1) * replicates + wanted[b]: wanted[b] for b in bad}
        if not wanted:
            return df.join(events, event).join(found, "_r").drop("_r")
    raise ValueError("replicates lack a class again and again")


def _runs(numbers: list[int]) -> list[tuple[int, int]]:
    """Ranges [low, high) of consecutive numbers."""
    out: list[tuple[int, int]] = []
    for n in numbers:
        if out and out[-1][1] == n:
            out[-1] = (out[-1][0], n + 1)
        else:
            out.append((n, n + 1))
    return out


def event_bootstrap_auc(df: DataFrame, replicates: int, event: str = "event_number") -> DataFrame:
    """(replicate, method, auc): every event weighs as often as its replicate draws it."""
    return roc_auc(drawn_rows(df, replicates, event), ("replicate", "method"), "w").select("replicate", "method", "auc")


def event_bootstrap_metrics(df: DataFrame, replicates: int, event: str = "event_number", eps: float = 1e-7) -> DataFrame:
    """(replicate, method, log_loss, accuracy, balanced_accuracy) at one half, weighted by the draws."""
    out = weighted_metrics(drawn_rows(df, replicates, event), eps)
    return out.select("replicate", "method", "log_loss", "accuracy", "balanced_accuracy")


def weighted_metrics(drawn: DataFrame, eps: float = 1e-7) -> DataFrame:
    """(replicate, method, auc, log_loss, accuracy, balanced_accuracy) of rows with weight w."""
    w, y, p = F.col("w"), F.col("y"), clip(F.col("score"), eps, 1 - eps)
    hit = ((F.col("score") >= 0.5).cast("int") == y).cast("int")
    rate = lambda c: F.sum(F.when(c, w * hit)) / F.sum(F.when(c, w))
    drawn = stored(drawn.select("replicate", "method", "y", "score", "w"))
    out = drawn.groupBy("replicate", "method").agg((F.sum(w * -(y * F.ln(p) + (1 - y) * F.ln(1 - p))) / F.sum(w)).alias("log_loss"), (F.sum(w * hit) / F.sum(w)).alias("accuracy"), ((rate(y == 1) + rate(y == 0)) / 2).alias("balanced_accuracy"))
    return roc_auc(drawn, ("replicate", "method"), "w").select("replicate", "method", "auc").join(out, ["replicate", "method"])


def class_sizes(counts: dict[int, int], most: int = 50_000) -> dict[int, int]:
    """Rows that a stratified replicate draws of each class: all of them, or ``most`` in the shares of the classes."""
    n = sum(counts.values())
    size = min(n, most) if most > 0 else n
    if size < 2 or not min(counts.values()):
        raise ValueError("a stratified replicate needs both classes")
    zero = min(max(1, round(size * counts[0] / n)), size - 1)
    return {0: zero, 1: size - zero}


def stratified_bootstrap(df: DataFrame, replicates: int, key: str = "source_row", most: int = 50_000, label: str = "y") -> DataFrame:
    """(replicate, method, auc, log_loss, accuracy, balanced_accuracy) of draws with replacement within each class.

    Every replicate has the class sizes of ``class_sizes``; the methods share the rows drawn.
    """
    rows = stored(ranked(df.select(key, label).distinct(), key, [label], 37))
    counts = class_counts(rows, label)
    sizes = class_sizes(counts, most)
    parts = [draws(df, replicates, sizes[c], counts[c], 41 + c).withColumn(label, F.lit(c)) for c in (0, 1)]
    return weighted_metrics(df.join(rows, [key, label]).join(parts[0].unionByName(parts[1]), ["_r", label]))


def interval_table(replicates: DataFrame, level: float = 0.95) -> DataFrame:
    """(method, metric, lower, upper, se) over the replicates of every metric."""
    names = [c for c in replicates.columns if c not in ("replicate", "method")]
    each = F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names))
    rows = replicates.select("method", F.explode(each).alias("m")).select("method", "m.*")
    out = quantiles(rows, "value", [(1 - level) / 2, (1 + level) / 2], ("method", "metric"))
    se = rows.groupBy("method", "metric").agg(F.stddev_samp("value").alias("se"))
    return out.join(se, ["method", "metric"]).select("method", "metric", F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper"), "se")


def bootstrap_summary(replicates: DataFrame, value: str = "auc") -> DataFrame:
    """Standard error and the 68 % and 95 % bounds of each method."""
    q = F.percentile(value, F.array(*map(F.lit, (0.16, 0.84, 0.025, 0.975))))
    out = replicates.groupBy("method").agg(F.stddev_samp(value).alias("se"), q.alias("_q"))
    return out.select("method", "se", *(F.col("_q")[k].alias(c) for k, c in enumerate(("q16", "q84", "q025", "q975"))))


def paired_difference(replicates: DataFrame, reference: str, value: str = "auc") -> DataFrame:
    """Difference to a reference method in the same replicate: mean, bounds, two-sided tail share."""
    base = replicates.where(F.col("method") == reference).select("replicate", F.col(value).alias("_b"))
    diff = replicates.where(F.col("method") != reference).join(base, "replicate").withColumn("d", F.col(value) - F.col("_b"))
    low, high = F.avg((F.col("d") <= 0).cast("int")), F.avg((F.col("d") >= 0).cast("int"))
    q = F.percentile("d", F.array(F.lit(0.025), F.lit(0.975)))
    out = diff.groupBy("method").agg(F.avg("d").alias("mean"), q.alias("_q"), F.least(F.lit(1.0), 2 * F.least(low, high)).alias("p"))
    return out.select("method", "mean", F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"), "p")
