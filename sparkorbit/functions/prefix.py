"""Running sums, ranks and quantiles over any number of rows, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stored import stored

#: Ranges of the order column, each ordered by a task of its own: as many as keep to so many rows, within bounds.
RANGE_ROWS, LEAST_RANGES, MOST_RANGES = 1_000_000, 16, 4096


def range_bin(df: DataFrame, order: str, ranges: int | None = None) -> Column:
    """The range of the order column that a row falls into: its cuts are approximate quantiles."""
    k = ranges or LEAST_RANGES
    cut = lambda k: F.percentile_approx(order, F.array(*(F.lit(i / k) for i in range(1, k))), F.lit(max(1000, 10 * k)))
    row = df.agg(F.count("*").alias("n"), cut(max(2, k)).alias("cuts")).first()
    need = min(MOST_RANGES, -(-row["n"] // RANGE_ROWS))
    if ranges is None and need > k:
        row = df.agg(cut(need).alias("cuts")).first()
    cuts = sorted({float(c) for c in (row["cuts"] or []) if c is not None}) if ranges != 1 else []
    held = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<double>")
    return F.size(F.filter(held, lambda c: c < F.col(order)))


def running_sums(df: DataFrame, order: str, sums: dict[str, str], by: tuple[str, ...] = (), descending: bool = False, inclusive: bool = True, ranges: int | None = None) -> DataFrame:
    """``df``, written once, with, for each ``name: column``, the running sum of the column in the order within ``by``.

    Rows of equal order value are peers and get the same sums; exclusive sums leave
    out the peers.  Two levels: sums of ranges of the order column come first.
    """
    df = stored(df)
    binned = df.withColumn("_bin", range_bin(df, order, ranges))
    totals = binned.groupBy(*by, "_bin").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    way = F.col("_bin").desc() if descending else F.col("_bin").asc()
    before = Window.partitionBy(*by).orderBy(way).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_bin", *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums))
    way = F.col(order).desc() if descending else F.col(order).asc()
    inner = Window.partitionBy(*by, "_bin").orderBy(way).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    peers = Window.partitionBy(*by, "_bin", order)
    run = {n: F.sum(c).over(inner) - (F.lit(0) if inclusive else F.sum(c).over(peers)) for n, c in sums.items()}
    out = binned.select(*df.columns, "_bin", *(v.alias(n) for n, v in run.items()))
    out = out.join(offsets, [*by, "_bin"])
    return out.select(*df.columns, *((F.col(n) + F.col(f"_{n}")).alias(n) for n in sums))


def following(df: DataFrame, order: str, columns: list[str], by: tuple[str, ...] = (), descending: bool = False, ranges: int | None = None) -> DataFrame:
    """``df``, written once, with ``next``: the columns of the row that follows in the order within ``by``, null after the last.

    Order values are distinct within ``by``.  The last row of a range finds the next one
    in the first row of the ranges after it.
    """
    df = stored(df)
    binned = df.withColumn("_bin", range_bin(df, order, ranges))
    held, way = F.struct(*columns), (lambda c: F.col(c).desc() if descending else F.col(c).asc())
    edge = F.max_by if descending else F.min_by
    heads = binned.groupBy(*by, "_bin").agg(edge(held, F.col(order)).alias("_head"))
    heads = heads.select(*by, "_bin", F.lead("_head").over(Window.partitionBy(*by).orderBy(way("_bin"))).alias("_head"))
    inner = F.lead(held).over(Window.partitionBy(*by, "_bin").orderBy(way(order)))
    return binned.withColumn("next", inner).join(heads, [*by, "_bin"]).select(*df.columns, F.coalesce("next", "_head").alias("next"))


def quantiles(df: DataFrame, value: str, shares: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, n, q): linear quantiles ``q``, in the order of ``shares``, of the values that are not null; n of them.

    Values are counted, so no task holds all values of a group.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    run = running_sums(counts, value, {"_upto": "_n"}, by)
    most = run.groupBy(*by).agg(F.max("_upto").alias("_all"))
    rows = run.join(F.broadcast(most), list(by)) if by else run.crossJoin(F.broadcast(most))  # a row for each group
    cols = []
    for p in shares:
        at = F.lit(float(p)) * (F.col("_all") - 1)
        low, high = (F.min(F.when(F.col("_upto") > f(at), F.col(value).cast("double"))) for f in (F.floor, F.ceil))
        cols += [low, high, F.first(at - F.floor(at))]
    out = rows.groupBy(*by).agg(F.first("_all").alias("n"), *(c.alias(f"_{k}") for k, c in enumerate(cols)))
    q = [F.col(f"_{3 * k}") + F.col(f"_{3 * k + 2}") * (F.col(f"_{3 * k + 1}") - F.col(f"_{3 * k}")) for k in range(len(shares))]
    return out.select(*by, "n", F.array(*q).alias("q"))
