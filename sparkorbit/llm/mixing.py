"""Mixing sources to target weights by entropy balancing.

Sources, ordered by code point (null last), carry the weights 3, 1, 2, repeating.
They share 150 % of all words by weight; a target stops at twice its source's
words and the excess is shared again among the others.

Document rates minimise the relative entropy sum_i b_i (w_i ln w_i - w_i) under
0 <= w_i <= 2 and one constraint for each source, sum_i size_i w_i = target, with
b_i = size_i / x_i.  The dual has one multiplier for each source and the rates
are tilted exponentially: w_i = min(2, exp(lambda_s x_i)), where
x_i = (size_i / mean size of the source) ** tilt.  Newton steps, kept inside a
shrinking bracket, run over the counts of (source, size).

Rates become copies by sequential Poisson rounding: each document has floor(w_i)
copies, and those of the smallest u_i / (w_i - floor(w_i)), u_i a hash of the
document, get one more as long as the source's target is not passed; what is left
is filled the same way with documents that still fit, and at last with second copies
of documents that have one, until every source is near its target or nothing fits.
Rows that are equal in id, text and source are told apart by their number among
them, which enters u_i.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import checked_broadcast, discard, materialize, text_of

WEIGHTS = (3, 1, 2)
SHARE, LIMIT = 1.5, 2
TILT = 0.25
NEWTON_STEPS, TOLERANCE = 40, 1e-9
#: A source within this share of its target is filled no further.
NEAR = 0.002
#: Thresholds are found digit by digit, of so many bits, until the rows of a digit are few enough to be ordered.
BITS, DIGIT, RUN = 48, 6, 20_000
#: Equal rows that one row of an intermediate table stands for, at most.
SPREAD = 4096
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, share: float = SHARE, limit: float = LIMIT, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(sid, source, source_size, target) from rows of (source, size)."""
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    total = materialize(total.withColumn("sid", rank), "sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(limit))
    total = total.withColumn("weight", weight.cast("double")).withColumn("cap", cap)
    # In the order of cap / weight the sources that stop come first; the level is what is left for each unit of weight.
    order = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = total.agg(F.sum("source_size").cast("double") * share).first()[0] or 0.0
    level = (F.lit(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    some = total.withColumn("level", level).where(F.col("weight") * F.col("level") < F.col("cap"))
    level = F.lit(some.agg(F.min_by("level", F.struct(F.col("cap") / F.col("weight"), "sid"))).first()[0]).cast("double")
    return total.select("sid", "source", "source_size", F.coalesce(F.least("cap", F.col("weight") * level), F.col("cap")).alias("target"))


def _rate(size: Column, limit: float) -> Column:
    tilted = F.exp(F.col("lam") * F.pow(size / F.col("mean"), F.lit(TILT)))
    return F.when(size == 0, F.lit(1.0)).when(F.col("full"), F.lit(float(limit))).otherwise(F.least(F.lit(float(limit)), tilted))


def solve_tilts(counts: DataFrame, targets: DataFrame, limit: float = LIMIT) -> DataFrame:
    """``targets`` with the multiplier ``lam``, the ``mean`` size and ``full`` (every rate is the limit)."""
    some = counts.where("size > 0")
    mean = some.groupBy("sid").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), F.min("size").alias("least"))
    state = targets.join(mean, "sid", "left").withColumn("mean", F.coalesce("mean", F.lit(1.0)))
    smallest = F.pow(F.coalesce("least", F.lit(1)) / F.col("mean"), F.lit(TILT))
    full = F.col("target") >= F.col("source_size") * F.lit(limit * (1 - 1e-12))
    begin = F.when((F.col("source_size") > 0) & (F.col("target") > 0), F.ln(F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    state = state.select("sid", "source", "source_size", "target", "mean", full.alias("full"), begin.alias("lam"), (F.lit(-60.0) / smallest).alias("lo"), (F.lit(0.7) / smallest).alias("hi"), F.lit(1.0).alias("off"))
    state = had = materialize(state, "tilts")
    x = F.pow(F.col("size") / F.col("mean"), F.lit(TILT))
    words = F.col("n") * F.col("size")
    for _ in range(NEWTON_STEPS):
        tilted = F.exp(F.col("lam") * x)
        sums = some.join(checked_broadcast(state.where("not full")), "sid").groupBy("sid").agg(F.sum(words * F.least(F.lit(float(limit)), tilted)).alias("got"), F.sum(F.when(tilted < limit, words * x * tilted)).alias("slope"))
        state = state.join(sums, "sid", "left")
        gap = F.coalesce(F.col("got") - F.col("target"), F.lit(0.0))
        lo, hi = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")), F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        step = F.col("lam") - gap / F.nullif(F.col("slope"), F.lit(0.0))
        state = state.select("sid", "source", "source_size", "target", "mean", "full", F.col("lam").alias("was"), step.alias("step"), lo.alias("lo"), hi.alias("hi"), (F.abs(gap) / F.greatest("target", F.lit(1.0))).alias("off"))
        inside = (F.col("step") > F.col("lo")) & (F.col("step") < F.col("hi"))
        lam = F.when(F.col("off") <= TOLERANCE, F.col("was")).when(F.coalesce(inside, F.lit(False)), F.col("step")).otherwise((F.col("lo") + F.col("hi")) / 2)
        was, state = had, materialize(state.select("sid", "source", "source_size", "target", "mean", "full", lam.alias("lam"), "lo", "hi", "off"), "tilts")
        had = state
        discard(was)
        if not state.where(F.col("off") > TOLERANCE).limit(1).count():
            break
    # Sums of doubles differ by their order in the last digits.
    return state.select("sid", "source", "source_size", "target", "mean", "full", F.round("lam", 10).alias("lam"))


def _place(v: Column) -> Column:
    """A whole number of ``BITS`` bits in the order of v, which is 0 or more."""
    return F.least(F.floor(v / (1 + v) * (1 << BITS)), F.lit((1 << BITS) - 1))


def _thresholds(rows: DataFrame, need: DataFrame) -> DataFrame:
    """(sid, start, upto, used): what stays within ``need`` in the order of v, of rows (sid, v, size).

    That is all rows whose place is below ``start``, and values up to ``upto``.  Sums
    of the next digit of the places find the digit in which the need ends; when it
    has few rows, or no digit is left, those are ordered.
    """
    rows = rows.select("sid", "v", "size", _place(F.col("v")).alias("place"))
    ends = need.select("sid", "need", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    for shift in range(BITS - DIGIT, -1, -DIGIT):
        inner = rows.join(checked_broadcast(ends.where("prefix is not null")), "sid").where(F.shiftright("place", shift + DIGIT) == F.col("prefix"))
        sums = inner.groupBy("sid", F.shiftright("place", shift).alias("digit")).agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.first("need").alias("need"), F.first("below").alias("below"))
        run = F.col("below") + F.sum("words").over(Window.partitionBy("sid").orderBy("digit"))  # of 64 rows a source
        sums = sums.withColumn("run", run)
        over = F.min(F.when(F.col("run") > F.col("need"), F.struct("digit", "n", (F.col("run") - F.col("words")).alias("below"))))
        sums = sums.groupBy("sid").agg(over.alias("over"), F.max("run").alias("all"))
        ends = ends.select("sid", "need", F.col("below").alias("had")).join(sums, "sid", "left")
        below = F.coalesce("over.below", "all", "had")
        ends = materialize(ends.select("sid", "need", F.col("over.digit").alias("prefix"), below.alias("below"), F.col("over.n").alias("n")), "ends")
        if (ends.agg(F.max("n")).first()[0] or 0) <= RUN:
            break
    start = F.when(F.col("prefix").isNull(), F.lit(1 << BITS)).otherwise(F.shiftleft("prefix", shift))
    ends = ends.withColumn("start", start)
    inner = rows.join(checked_broadcast(ends.where("prefix is not null")), "sid").where(F.shiftright("place", shift) == F.col("prefix"))
    inner = inner.withColumn("run", F.col("below") + F.sum("size").over(Window.partitionBy("sid").orderBy("v"))).where("run <= need")
    inner = inner.groupBy("sid").agg(F.max("v").alias("upto"), F.max("run").alias("run"))
    return ends.join(inner, "sid", "left").select("sid", "start", F.coalesce("upto", F.lit(-1.0)).alias("upto"), F.coalesce("run", "below").alias("used"))


def _taken(fills: str, order: Column, size: Column) -> Column:
    """Whether one of the fills takes a row of this order value and size."""
    return F.exists(fills, lambda f: (size <= f["room"]) & ((_place(order) < f["start"]) | (order <= f["upto"])))


def _unit(key: Column) -> Column:
    return F.shiftrightunsigned(key, 11) / F.lit(float(1 << 53))


def _numbered(rows: DataFrame, repeats: DataFrame) -> DataFrame:
    """The rows whose (sid, k) is repeated, with ``nth``, a number from 0 among equal ones.

    Numbers within the pieces that tasks read come first, then counts of the pieces
    before, so equal rows are spread over as many tasks as read them.
    """
    same = rows.join(checked_broadcast(repeats.select("sid", "k")), ["sid", "k"], "left_semi")
    same = materialize(same.withColumn("mid", F.monotonically_increasing_id()), "repeated").withColumn("piece", F.shiftright("mid", 33))
    keys = ["sid", "k", "piece"]
    counts = same.groupBy(*keys).agg(F.count("*").alias("n"))
    before = Window.partitionBy("sid", "k").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    first = materialize(counts.select(*keys, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "pieces")
    own = F.row_number().over(Window.partitionBy(*keys).orderBy("mid")) - 1
    return same.withColumn("own", own).join(checked_broadcast(first), keys).withColumn("nth", F.col("first") + F.col("own")).drop("first", "own", "mid", "piece")


MADE = ["size", "source_size", "target", "rate", "copies", "taken"]


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, limit: int) -> DataFrame:
    """``row``, a struct of the columns of ``docs``, and the columns ``MADE``."""
    size = F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long")
    key = F.xxhash64(id_col, text_col, F.lit("mix"))
    slim = materialize(docs.select(F.col(source_col).alias("source"), size.alias("size"), key.alias("k")), "sizes")
    targets = source_targets(slim)
    keys = materialize(targets.select(F.col("source").alias("of"), "sid"), "source-keys")
    keys = checked_broadcast(keys)
    slim = slim.join(keys, slim["source"].eqNullSafe(keys["of"])).select("sid", "size", "k")
    counts = materialize(slim.groupBy("sid", "size").agg(F.count("*").alias("n")), "counts")
    state = solve_tilts(counts, targets, limit)

    repeats = materialize(slim.where("size > 0").groupBy("sid", "k").agg(F.count("*").alias("n"), F.first("size").alias("size")).where("n > 1"), "repeats")
    repeated = repeats.limit(1).count() > 0
    nth = lambda k, n: F.xxhash64(k, n)
    slim = slim.where("size > 0")
    if repeated:
        some = repeats.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(SPREAD).cast("long")))).repartition("sid", "k", "first")
        some = some.withColumn("nth", F.explode(F.sequence("first", F.least(F.col("first") + SPREAD, F.col("n")) - 1)))
        slim = slim.join(checked_broadcast(repeats.select("sid", "k")), ["sid", "k"], "left_anti").select("sid", "size", "k").union(some.select("sid", "size", nth("k", "nth")))

    rate = _rate(F.col("size"), limit)
    part = rate - F.floor(rate)
    u = _unit(F.col("k"))
    rows = slim.join(checked_broadcast(state), "sid").select("sid", "size", u.alias("u"), F.floor(rate).alias("whole"), F.when(part > 0, u / part).alias("v"))
    rows = materialize(rows, "rounding")
    sure = counts.join(state, "sid").groupBy("sid").agg(F.sum(F.col("n") * F.col("size") * F.floor(rate)).alias("sure"))
    none = F.array().cast("array<struct<room:double,start:bigint,upto:double>>")
    state = state.join(sure, "sid").withColumn("need", F.col("target") - F.col("sure")).withColumn("up", none).withColumn("again", none)
    state = materialize(state, "state")
    for fills in ("up", "again"):  # second copies only where the rates leave a target unmet
        while state.where(F.col("need") > NEAR * F.col("target")).limit(1).count():
            fits = rows.join(checked_broadcast(state), "sid").where(F.col("size") <= F.col("need"))
            up = F.col("v").isNotNull() & _taken("up", F.col("v"), F.col("size"))
            if fills == "up":
                fits = fits.where(F.col("v").isNotNull() & ~up).select("sid", "v", "size")
            else:
                again = _taken("again", F.col("u"), F.col("size"))
                fits = fits.where((F.col("whole") + up.cast("int") < limit) & ~again).select("sid", F.col("u").alias("v"), "size")
            ends = materialize(_thresholds(fits, state.select("sid", "need")), "fill")
            if not ends.agg(F.sum("used")).first()[0]:
                break
            more = F.array(F.struct(F.col("need").alias("room"), "start", "upto"))
            new = state.join(ends, "sid").withColumn(fills, F.concat(fills, more)).withColumn("need", F.col("need") - F.col("used")).select(state.columns)
            was, state = state, materialize(new, "state")
            discard(was, ends)

    state = state.withColumnRenamed("source", "of").drop("need", "sure")
    out = docs.select(F.struct(*docs.columns).alias("row"), F.col(source_col).alias("source"), size.alias("size"), key.alias("k"))
    out = out.join(checked_broadcast(state), out["source"].eqNullSafe(F.col("of")))
    if repeated:
        twice = _numbered(out, repeats)
        out = out.join(checked_broadcast(repeats.select("sid", "k")), ["sid", "k"], "left_anti").select(out.columns)
        out = out.unionByName(twice.withColumn("k", nth("k", "nth")).select(out.columns))
    out = out.withColumn("rate", rate).withColumn("u", u).withColumn("v", F.when((part > 0) & (F.col("size") > 0), u / part))
    more = F.when(F.col("v").isNotNull() & _taken("up", F.col("v"), F.col("size")), 1).otherwise(0) + F.when((F.col("size") > 0) & (F.floor("rate") < limit) & _taken("again", F.col("u"), F.col("size")), 1).otherwise(0)
    out = out.withColumn("copies", F.least(F.floor("rate") + more, F.lit(limit)).cast("int")).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select("row", *MADE)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", limit: int = LIMIT) -> DataFrame:
    """The rows of ``docs`` with ``size``, ``source_size``, ``target``, ``rate``, ``copies`` and ``taken``.

    ``size`` counts the words of the whole text (null: 0); ``copies`` is 0, 1 or 2
    and ``taken`` = copies * size.  Documents without words have one copy.  The
    copies depend on id, text and source alone: reruns agree.  Of rows that are equal
    in all three, as many have a second copy or none as the rate asks for; which ones
    depends on their order in the table.  Null sources are a source, the last one.
    Columns of these names are replaced; an empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c.lower() not in MADE]
    out = _mixed(docs, id_col, text_col, source_col, limit)
    return out.select(*(F.col("row")[c].alias(c) for c in kept), *MADE)


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", limit: int = LIMIT) -> DataFrame:
    """Each row of ``docs`` as often as the mix has it (see ``mix_sources``), columns unchanged whatever their names."""
    out = _mixed(docs, id_col, text_col, source_col, limit).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
