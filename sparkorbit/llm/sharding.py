"""Sharding by balanced label propagation, with the numbers of rows held at most one apart.

Documents start in shards dealt by a hash order.  In each round every group of
linked documents names the shard that holds most of it (of those that hold
documents without links) and its members in shards that hold no more ask to move
there.  Requests from shard i to j are granted up to a quota: what j sends back to
i, by requests of its own or by documents without links, all of which are divided
among the shards that ask.  So every pair of shards swaps equal numbers of rows and
the numbers of rows never change, however large a group is.  If nothing is granted,
the groups name any shard for a round, where only their own requests make room.

Rounds end when nothing is granted either way.  They do end: a group gathers in one
shard a round, from shards that hold no more of it, so the sum of the squares of
what each shard holds of each group grows with every request granted.

Built from DataFrame functions alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import checked_broadcast, heavy_keys, is_small, materialize, text_of

SHARDS = 16
#: Rows that one window task orders, about.
RUN = 20_000


def gapless_rank(df: DataFrame, keys: list[str], rows: int, name: str = "rank") -> DataFrame:
    """``df`` with a rank from 0 within the keys, in the order of the hash ``o`` (ties by ``rid``).

    Two levels: ranges of the hash get offsets from their counts, so no task orders
    more than one range of a key.  Rows that are equal have different hashes.
    """
    bits = max(6, (max(1, rows // RUN) - 1).bit_length())
    binned = df.withColumn("range", F.shiftrightunsigned(F.col("o").bitwiseXOR(F.lit(-(1 << 63))), 64 - bits))
    by = [*keys, "range"]
    counts = binned.groupBy(*by).agg(F.count("*").alias("n"))
    before = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(counts.select(*by, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")), "offsets")
    inner = F.row_number().over(Window.partitionBy(*by).orderBy("o", "rid")) - 1
    return binned.withColumn("inner", inner).join(checked_broadcast(offsets), by).withColumn(name, F.col("offset") + F.col("inner")).drop("inner", "offset", "range")


def _numbered(slim: DataFrame) -> DataFrame:
    """``slim`` with ``nth``, a number from 0 among rows of equal ``same``.

    Numbers within the pieces that tasks read come first, then counts of the pieces
    before, so equal rows are spread over as many tasks as read them.
    """
    repeated = materialize(slim.groupBy("same").agg(F.count("*").alias("n")).where("n > 1").select("same"), "repeated")
    if not repeated.limit(1).count():
        return slim.withColumn("nth", F.lit(0).cast("long"))
    pieces = slim.withColumn("piece", F.shiftright("rid", 33)).withColumn("bit", F.pmod("rid", F.lit(64)).cast("int"))
    repeated = checked_broadcast(repeated)
    rows = materialize(pieces.join(repeated, "same", "left_semi"), "equal")
    by = ["same", "piece", "bit"]
    before = Window.partitionBy("same").orderBy("piece", "bit").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy(*by).agg(F.count("*").alias("n")).select(*by, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = F.row_number().over(Window.partitionBy(*by).orderBy("rid")) - 1
    rows = rows.withColumn("own", own).join(checked_broadcast(materialize(first, "pieces")), by).withColumn("nth", F.col("first") + F.col("own"))
    return slim.join(repeated, "same", "left_anti").withColumn("nth", F.lit(0).cast("long")).unionByName(rows.select(*slim.columns, "nth"))


def _left(rows: DataFrame, values: DataFrame, keys: list[str], heavy: DataFrame | None) -> DataFrame:
    """A left join on ``g`` and more; where ``values`` is too large to broadcast, rows of heavy groups stay where they are."""
    if heavy is None or is_small(values):
        return rows.join(checked_broadcast(values), keys, "left")
    light = rows.join(F.broadcast(heavy), "g", "left_anti").join(values, keys, "left")
    hot = values.join(F.broadcast(heavy), "g", "left_semi")  # a row for each heavy group and shard at most
    return light.unionByName(rows.join(F.broadcast(heavy), "g", "left_semi").join(F.broadcast(hot), keys, "left"))


def _targets(linked: DataFrame, free: DataFrame) -> DataFrame:
    """(g, shard, target): target holds most of the group among the shards of ``free`` (ties by hash), shard no more."""
    held = linked.groupBy("g", "shard").agg(F.count("*").alias("held"))
    able = held.join(F.broadcast(free), "shard")
    best = F.max_by(F.struct("shard", "held"), F.struct("held", F.xxhash64("g", "shard")))
    best = able.groupBy("g").agg(best.alias("best")).select("g", F.col("best.shard").alias("target"), F.col("best.held").alias("most"))
    return held.join(best, "g").where((F.col("shard") != F.col("target")) & (F.col("most") >= F.col("held"))).select("g", "shard", "target")


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot, g): every row of ``docs`` in one of the shards.

    Rows of equal texts (null counts as empty) are linked; ``g`` names their group.
    ``size`` is the UTF-8 length plus 1, ``slot`` counts from 0 without gaps within
    the shard.  Numbers of rows differ by one at most; equal rows are rows of their
    own.  An empty table gives an empty result.
    """
    text = text_of(text_col)
    slim = docs.select(F.col(id_col).alias("sid"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"), F.xxhash64(text).alias("x"))
    slim = slim.withColumn("g", F.xxhash64("x", "crc", "size")).withColumn("same", F.xxhash64("sid", "x", "crc"))
    slim = materialize(slim.withColumn("rid", F.monotonically_increasing_id()), "slim")
    rows = slim.count()
    groups = materialize(slim.groupBy("g").agg(F.count("*").alias("n")).where("n > 1"), "groups")
    heavy = heavy_keys(groups, ["g"])
    slim = _numbered(slim).withColumn("o", F.xxhash64("same", "nth")).drop("same", "nth")
    slim = _left(slim, groups.select("g", F.lit(True).alias("linked")), ["g"], heavy).withColumn("linked", F.coalesce("linked", F.lit(False)))
    state = gapless_rank(slim, [], rows, "deal").withColumn("shard", (F.col("deal") % shards).cast("int")).drop("deal", "x")
    state = materialize(state, "state")
    columns = state.columns

    every = state.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    every_shard = False  # else only those with free rows are named
    while True:
        free = every.join(state.where("not linked").groupBy("shard").agg(F.count("*").alias("free")), "shard", "left").na.fill(0)
        free = materialize(free, "free")
        asks = materialize(_targets(state.where("linked"), free if every_shard else free.where("free > 0")), "asks")
        linked = materialize(_left(state.where("linked"), asks, ["g", "shard"], heavy), "linked")
        asked = linked.where("target is not null")
        quota = _quotas(asked, free)
        if not quota.where("granted > 0").limit(1).count():
            if every_shard:
                break
            every_shard = True
            continue
        every_shard = False
        moved = gapless_rank(asked, ["shard", "target"], rows).join(F.broadcast(quota.select("shard", "target", "granted")), ["shard", "target"])
        moved = moved.withColumn("shard", F.when(F.col("rank") < F.col("granted"), F.col("target")).otherwise(F.col("shard")))
        back = quota.where("ballast > 0")
        before = Window.partitionBy("target").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        back = back.withColumn("first", F.coalesce(F.sum("ballast").over(before), F.lit(0)))
        back = back.select(F.col("target").alias("at"), F.col("shard").alias("to"), "first", (F.col("first") + F.col("ballast")).alias("end"))
        loose = gapless_rank(state.where("not linked"), ["shard"], rows)
        loose = loose.join(F.broadcast(back), (F.col("shard") == F.col("at")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")), "left")
        loose = loose.withColumn("shard", F.coalesce("to", "shard"))
        state = materialize(linked.where("target is null").select(columns).union(moved.select(columns)).union(loose.select(columns)), "state")

    out = gapless_rank(state, ["shard"], rows, "slot")
    return out.select(F.col("sid").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", F.col("slot").cast("long").alias("slot"), "g")


def _quotas(asked: DataFrame, free: DataFrame) -> DataFrame:
    """(shard, target, granted, ballast) of at most shards^2 rows: requests granted, free rows sent back."""
    ask = materialize(asked.groupBy("shard", "target").agg(F.count("*").alias("ask")), "ask")
    back = ask.select(F.col("target").alias("shard"), F.col("shard").alias("target"), F.col("ask").alias("back"))
    pairs = ask.join(back, ["shard", "target"], "left").na.fill(0).join(free.select(F.col("shard").alias("target"), "free"), "target")
    over: Column = F.greatest(F.lit(0), F.col("ask") - F.col("back"))
    before = Window.partitionBy("target").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    pairs = pairs.withColumn("over", over).withColumn("first", F.coalesce(F.sum("over").over(before), F.lit(0)))
    ballast = F.greatest(F.lit(0), F.least(F.col("over"), F.col("free") - F.col("first")))
    return materialize(pairs.select("shard", "target", (F.least("ask", "back") + ballast).alias("granted"), ballast.alias("ballast")), "quota")
