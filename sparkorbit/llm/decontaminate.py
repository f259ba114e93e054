"""Benchmark decontamination: size-partitioned MinHash containment search.

The signature of an item of n distinct five-word shingles is its bottom-k MinHash
sketch with k = n - ceil(t * n) + 1: a document that holds a share t of the item's
shingles holds one of any k of them, so no length of document loses an item.

Items are partitioned by size: by the power of two of n, those of fewer than five
words by their width.  A document probes each partition on its own.  It skips those
whose items need more shingles than it has; of its shingle values it keeps those up
to the largest sketch value of the partition whose low bits a sketch of the
partition has, and looks them up among the partition's sketches.  So a partition of
short items, which lets nearly every value pass its cut, costs the others nothing.
Candidates are confirmed by exact containment over the full sets.

Built from DataFrame functions alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import broadcast_by_size, checked_broadcast, fresh, materialize

WIDTH = 5
CONTAINMENT = 0.75
#: Bits that a partition keeps of its sketches: so many for each value, between the bounds.
BITS_PER_VALUE, LEAST_BITS, MOST_BITS = 16, 1 << 10, 1 << 18


def word_array(text: Column) -> Column:
    """Lower-cased words of a text."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")


def shingle_values(words: Column, widths: list[int]) -> Column:
    """64-bit values of the runs of so many words, repeats included."""

    def runs(w: Column, k: int) -> Column:
        heads = F.slice(w, 1, F.greatest(F.size(w) - (k - 1), F.lit(0)))
        return F.transform(heads, lambda x, i: F.xxhash64(x, *(w[i + j] for j in range(1, k))))

    # The lambda binds the words, which are then split only once.
    return F.transform(F.array(words), lambda w: F.concat(*(runs(w, k) for k in widths)))[0]


def item_index(items: DataFrame, id_col: str, text_col: str, containment: float) -> DataFrame:
    """(ik, item_id, words, n, need, part, shingles, sketch) of the items that have words."""
    words = items.select(F.col(id_col).alias("item_id"), word_array(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    count = F.size("w")
    full = shingle_values(F.col("w"), [WIDTH])
    short = F.xxhash64(*(F.get("w", F.lit(j)) for j in range(WIDTH - 1)))
    for k in range(1, WIDTH - 1):
        short = F.when(count == k, F.xxhash64(*(F.get("w", F.lit(j)) for j in range(k)))).otherwise(short)
    sets = words.select("item_id", F.least(count, F.lit(WIDTH)).alias("words"), F.array_sort(F.array_distinct(F.when(count < WIDTH, F.array(short)).otherwise(full))).alias("shingles"))
    sets = sets.withColumn("n", F.size("shingles")).withColumn("need", F.ceil(F.col("n") * F.lit(containment) - 1e-9).cast("int"))
    part = F.when(F.col("words") < WIDTH, -F.col("words")).otherwise(F.floor(F.log2("n")).cast("int"))
    sets = sets.withColumn("part", part).withColumn("ik", F.monotonically_increasing_id())
    return materialize(sets.withColumn("sketch", F.slice("shingles", 1, F.col("n") - F.col("need") + 1)), "items")


def size_partitions(index: DataFrame) -> list[dict]:
    """For each partition: ``part``, the ``width`` of its shingles, ``least`` (to be held of any item), ``cut``, ``bits`` and the words ``held`` of its bits."""
    stats = index.groupBy("part").agg(F.max("words").alias("width"), F.min("need").alias("least"), F.max(F.element_at("sketch", -1)).alias("cut"), F.sum(F.size("sketch")).alias("values"))
    parts = [r.asDict() for r in stats.orderBy("part").collect()]  # one for each power of two
    for p in parts:
        p["bits"] = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_VALUE * p["values"] - 1).bit_length()))
    bits = F.create_map(*(F.lit(v) for p in parts for v in (p["part"], p["bits"] - 1)))
    at = index.select("part", F.explode("sketch").alias("h")).select("part", F.col("h").bitwiseAND(bits[F.col("part")].cast("long")).alias("at")) if parts else None
    words = at.groupBy("part", F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("mask")).collect() if parts else []
    for p in parts:
        held = [0] * (p["bits"] // 64)
        for r in words:
            if r["part"] == p["part"]:
                held[r["word"]] = r["mask"]
        p["held"] = held
    return parts


def probes(words: Column, parts: list[dict]) -> Column:
    """(part, m, h): the values of a document to look up in each partition; m is how many it has of that width."""
    none = F.array().cast("array<struct<part:int,m:int,h:bigint>>")

    def of(values: Column, p: dict) -> Column:
        held = F.expr("array(" + ",".join(f"{w}L" if w != -(1 << 63) else "-9223372036854775807L - 1L" for w in p["held"]) + ")")
        low = lambda h: h.bitwiseAND(F.lit(p["bits"] - 1))
        word = lambda h: F.get(held, F.shiftright(low(h), 6).cast("int"))
        bit = lambda h: F.call_function("shiftrightunsigned", word(h), h.bitwiseAND(F.lit(63)).cast("int"))
        some = F.filter(values, lambda h: (h <= F.lit(p["cut"])) & (bit(h).bitwiseAND(F.lit(1)) == 1))
        rows = F.transform(some, lambda h: F.struct(F.lit(p["part"]).alias("part"), F.size(values).alias("m"), h.alias("h")))
        return F.when(F.size(values) >= p["least"], rows).otherwise(none)

    def of_width(w: Column, width: int) -> Column:
        mine = [p for p in parts if p["width"] == width]
        # The lambdas bind words and values, which are then made only once.
        return F.transform(F.array(shingle_values(w, [width])), lambda v: F.concat(*(of(v, p) for p in mine)))[0]

    widths = sorted({p["width"] for p in parts})
    return F.transform(F.array(words), lambda w: F.concat(none, *(of_width(w, k) for k in widths)))[0]


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """(id, tx, item_id, item_shingles, hits) for every item that a document contains.

    ``hits`` of the ``item_shingles`` distinct shingles stand in the document, a
    share of ``containment`` or more.  ``tx`` is the xxhash64 of the text, which
    tells rows of the same id apart; equal rows give one result.  Null and empty
    texts and items match nothing; an item of fewer than five words is one shingle
    of that width.  A repeated item id reports its largest ``hits``.  Other columns
    are not read, whatever their names.
    """
    index = item_index(items, item_id_col, item_text_col, containment)
    parts = size_partitions(index)
    widths = sorted({WIDTH, *(p["width"] for p in parts)})
    text = docs.select(F.col(id_col).alias("dc_id"), F.col(text_col).alias("dc_text")).withColumn("tx", F.xxhash64("dc_text"))

    sketches = materialize(index.select("ik", "part", "need", F.explode("sketch").alias("h")), "sketches")
    found = candidates(text, parts, sketches)
    found = materialize(found, "candidates")

    wanted = checked_broadcast(found.select(F.col("dc_id").alias("want"), F.col("tx").alias("want_tx")).distinct())
    same = text["dc_id"].eqNullSafe(F.col("want")) & (text["tx"] == F.col("want_tx"))
    sets = text.join(wanted, same, "left_semi").select("dc_id", "tx", F.array_distinct(shingle_values(word_array(F.col("dc_text")), widths)).alias("held"))
    pairs = found.select(F.col("dc_id").alias("want"), F.col("tx").alias("want_tx"), "ik")
    pairs = sets.join(pairs, sets["dc_id"].eqNullSafe(F.col("want")) & (sets["tx"] == F.col("want_tx")))
    both = pairs.join(broadcast_by_size(index.select("ik", "item_id", "n", "need", "shingles"), 8 * F.size("shingles") + 64), "ik")
    both = both.select("dc_id", "tx", "item_id", "n", "need", F.size(F.array_intersect("shingles", "held")).alias("hits")).where("hits >= need")
    return both.groupBy(F.col("dc_id").alias(id_col), "tx", "item_id").agg(F.max("n").alias("item_shingles"), F.max("hits").alias("hits"))


def candidates(text: DataFrame, parts: list[dict], sketches: DataFrame) -> DataFrame:
    """(dc_id, tx, ik): items of which a text holds a sketch value of its partition, and enough shingles for them."""
    low = text.select("dc_id", "tx", F.explode(probes(word_array(F.col("dc_text")), parts)).alias("p")).select("dc_id", "tx", "p.*")
    side = checked_broadcast(sketches.withColumnRenamed("part", "of"))
    return low.join(side, (low["h"] == side["h"]) & (F.col("part") == F.col("of")) & (F.col("need") <= F.col("m"))).select("dc_id", "tx", "ik").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs``, columns unchanged whatever their names, that contain no item.

    Rows without text, and all rows if there are no items, stay.
    """
    bad_id, bad_tx = fresh(docs, "bad_id", "bad_tx")
    bad = contained_items(docs, items, id_col, text_col, **how).select(F.col(id_col).alias(bad_id), F.col("tx").alias(bad_tx))
    bad = materialize(bad.distinct(), "contaminated")
    match = docs[id_col].eqNullSafe(F.col(bad_id)) & (F.xxhash64(docs[text_col]) == F.col(bad_tx))
    return docs.join(checked_broadcast(bad), match, "left_anti")
