"""MinHash near-duplicates: circulant signatures, banding, exact Jaccard verification.

A document's set holds the distinct five-word shingles of its whole text (the
whole word sequence if shorter; nothing without words).  Two permutations make
every coordinate of a signature: ``sigma`` places a shingle on a circle of 2^20
positions, ``pi`` orders the positions, and coordinate k looks at ``pi`` shifted
circularly by k.  Bands of four coordinates give buckets.

No bucket is expanded into all of its pairs.  Equal sets are one node from the
start.  In each star round a node is held against one pivot of its buckets;
confirmed links merge components, and a bucket whose nodes are all in one
component is done.  Nodes of buckets that are still open at the end (mostly
documents that share a passage) are joined exactly by their rarest shingles.  At
Jaccard 0.75 a pair shares no band with a probability of 5e-6, at 0.8 of 5e-8.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .shared import checked_broadcast, discard, fresh, heavy_keys, join_by_key, materialize

BANDS, ROWS = 32, 4
COORDS = BANDS * ROWS
CIRCLE = 1 << 20
#: Orders of pivots in each star round.
STAR_ROUNDS = (1, 3)

_pi = np.random.Generator(np.random.PCG64(71)).permutation(CIRCLE).astype(np.uint32)
_ring = np.lib.stride_tricks.sliding_window_view(np.concatenate((_pi, _pi[:COORDS])), COORDS)
_SIGMA = np.uint64(0x9E3779B97F4A7C15)
_BAND = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
_LANES = np.array([0x2545F4914F6CDD1D, 0x9E6C63D0876A9A35, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def signature(values: np.ndarray) -> np.ndarray:
    """The circulant MinHash signature of a non-empty set of shingle values."""
    place = (K.mix(values ^ _SIGMA) >> np.uint64(44)).astype(np.int64)
    out = _ring[place[:4096]].min(axis=0)
    for i in range(4096, len(place), 4096):
        np.minimum(out, _ring[place[i : i + 4096]].min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit bucket key for each band."""
    return K.mix((sig.reshape(BANDS, ROWS).astype(np.uint64) * _LANES).sum(axis=1, dtype=np.uint64) + _BAND)


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of the batch of about ``K.CHUNK`` bytes of text, with the set of each row."""
    data, offs = K.utf8(batch.column(1))
    for i, j in K.chunks(offs):
        value, at = K.shingles(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        yield batch.slice(i, j - i), [np.unique(value[at[k] : at[k + 1]]) for k in range(j - i)]


def _fingerprint(s: np.ndarray) -> tuple[int, int]:
    a = K.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    b = K.mix(s + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def _signed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, sets in (x for batch in it for x in _sets(batch)):
        n = np.array([len(s) for s in sets], np.int64)
        prints = np.array([_fingerprint(s) if len(s) else (0, 0) for s in sets], np.int64).reshape(-1, 2)
        keys = [band_keys(signature(s)).view(np.int64) for s in sets if len(s)]
        ends = np.concatenate(([0], np.cumsum(n > 0))).astype(np.int32) * BANDS
        keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(prints[:, 0]), pa.array(prints[:, 1]), part.column(2), keys], ["nd_id", "n_shingles", "c1", "c2", "tx", "keys"])


def _payload(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, sets in (x for batch in it for x in _sets(batch)):
        sets = [s for s in sets if len(s)]
        prints = np.array([_fingerprint(s) for s in sets], np.int64).reshape(-1, 2)
        ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
        values = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array([signature(s).tobytes() for s in sets], pa.binary()), values], ["c1", "c2", "sig", "shingles"])


def _alike(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree on half the coordinates (0.75 gives less once in 1e8)."""
    for batch in it:
        if batch.num_rows:
            a, b = (np.array([np.frombuffer(x, np.uint32) for x in batch.column(k).to_pylist()]) for k in (2, 3))
            yield batch.filter(pa.array((a == b).sum(axis=1) * 2 >= COORDS)).select(["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of the edges (a, b) reaches.

    Labels flow over links and jump along their own labels until none changes;
    each pass is written to the shared folder.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    hubs = heavy_keys(both.groupBy("b").agg(F.count("*").alias("n")), ["b"])
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        was = labels
        near = join_by_key(both, labels.select(F.col("node").alias("b"), "label"), ["b"], hubs).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        new = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = materialize(new.join(up, "label", "left").select("node", "old", F.least("label", "up").alias("label")), "labels")
        discard(was)
        if not new.where("label < old").limit(1).count():
            return new.select("node", "label")
        labels = new


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """One row for each row of ``docs``: its group of near-duplicates.

    Columns: the id, ``n_shingles``, ``component_id`` (smallest id reachable over
    links of 100 * intersection >= percent * union), ``kept`` (id = component_id),
    ``component`` (a key of the group, null without words) and ``tx`` (xxhash64 of
    the text).  Texts that are null or without words link with nothing and keep
    their own id.  A null id never names a group that has another id; repeated ids
    are rows of their own with the results of their texts.  ``percent`` is 75 or more.
    """
    if percent < 75:
        raise ValueError("the bands are laid out for 75 percent and more")
    text = docs.select(F.col(id_col).alias("nd_id"), F.col(text_col).alias("nd_text"))
    text = text.withColumn("tx", F.xxhash64("nd_text"))
    kind = text.schema["nd_id"].dataType.simpleString()
    signed = text.mapInArrow(_signed, f"nd_id {kind}, n_shingles long, c1 long, c2 long, tx long, keys array<long>")
    signed = materialize(signed.withColumn("rid", F.monotonically_increasing_id()), "signed")
    classes = signed.where("n_shingles > 0").groupBy("c1", "c2").agg(F.min("rid").alias("node"), F.min("nd_id").alias("first_id"))
    classes = materialize(classes, "classes")

    bands = signed.join(classes.select(F.col("node").alias("rid")), "rid").select(F.col("rid").alias("node"), F.explode("keys").alias("key"))
    shared = bands.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key")
    active = materialize(bands.join(shared, "key").select("key", "node"), "active")
    links = _links(text, signed, active, percent)
    labels = components(links)

    named = classes.join(labels, "node", "left").withColumn("component", F.coalesce("label", "node"))
    first = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = materialize(named.join(first, "component").select("c1", "c2", "component", "component_id"), "named")
    out = signed.drop("keys", "rid").join(named, ["c1", "c2"], "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("nd_id"))
    return out.select(F.col("nd_id").alias(id_col), "n_shingles", own.alias("component_id"), F.col("nd_id").eqNullSafe(own).alias("kept"), F.when(F.col("n_shingles") > 0, F.col("component")).alias("component"), "tx")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, columns unchanged, less all but one of each group of near-duplicates.

    The row with the smallest id stays, one of them if the id is repeated.  Rows
    without words are in no group: all stay.  Columns may have any names.
    """
    found = near_duplicates(docs, id_col, text_col)
    nd_id, nd_tx, nd_kept = fresh(docs, "nd_id", "nd_tx", "nd_kept")
    kept = F.col("kept") & F.col("component").isNotNull()
    groups = materialize(found.where(kept).groupBy(F.col(id_col).alias("nd_id"), "tx", "component").agg(F.count("*").alias("rows")), "kept")
    wanted = materialize(groups.select(F.col("nd_id").alias(nd_id), F.col("tx").alias(nd_tx)).distinct().withColumn(nd_kept, F.lit(True)), "wanted")
    out = docs.join(wanted, docs[id_col].eqNullSafe(F.col(nd_id)) & (F.xxhash64(docs[text_col]) == F.col(nd_tx)), "left")
    worded = F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    kept_rows = out.where(F.col(nd_kept) | ~worded).select(*docs.columns)
    extra = groups.groupBy("component").agg(F.sum("rows").alias("rows"), F.min("tx").alias("tx")).where("rows > 1")
    if not extra.limit(1).count():
        return kept_rows
    # Repeated ids: of the rows of a component that share the smallest id, one stays.
    groups = groups.join(extra.select("component", F.col("tx").alias("only")), "component", "left")
    only = materialize(groups.where("only is null or tx = only").select("nd_id", "tx"), "only")
    again = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("own"), F.xxhash64(text_col).alias("own_tx"), worded.alias("worded"))
    again = again.join(only, again["own"].eqNullSafe(only["nd_id"]) & (again["own_tx"] == only["tx"]), "left").where(F.col("tx").isNotNull() | ~F.col("worded"))
    one = again.where("worded").groupBy("own", "own_tx").agg(F.first("row").alias("row")).select("row.*")
    return one.unionByName(again.where("not worded").select("row.*"))


def _links(text: DataFrame, signed: DataFrame, active: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b), enough of them for all components of the whole graph."""
    reps = active.select(F.col("node").alias("rid")).distinct().join(signed, "rid").select("rid", "nd_id", "c1", "c2")
    reps = materialize(reps, "reps")
    wanted = checked_broadcast(reps.select(F.col("nd_id").alias("want")).distinct())
    some = text.join(wanted, text["nd_id"].eqNullSafe(F.col("want")), "left_semi").select("nd_id", "nd_text")
    payload = some.mapInArrow(_payload, "c1 long, c2 long, sig binary, shingles array<long>")
    payload = payload.join(reps.select("c1", "c2", F.col("rid").alias("node")), ["c1", "c2"]).select("node", "sig", "shingles")
    payload = materialize(payload, "payload")
    if payload.count() > reps.count():  # ids that several rows carry
        payload = materialize(payload.dropDuplicates(["node"]), "payload")

    def verified(pairs: DataFrame) -> DataFrame:
        sets = payload.select("node", "shingles")
        one = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
        two = one.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
        both = F.size(F.array_intersect("sa", "sb"))
        return two.where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")

    edges, labelled = star_links(active, verified)
    if labelled is None:
        return edges
    nodes = materialize(labelled.select("node", "label").distinct(), "nodes")
    pairs = materialize(_rare_pairs(payload.join(nodes, "node"), percent), "pairs")
    sigs = payload.select("node", "sig")
    pairs = pairs.join(sigs.toDF("a", "x"), "a").join(sigs.toDF("b", "y"), "b").select("a", "b", "x", "y")
    pairs = materialize(pairs.mapInArrow(_alike, "a long, b long"), "pairs")
    return edges.union(materialize(verified(pairs), "edges"))


def star_links(active: DataFrame, verified: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame | None]:
    """Links (a, b) from star rounds over buckets (key, node), and what of the buckets is open.

    In a round every node is held against one pivot of its buckets for each order of
    nodes: at first the node that shares most rows of buckets with others (the
    original of a family of copies), then that of what is left and of random orders.
    A node without a label takes that of a pivot it is linked with.  Open are the rows
    (key, node, label) of buckets that hold several labels, None if there are none.
    """
    edges = active.sparkSession.createDataFrame([], "a long, b long")
    labelled = active.withColumn("label", F.col("node"))
    for orders in STAR_ROUNDS:
        often = materialize(labelled.groupBy("key").agg(F.count("*").alias("n")), "often")
        heavy = heavy_keys(often, ["key"])
        central = join_by_key(labelled, often, ["key"], heavy).groupBy("node").agg(F.sum("n").alias("central"))
        ranked = materialize(labelled.join(central, "node").select("key", "node", "central"), "ranked")
        pairs = None
        for order in range(orders):
            # a random order is that of the ids with some bits flipped
            flip = F.lit(int(K.mix(np.uint64([order + 1]))[0] >> np.uint64(1)))
            rank = F.struct(F.col("node").bitwiseXOR(flip).alias("rank"), F.col("node").alias("pivot")) if order else F.struct(F.col("central").alias("rank"), F.col("node").alias("pivot"))
            pivots = ranked.groupBy("key").agg(F.max(rank).alias("best"))
            own = join_by_key(ranked, pivots, ["key"], heavy).groupBy("node").agg(F.max("best").alias("best")).select(F.col("node").alias("a"), F.col("best.pivot").alias("b"))
            pairs = own if pairs is None else pairs.union(own)
        found = materialize(verified(pairs.where("a <> b").distinct()), "edges")
        edges = edges.union(found)
        labels = labelled.select("node", "label").distinct()
        taken = found.join(labels, found["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("taken"))
        now = labelled.join(taken, labelled["node"] == taken["a"], "left")
        now = materialize(now.select("key", "node", F.when(F.col("label") == F.col("node"), F.coalesce("taken", "label")).otherwise(F.col("label")).alias("label")), "labelled")
        # Open are the buckets in which more than one component is left.
        mixed = now.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
        was, labelled = labelled, materialize(join_by_key(now, mixed, ["key"], heavy).select("key", "node", "label"), "open")
        discard(often, ranked, now, was)
        if not labelled.limit(1).count():
            return edges, None
    return edges, labelled


def _rare_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different labels that may be links, from rows (node, label, shingles).

    Shingles are put in the order of their frequency, so a passage that many documents
    repeat comes last.  Sets of n and m shingles are links only if they share
    ``least`` = ceil(t / (1 + t) * (n + m)) of them, and so one at a place that leaves
    that many in both.
    """
    rows = sets.select("node", F.explode("shingles").alias("h"))
    often = rows.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    rows = rows.join(often, "h").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("common"))
    n, alone = F.size("shingles"), F.size("shingles") - F.size("common")  # those of one set alone come first
    first = n - F.ceil(n * percent / 100) + 1 - alone
    heads = sets.join(rows, "node").select("node", "label", n.alias("n"), alone.alias("alone"), F.posexplode(F.slice("common", 1, F.greatest(first.cast("int"), F.lit(0)))).alias("at", "c"))
    heads = materialize(heads.select("node", "label", "n", (F.col("at") + F.col("alone")).alias("at"), F.col("c.h").alias("key")), "heads")
    mixed = heads.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    heads = materialize(heads.join(mixed, "key"), "heads")
    right = heads.select("key", F.col("node").alias("b"), F.col("label").alias("other"), F.col("n").alias("m"), F.col("at").alias("bt"))
    room = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("bt"))  # shared from here on at most
    alike = ((100 + percent) * room >= percent * (F.col("n") + F.col("m"))) & (F.col("node") < F.col("b")) & (F.col("label") != F.col("other"))
    return heads.join(right, "key").where(alike).select(F.col("node").alias("a"), "b").distinct()

