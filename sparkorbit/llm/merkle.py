"""Merkle dataset manifest: a tree of digests for each group, one over the groups, and a proof for each row.

Leaves are sorted by range into partitions that a checkpoint keeps in place.  The
count of a group in the partitions before gives every leaf its number in the group.
Each partition cuts its leaves into complete aligned subtrees and builds them alone;
the nodes on top of them, ragged where a partition ends, are shuffled by (group,
parent) and finished level by level.  The roots of the groups are the leaves of one
more tree, made in the same way.

A digest is lowercase hex sha256.  ``ARITY`` consecutive nodes make a parent, the last
ones of a level fewer, even one; a lone leaf is the root of its group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import _delete as delete
from .shared import broadcast_by_size, discard, importable, materialize, shared_dir

ARITY = 16
#: Levels of the largest subtree that is built alone: its 16 ** 2 leaves are one row of a table, 25 KB.
LOCAL = 2
#: Leaves of a sorted partition, which a task holds whole: a few MB.
RANGE_ROWS = 50_000
#: Rows with proofs that a Python worker hands over at once, about 1 KB for each level.
OUT_ROWS = 256
_HEX = 64
_STEP = "struct<at:int,run:string>"


def leaf_digest(*fields: Column) -> Column:
    """Digest of a row: each field as its UTF-8 byte count, a colon and the value; ``-`` if null."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def fold(proof: Column, leaf: Column) -> Column:
    """The root that the leaf and the siblings of a proof give."""
    return F.aggregate(proof, leaf, lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda p: F.concat(p["left"], p["right"])), ""), 256)


def levels(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    k = 0
    while n > ARITY**k:
        k += 1
    return k


def parents(digests: str) -> str:
    """The digests of the level above, all in one string, as those below."""
    run = ARITY * _HEX
    return "".join(hashlib.sha256(digests[i : i + run].encode()).hexdigest() for i in range(0, len(digests), run))


def pieces(first: int, end: int, n: int) -> Iterator[tuple[int, int, int]]:
    """(level, number, leaves) of the largest complete aligned subtrees, of ``LOCAL`` levels at most, of leaves first to end of n."""
    top = min(LOCAL, levels(n))
    while first < end:
        level = top
        while first % ARITY**level or min(first + ARITY**level, n) > end:
            level -= 1
        after = min(first + ARITY**level, n)
        yield level, first // ARITY**level, after - first
        first = after


def _group_runs(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table | None, list[int]]:
    """The rows of a sorted partition, and where its groups begin, the number of rows last."""
    held = list(batches)
    rows = pa.Table.from_batches(held).combine_chunks() if held else None
    if rows is None or not rows.num_rows:
        return None, []
    code = rows["g"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return rows, [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), rows.num_rows]


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of the partition, first and last group, and their rows in it."""
    rows, at = _group_runs(batches)
    if rows is not None:
        g = rows["g"]
        made = {"part": TaskContext.get().partitionId(), "groups": len(at) - 1, "first": g[0].as_py(), "n_first": at[1], "last": g[-1].as_py(), "n_last": at[-1] - at[-2]}
        yield pa.RecordBatch.from_pylist([made], pa.schema([("part", pa.int64()), ("groups", pa.int64()), ("first", pa.string()), ("n_first", pa.int64()), ("last", pa.string()), ("n_last", pa.int64())]))


def _offsets(ends: list) -> dict[int, tuple[int, int, int]]:
    """For each partition: leaves of its first group before it, and all leaves of its first and of its last group."""
    before, total, group, n = {}, {}, None, 0
    for r in ends:
        before[r["part"]] = n = n if group == r["first"] else 0
        n += r["n_first"]
        group, total[r["first"]] = r["first"], n
        if r["groups"] > 1:
            group, n = r["last"], r["n_last"]
            total[group] = n
    return {r["part"]: (before[r["part"]], total[r["first"]], total[r["last"]]) for r in ends}


def _subtrees(sorted_rows: DataFrame, offsets: dict[int, tuple[int, int, int]]) -> DataFrame:
    """Rows (g, n, level, idx, digest, leaves): the complete subtrees of every partition with their leaves in order."""
    own = sorted_rows.schema["own"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, at = _group_runs(batches)
        if rows is None:
            return
        before, n_first, n_last = offsets[TaskContext.get().partitionId()]
        leaf = rows["leaf"].combine_chunks()
        digests = b"".join(leaf.to_pylist()).hex()
        cols: dict[str, list] = {c: [] for c in ("at", "n", "level", "idx", "digest")}
        for k, (lo, hi) in enumerate(zip(at, at[1:], strict=False)):
            first = before if k == 0 else 0
            n = n_first if k == 0 else n_last if hi == rows.num_rows else hi - lo
            for level, idx, size in pieces(first, first + hi - lo, n):
                part = digests[lo * _HEX : (lo + size) * _HEX]
                for _ in range(level):
                    part = parents(part)
                for c, v in zip(cols, (lo, n, level, idx, part), strict=True):
                    cols[c].append(v)
                lo += size
        pair = pa.StructArray.from_arrays([leaf, rows["own"].combine_chunks()], ["leaf", "own"])
        leaves = pa.ListArray.from_arrays(pa.array([*cols["at"], rows.num_rows], pa.int32()), pair)
        g = rows["g"].combine_chunks().take(pa.array(cols["at"], pa.int64()))
        made = [g, pa.array(cols["n"], pa.int64()), pa.array(cols["level"], pa.int32()), pa.array(cols["idx"], pa.int64()), pa.array(cols["digest"], pa.string()), leaves]
        out = pa.RecordBatch.from_arrays(made, ["g", "n", "level", "idx", "digest", "leaves"])
        for i in range(0, out.num_rows, 1024):
            yield out.slice(i, 1024)

    return sorted_rows.mapInArrow(cut, f"g string, n long, level int, idx long, digest string, leaves array<struct<leaf:binary,own:{own}>>")


def _in_ranges(leaves: DataFrame, n: int) -> DataFrame:
    """Leaves sorted by group, order and digest; partitions stay as they are, equal rows are spread by their number."""
    spark = leaves.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    parts = max(1, min(spark.sparkContext.defaultParallelism, n // 1000), -(-n // RANGE_ROWS))
    keys = ["g", "o", "leaf", "tie"]
    rows = leaves.withColumn("tie", F.monotonically_increasing_id())
    return rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("g", "leaf", "own").checkpoint()


def _forget(rows: DataFrame) -> None:
    """Remove the files of a checkpoint that nothing reads any more."""
    held = rows._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if held.isDefined():
        delete(rows.sparkSession, held.get())


def _runs(trees: DataFrame, top: int) -> list[DataFrame]:
    """For each level, (g, n, idx, run, digest): the children that were ragged, joined, of parent ``idx``; its digest."""
    nodes, made, out = trees.select("g", "n", "level", "idx", "digest"), None, []
    for level in range(top):
        here = nodes.where((F.col("level") == level) & (F.col("n") > ARITY**level)).drop("level")
        if made is not None:
            here = here.unionByName(made.where(F.col("n") > ARITY**level))
        parent = F.floor(F.col("idx") / ARITY).cast("long")
        together = F.array_sort(F.collect_list(F.struct("idx", "digest")))  # ARITY at most
        runs = here.groupBy("g", "n", parent.alias("up")).agg(together.alias("c"))
        runs = runs.select("g", "n", F.col("up").alias("idx"), F.array_join(F.col("c.digest"), "").alias("run"))
        out.append(materialize(runs.withColumn("digest", F.sha2("run", 256)), "runs"))
        made = out[-1].select("g", "n", "idx", "digest")
    return out


def _above(nodes: DataFrame, level: int, runs: DataFrame | None, tops: DataFrame) -> DataFrame:
    """``nodes`` (g, n, idx, ...) of a level with ``path``, from their siblings to the root of all, and ``subroot``.

    A node with a parent takes the path of its run, the root of a group that of the group.
    """
    path = F.col("path").cast(f"array<{_STEP}>")
    own = nodes.where(F.col("n") <= ARITY**level).join(tops, "g").select(*nodes.columns, path.alias("path"), "subroot")
    if runs is None:
        return own
    cols = [c for c in nodes.columns if c not in ("g", "idx")]
    step = F.array(F.struct((F.col("idx") % ARITY).cast("int").alias("at"), F.col("_run").alias("run")).cast(_STEP))
    up = runs.select("g", F.col("idx").alias("_up"), F.col("run").alias("_run"), F.col("path").alias("_path"), "subroot")
    below = nodes.where(F.col("n") > ARITY**level).withColumn("_up", F.floor(F.col("idx") / ARITY).cast("long"))
    below = below.join(up, ["g", "_up"]).select("g", "idx", *cols, F.concat(step, "_path").alias("path"), "subroot")
    return own.unionByName(below)


def _proofs(trees: DataFrame) -> DataFrame:
    """Rows (own, leaf, subroot, proof) of the leaves of subtrees with paths."""
    own = next(f for f in trees.schema["leaves"].dataType.elementType if f.name == "own").dataType.simpleString()

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        for batch in batches:
            for r in range(batch.num_rows):
                leaves = batch["leaves"][r].values
                subroot, level = batch["subroot"][r].as_py(), batch["level"][r].as_py()
                here = [b"".join(leaves.field("leaf").to_pylist()).hex()]
                for _ in range(level):
                    here.append(parents(here[-1]))
                upper = [{"left": s["run"][: s["at"] * _HEX], "right": s["run"][(s["at"] + 1) * _HEX :]} for s in batch["path"][r].as_py()]
                for i in range(0, len(leaves), OUT_ROWS):
                    rows = range(i, min(i + OUT_ROWS, len(leaves)))
                    proofs = []
                    for j in rows:
                        steps = []
                        for digests in here[:level]:
                            run, end = j // ARITY * ARITY * _HEX, (j // ARITY + 1) * ARITY * _HEX
                            steps.append({"left": digests[run : j * _HEX], "right": digests[(j + 1) * _HEX : end]})
                            j //= ARITY
                        proofs.append(steps + upper)
                    digests = [here[0][j * _HEX : (j + 1) * _HEX] for j in rows]
                    made = [leaves.field("own").slice(i, len(rows)), pa.array(digests), pa.array([subroot] * len(rows)), pa.array(proofs, kind)]
                    yield pa.RecordBatch.from_arrays(made, ["own", "leaf", "subroot", "proof"])

    return trees.select("leaves", "level", "path", "subroot").mapInArrow(expand, f"own {own}, leaf string, subroot string, proof array<struct<left:string,right:string>>")


def _forest(leaves: DataFrame) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """Of rows (g, o, leaf, own): the subtrees, the runs of each level above them, and (g, n, subroot).

    ``leaves`` is a table made by ``materialize``; it is removed.
    """
    spark = leaves.sparkSession
    rows = _in_ranges(leaves, leaves.count())
    ends = rows.mapInArrow(_ends, "part long, groups long, first string, n_first long, last string, n_last long").orderBy("part").collect()  # one row for each partition
    trees = materialize(_subtrees(rows, _offsets(ends)), "subtrees")
    _forget(rows)
    discard(leaves)
    runs = _runs(trees, levels(trees.agg(F.max("n")).first()[0] or 1))
    lone = trees.where(F.col("n") <= F.pow(F.lit(ARITY), "level")).select("g", "n", F.col("digest").alias("subroot"))
    for level, r in enumerate(runs, 1):
        lone = lone.unionByName(r.where(F.col("n") <= ARITY**level).select("g", "n", F.col("digest").alias("subroot")))
    return trees, runs, materialize(lone, "subroots") if runs else lone


def _with_paths(trees: DataFrame, runs: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The subtrees with the paths above them; ``tops`` has (g, path, subroot) of the groups."""
    size = lambda df: broadcast_by_size(df, F.lit(256) + F.size("path") * 1100)
    tops, full = size(tops), [None] * (len(runs) + 1)
    for level in range(len(runs), 0, -1):
        full[level - 1] = materialize(_above(runs[level - 1].select("g", "n", "idx", "run"), level, full[level], tops), "paths")
    out = None
    for level in range(LOCAL + 1):
        up = full[level] if level < len(full) else None
        here = _above(trees.where(F.col("level") == level), level, None if up is None else size(up), tops)
        out = here if out is None else out.unionByName(here)
    return out


def merkle_manifest(docs: DataFrame, leaf: Column, group: Column, order: Column, keep: dict[str, Column]) -> DataFrame:
    """The columns ``keep`` of every row with ``leaf``, ``subroot`` of its group, ``root`` of all and ``proof``.

    ``leaf`` is a digest as hex.  Groups are ordered by the UTF-8 bytes of ``group``, null
    first; leaves of a group by ``order``, null first, those of equal order by digest.
    ``proof`` is an array of (left, right): the digests left and right of the own one in
    its run, joined, from the leaf to the root; a run of one gives empty strings.  Equal
    rows have leaves of their own.  An empty table gives no rows.  Of the columns of
    ``docs`` only those named take part; ``leaf``, ``subroot``, ``root`` and ``proof`` take
    the place of kept ones so named.
    """
    spark: SparkSession = docs.sparkSession
    importable(spark)
    held = {k: v for k, v in keep.items() if k not in ("leaf", "subroot", "root", "proof")}
    g = F.coalesce(F.concat(F.lit("+"), group.cast("string")), F.lit(""))
    leaves = docs.select(g.alias("g"), order.alias("o"), F.unhex(leaf).alias("leaf"), F.struct(*(v.alias(k) for k, v in held.items())).alias("own"))
    trees, runs, groups = _forest(materialize(leaves, "leaves"))
    over = groups.select(F.lit("").alias("g"), F.col("g").alias("o"), F.unhex("subroot").alias("leaf"), F.struct("g").alias("own"))
    top_trees, top_runs, top = _forest(materialize(over, "groups"))
    root = top.select("subroot").first()
    none = top.select("g", F.array().cast(f"array<{_STEP}>").alias("path"), "subroot")
    steps = F.transform("proof", lambda p: F.struct((F.length(p["left"]) / _HEX).cast("int").alias("at"), F.concat(p["left"], F.repeat(F.lit(" "), _HEX), p["right"]).alias("run")))
    tops = _proofs(_with_paths(top_trees, top_runs, none)).select("own.g", steps.alias("path"), F.col("leaf").alias("subroot"))
    out = _proofs(_with_paths(trees, runs, materialize(tops, "tops")))
    return out.select("own.*", "leaf", "subroot", F.lit(root[0] if root else None).cast("string").alias("root"), "proof")
