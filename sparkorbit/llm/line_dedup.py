"""Line dedup by a segment-partition edit join.

Lines (trimmed, not blank) of at least ``LEAST`` characters within ``EDITS`` edits
of each other are one class, transitively; shorter lines have to be equal.  The
first line of a class is kept, by smallest document id, then line number.

A line is cut into ``EDITS`` + 1 segments.  A line within that many edits has one of
them unchanged, at a place that the lengths bound: it probes, for its own and the
smaller lengths in reach, the substrings that may be that segment.  Substring
values come from prefix polynomials over code points.  Only keys that two lines
share are followed up; candidates are verified by a banded bit-parallel edit
distance.  Buckets are never expanded into all pairs at first (see
``near_dup.star_links``); within those that stay open, lines are compared by how often
each kind of character stands in them, and by the distance if that allows it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .near_dup import components, star_links
from .shared import checked_broadcast, heavy_keys, is_small, join_by_key, materialize

EDITS, LEAST = 2, 20

_BASES = tuple(int(b) for b in K.mix(np.array([101, 202], np.uint64)) | np.uint64(1))
_UNBASES = tuple(pow(b, -1, 1 << 64) for b in _BASES)
_C = K.mix(np.arange(1, 8, dtype=np.uint64)) | np.uint64(1)
_BLANK = np.zeros(128, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


_TABLE = K.mix(np.arange(1 << 16, dtype=np.uint64) + _C[0])


def _blank(points: np.ndarray) -> np.ndarray:
    return (points < 128) & _BLANK[np.minimum(points, 127)]


class Lines:
    """All non-blank lines of a chunk of texts, trimmed: code points, bounds, row and line numbers."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        text = data.tobytes().decode("utf-8")
        cp = np.frombuffer(text.encode("utf-16-le"), np.uint16)
        if len(cp) > len(text):  # characters beyond the 16-bit ones
            cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        self.points = cp
        if len(cp) < len(data):  # not one byte a character
            offs = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)))[offs]
        begin, end = offs[:-1], offs[1:]
        breaks = np.flatnonzero(cp == 10)
        start = np.concatenate((begin, breaks + 1))
        row = np.concatenate((np.arange(len(begin)), np.searchsorted(end, breaks, "right")))
        order = np.lexsort((start, row))
        start, row = start[order], row[order]
        stop = end[row]
        same = row[1:] == row[:-1]
        stop[:-1][same] = start[1:][same] - 1
        number = np.arange(len(row)) - np.searchsorted(row, np.arange(len(begin)))[row]
        for step in range(1 << 62):  # blanks at either end
            some = np.flatnonzero(start < stop)
            left, right = some[_blank(cp[start[some]])], some[_blank(cp[stop[some] - 1])]
            if not len(left) and not len(right):
                break
            if step < 16:
                start[left] += 1
                stop[right] = np.maximum(stop[right] - 1, start[right])
            else:  # a few long runs
                for k in {*left.tolist(), *right.tolist()}:
                    solid = np.flatnonzero(~_blank(cp[start[k] : stop[k]]))
                    start[k], stop[k] = (start[k] + solid[0], start[k] + solid[-1] + 1) if len(solid) else (stop[k], stop[k])
        has = stop > start
        self.start, self.stop, self.row, self.number = start[has], stop[has], row[has], number[has]
        self._prefix: dict[int, np.ndarray] = {}

    def _sums(self, lane: int) -> np.ndarray:
        if lane not in self._prefix:
            cp = self.points
            value = _TABLE[cp if cp.dtype == np.uint16 else cp & 0xFFFF]
            if cp.dtype != np.uint16:
                rare = np.flatnonzero(cp >> 16)
                value[rare] = K.mix(cp[rare].astype(np.uint64) + _C[0])
            out = np.zeros(len(cp) + 1, np.uint64)
            value *= K._powers_of(_BASES[lane], len(cp))
            np.cumsum(value, out=out[1:])
            self._prefix[lane] = out
        return self._prefix[lane]

    def value(self, start: np.ndarray, stop: np.ndarray, lane: int = 0) -> np.ndarray:
        p = self._sums(lane)
        return K.mix((p[stop] - p[start]) * K._powers_of(_UNBASES[lane], len(p))[start] + (stop - start).astype(np.uint64))

    def print(self, lane: int, which: np.ndarray | slice = slice(None)) -> np.ndarray:
        """A 64-bit value of whole lines."""
        return self.value(self.start[which], self.stop[which], lane)

    def text(self, k: int) -> str:
        return self.points[self.start[k] : self.stop[k]].tobytes().decode(f"utf-{8 * self.points.itemsize}-le")

    def letters(self, k: int) -> np.ndarray:
        """How often each of 32 kinds of characters stands in a line; an edit changes two counts at most."""
        return np.bincount(self.points[self.start[k] : self.stop[k]] & 31, minlength=32).astype(np.int32)


def segments(size: np.ndarray, edits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Start and length of the edits + 1 segments of lines of these sizes; the last ones are longer."""
    least, more = size // (edits + 1), size % (edits + 1)
    out, at = [], np.zeros_like(size)
    for i in range(edits + 1):
        width = least + (i >= edits + 1 - more)
        out.append((at, width))
        at = at + width
    return out


def segment_keys(lines: Lines, edits: int = EDITS, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, line, probe) of all index segments (probe 0) and probed substrings (1)."""
    size = lines.stop - lines.start
    long = np.flatnonzero(size >= least)
    keys, at, probes = [], [], []
    for less in range(edits + 1):
        to = size[long] - less
        for i, (p, width) in enumerate(segments(to, edits)):
            # i segments stand before this one, edits - i after it: both sides bound the shift
            for shift in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1):
                own = not less and not shift
                s = p + shift
                ok = (s >= 0) & (s + width <= size[long]) & (to >= least)
                k = long[ok]
                begin = lines.start[k] + s[ok]
                keys.append(K.mix(lines.value(begin, begin + width[ok]) + _C[1 + i] * (to[ok].astype(np.uint64) + np.uint64(1))))
                at.append(k)
                probes.append(np.full(len(k), not own, np.int32))
    return np.concatenate(keys), np.concatenate(at), np.concatenate(probes)


def within(a: list[np.ndarray], b: list[np.ndarray], edits: int) -> np.ndarray:
    """Whether pairs of code point arrays are within ``edits`` edits, many pairs at once.

    Bit k of the vectors stands for row j - edits + k of column j: a band of
    2 * edits + 1 rows around the diagonal, as vertical differences (up, down).  The
    score follows the lowest diagonal of the band and is carried back to the last row.
    """
    m, n = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    width = 2 * edits + 1
    mask, top = np.int64((1 << width) - 1), np.int64(1 << (width - 1))
    rows = np.full((len(a), int(m.max(initial=0)) + 3 * width), -1, np.int64)
    cols = np.full((len(a), max(1, int(n.max(initial=0)))), -2, np.int64)
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        rows[k, width : width + len(x)] = x
        cols[k, : len(y)] = y
    up = np.full(len(a), mask & ~np.int64((1 << edits) - 1))
    down = np.zeros(len(a), np.int64)
    score = np.full(len(a), edits, np.int64)
    result = np.full(len(a), edits + 1, np.int64)
    high = np.array([(1 << (2 * edits)) - (1 << max(0, d)) if -edits <= d - edits <= edits and d <= 2 * edits else 0 for d in np.clip(m - n + edits, 0, 2 * edits)], np.int64)
    done = n == 0
    result[done] = m[done]
    for j in range(int(n.max(initial=0))):
        same = np.zeros(len(a), np.int64)
        for k in range(width):  # row j + 1 - edits + k, counted from 1
            at = width + min(j - edits + k, rows.shape[1] - width - 1)
            same |= (rows[:, at] == cols[:, j]).astype(np.int64) << k
        d = ((((same & up) + up) ^ up) | same | down) & mask
        plus = (down | ~(d | up)) & mask
        minus = d & up
        score += (d & top) == 0
        d >>= 1
        up = (minus | ~(d | plus)) & mask
        down = d & plus
        last = n == j + 1
        if last.any():
            bits = lambda v: np.bitwise_count((v & high)[last])  # noqa: B023, E731
            result[last] = score[last] - bits(up).astype(np.int64) + bits(down).astype(np.int64)
    return (np.abs(m - n) <= edits) & (result <= edits)


def _each(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, Lines]]:
    data, offs = K.utf8(batch.column(column))
    for i, j in K.chunks(offs):
        yield i, Lines(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def placed_lines(docs: DataFrame, id_col: str, text_col: str, edits: int, least: int) -> DataFrame:
    """(id, number, h1, h2, line, letters, keys): all lines by their two values, and number -1 for each document.

    Text, letters and keys are there for lines that share a segment key with an unequal one.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def keyed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for _, lines in _each(batch, 0):
                key, at, probe = segment_keys(lines, edits, least)
                yield pa.RecordBatch.from_arrays([_long(key), _long(lines.print(0)[at]), pa.array(probe)], ["key", "h1", "probe"])

    keys = rows.select("text").mapInArrow(keyed, "key long, h1 long, probe int").groupBy("key")
    keys = keys.agg(F.min("h1").alias("lo"), F.max("h1").alias("hi"), F.min("probe").alias("probe")).where("lo < hi and probe = 0").select("key")
    keys = materialize(keys, "keys")
    few = is_small(keys)
    held = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in keys.collect()], np.int64))) if few else None

    def placed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "number", "h1", "h2", "line", "letters", "keys"]
        nothing = lambda n: [pa.nulls(n, pa.string()), pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.list_(pa.int64()))]
        for batch in it:
            zero = pa.array(np.zeros(batch.num_rows, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(batch.num_rows, -1, np.int32)), zero, zero, *nothing(batch.num_rows)], names)
            for i, lines in _each(batch, 1):
                key, at, _ = segment_keys(lines, edits, least)
                key = key.view(np.int64)
                if held is not None:
                    known = held.value
                    ok = np.zeros(len(key), bool) if not len(known) else known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key
                    key, at = key[ok], at[ok]
                order = np.argsort(at, kind="stable")
                key, at = key[order], at[order]
                which, first = np.unique(at, return_index=True)
                rest = np.setdiff1d(np.arange(len(lines.row)), which)
                listed = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)).astype(np.int32)), pa.array(key))
                counts = pa.array([lines.letters(k) for k in which], pa.list_(pa.int32()))
                extra = [pa.array([lines.text(k) for k in which], pa.string()), counts, listed]
                for part, more in ((which, extra), (rest, nothing(len(rest)))):
                    ids = batch.column(0).take(pa.array(lines.row[part] + i))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(lines.number[part].astype(np.int32)), _long(lines.print(0, part)), _long(lines.print(1, part)), *more], names)

    schema = f"id {kind}, number int, h1 long, h2 long, line string, letters array<int>, keys array<long>"
    out = materialize(rows.mapInArrow(placed, schema), "placed")
    if held is not None:
        return out
    shared = out.select("h1", "h2", F.explode("keys").alias("key")).join(keys, "key").select("h1", "h2").distinct().withColumn("shared", F.lit(True))
    out = out.join(shared, ["h1", "h2"], "left")
    return out.select("id", "number", "h1", "h2", *(F.when(F.col("shared"), F.col(c)).alias(c) for c in ("line", "letters", "keys")))


def line_classes(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """(h1, h2, label): the class of the lines, by their two values, that have near but unequal ones."""
    nodes = lines.where("line is not null").groupBy("h1", "h2").agg(F.first("line").alias("line"), F.first("letters").alias("letters"), F.first("keys").alias("keys"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    active = nodes.select("node", F.explode("keys").alias("key")).distinct()

    def near(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ok = []
            for i in range(0, batch.num_rows, 512):
                part = [[np.frombuffer(v.encode("utf-32-le"), np.uint32) for v in batch.column(c).slice(i, 512).to_pylist()] for c in (2, 3)]
                ok.append(within(*part, edits))
            if ok:
                yield batch.filter(pa.array(np.concatenate(ok))).select(["a", "b"])

    def verified(pairs: DataFrame) -> DataFrame:
        text = nodes.select("node", "line")
        pairs = pairs.join(text.toDF("a", "x"), "a").join(text.toDF("b", "y"), "b")
        alike = F.abs(F.length("x") - F.length("y")) <= edits
        return pairs.where(alike).select("a", "b", "x", "y").mapInArrow(near, "a long, b long")

    edges, left = star_links(materialize(active, "active"), verified)
    if left is not None:
        # Lines that share a segment only are told apart by their letters, within the join.
        left = left.join(nodes.select("node", "letters"), "node")
        right = left.select("key", F.col("node").alias("b"), F.col("label").alias("other"), F.col("letters").alias("counts"))
        apart = F.aggregate(F.zip_with("letters", "counts", lambda x, y: F.abs(x - y)), F.lit(0), lambda a, x: a + x)
        near_letters = (F.col("node") < F.col("b")) & (F.col("label") != F.col("other")) & (apart <= 2 * edits)
        pairs = left.join(right, "key").where(near_letters).select(F.col("node").alias("a"), "b").distinct()
        edges = edges.union(verified(materialize(pairs, "pairs")))
    return materialize(nodes.select("node", "h1", "h2").join(components(edges), "node").select("h1", "h2", "label"), "line-classes")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """(id, n_lines, n_kept, n_near, kept_lines) for every id of ``docs``.

    ``n_lines`` counts the lines that are not blank, ``n_near`` those whose class has
    unequal lines, ``kept_lines`` are the numbers (from 0, blank lines counted) of the
    lines kept.  Null and empty texts have none.  Rows of a repeated id are one
    document; rows of a null id are one document, which comes last.
    """
    lines = placed_lines(docs, id_col, text_col, edits, least)
    classes = line_classes(lines, edits)
    rows = lines.select("id", "number", "h1", "h2")
    rows = rows.join(checked_broadcast(classes), ["h1", "h2"], "left")
    per = rows.groupBy("id", F.coalesce("label", "h1").alias("k1"), F.when(F.col("label").isNull(), F.col("h2")).otherwise(-1).alias("k2"), F.col("label").isNotNull().alias("near"), (F.col("number") < 0).alias("mark"))
    per = materialize(per.agg(F.min("number").alias("number"), F.count("*").alias("n")), "lines")
    keys = ["k1", "k2", "near"]
    first = per.where("not mark").groupBy(*keys).agg(F.min("id").alias("first"), F.count("*").alias("n_docs"))
    first = materialize(first, "first")
    heavy = heavy_keys(first.withColumnRenamed("n_docs", "n"), keys)
    own = join_by_key(per.where("not mark"), first.drop("n_docs"), keys, heavy).select("id", "number", "n", "near", F.col("id").eqNullSafe(F.col("first")).alias("kept"))
    own = own.unionByName(per.where("mark").select("id", "number", F.lit(0).cast("long").alias("n"), F.lit(False).alias("near"), F.lit(False).alias("kept")))
    out = own.groupBy("id").agg(F.sum("n").alias("n_lines"), F.sum(F.col("kept").cast("long")).alias("n_kept"), F.sum(F.when(F.col("near"), F.col("n")).otherwise(0)).alias("n_near"), F.array_sort(F.collect_list(F.when(F.col("kept"), F.col("number")))).alias("kept_lines"))
    return out.withColumnRenamed("id", id_col)
