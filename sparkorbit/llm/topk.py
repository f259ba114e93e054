"""Exact top-k inner products by MaxScore over shards of vectors.

A vector component becomes floor(256 * x).  In a shard of vectors, dimension d
makes two posting lists of non-negative impacts: c_d - min_d for queries with a
positive weight, max_d - c_d for those with a negative one.  A query's score is
its base (the sum of its extreme contributions) plus weighted impacts, so the
largest impact of each list bounds what its term can add.

Terms in ascending order of their bounds are non-essential as long as the base and
their bounds together stay below the k-th best score so far.  Essential postings
are traversed; vectors that can still compete are probed in the others, from the
largest bound down, and dropped when they no longer can.  Results of the shards
are merged.

A task searches ``GROUP`` shards for ``ASKED`` blocks of queries, so the vectors are
shuffled once for every ``ASKED * BLOCK`` queries, in the narrowest number that
holds them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

TOP = 5
#: Vectors of a shard, queries of a block, shards of a group and blocks that one task holds.
SHARD, BLOCK, GROUP, ASKED = 4096, 1024, 8, 64
#: Bytes of a shard or block at most, unless one vector has more.
BLOB_BYTES = 16 << 20
SCALE = 256
#: Scores below this are exact in double arithmetic.
_EXACT = float(1 << 52)
_LONG = 1 << 63


def _whole(m: np.ndarray) -> np.ndarray:
    """Whole numbers as Python integers."""
    return m if m.dtype == object else np.array([int(x) for x in m.ravel()], object).reshape(m.shape)


def _coded(m: np.ndarray) -> tuple[str, bytes]:
    """floor(SCALE * x) in the narrowest number type; "x": components of the rows as they are, too large for it."""
    with np.errstate(over="ignore"):
        scaled = np.floor(m * SCALE)
    most = float(np.abs(scaled).max(initial=0))
    for code, bound in (("i2", 1 << 15), ("i4", 1 << 31), ("f8", math.inf)):
        if most < bound:
            return code, scaled.astype(code).tobytes()
    return "x", m.tobytes()


def _decoded(code: str, data: bytes, rows: int) -> np.ndarray:
    if code != "x":
        return np.frombuffer(data, code).astype(np.float64).reshape(rows, -1) if data else np.zeros((rows, 0))
    flat = np.frombuffer(data, "f8")
    return np.array([math.floor(x * SCALE) if abs(x) < 1e300 else int(x) * SCALE for x in flat.tolist()], object).reshape(rows, -1)


def search_shard(ids: np.ndarray, rids: np.ndarray, vectors: np.ndarray, queries: np.ndarray, qrids: np.ndarray, best: list[list[tuple]], top: int) -> None:
    """Update ``best`` of each query: at most ``top`` tuples (-score, id, rid), in ascending order.

    Vectors and queries hold whole numbers; a component that one side lacks is 0.
    """
    d = min(vectors.shape[1], queries.shape[1])
    vectors, queries = vectors[:, :d], queries[:, :d]
    small = float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * d < _EXACT if object not in (vectors.dtype, queries.dtype) else False
    cast = (lambda m: m.astype(np.float64)) if small else _whole
    posts, queries = np.ascontiguousarray(cast(vectors).T), cast(queries)
    low, high = posts.min(axis=1), posts.max(axis=1)
    for k in range(len(queries)):
        q = queries[k]
        up = q >= 0
        weight = np.abs(q)
        base = (q * np.where(up, low, high)).sum()
        bound = weight * (high - low)
        order = np.argsort(bound, kind="stable")
        full = best[k][-1][0] if len(best[k]) >= top else None
        floor = -full if full is not None else None
        if floor is not None and base + bound.sum() < floor:
            continue
        reach = base + np.add.accumulate(bound[order])
        cut = 0 if floor is None else int(np.searchsorted(reach, floor, "left"))  # so many terms are non-essential
        lead, rest = np.sort(order[cut:]), order[:cut][::-1]
        # sum of weight * impact over the essential lists, impacts taken from the extreme that the base holds
        score = base + q[lead] @ posts[lead] - (q[lead] * np.where(up, low, high)[lead]).sum() if len(lead) else np.full(len(ids), base)
        if cut:
            slack = reach[cut - 1] - base
            live = np.flatnonzero(score + slack >= floor)
            score = score[live]
            for i in range(0, cut, 8):
                if not len(live):
                    break
                t = rest[i : i + 8]
                score = score + q[t] @ posts[np.ix_(t, live)] - (q[t] * np.where(up, low, high)[t]).sum()
                slack = slack - bound[t].sum()
                keep = score + slack >= floor
                live, score = live[keep], score[keep]
        else:
            live = np.arange(len(ids))
        if len(live) > 4 * top:
            worst = np.partition(score, len(score) - top - 1)[len(score) - top - 1]
            live, score = live[score >= worst], score[score >= worst]
            if small:  # of many ties only the smallest ids can be among the best
                first = np.lexsort((ids[live], -score))[: top + 1]
                live, score = live[first], score[first]
        found = [(-int(s), int(ids[v]), int(rids[v])) for v, s in zip(live, score, strict=True) if rids[v] != qrids[k]]
        best[k] = sorted(best[k] + found)[:top]


_BLOB = "blob long, n int, code string, ids binary, rids binary, vectors binary"


def _packed(size: int):
    """Vectors of a partition into blobs of at most ``size``, of like dimension and magnitude; short ones end in zeros."""
    names = [f.split()[0] for f in _BLOB.split(", ")]

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def blob(rows: list) -> pa.RecordBatch:
            ids, rids, vectors = zip(*rows, strict=True)
            whole = np.zeros((len(rows), max(map(len, vectors))))
            for k, v in enumerate(vectors):
                whole[k, : len(v)] = v
            code, data = _coded(whole)
            parts = [np.array(ids, np.int64).tobytes(), np.array(rids, np.int64).tobytes(), data]
            return pa.RecordBatch.from_arrays([pa.array([rids[0]], pa.int64()), pa.array([len(rows)], pa.int32()), pa.array([code]), *(pa.array([p], pa.binary()) for p in parts)], names)

        for batch in it:
            col = batch.column(2)
            ends = np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, col.offset * 4)
            flat = col.values.to_numpy(zero_copy_only=False)
            for r, (i, d) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                v = np.array(flat[ends[r] : ends[r + 1]], np.float64)
                wide, most = len(v).bit_length(), float(np.abs(v).max(initial=0))
                kind = (wide, most >= 1 << 14, most >= 1e300)  # large numbers slow only their own shards
                rows = held.setdefault(kind, [])
                rows.append((i, d, v))
                if len(rows) >= min(size, max(1, BLOB_BYTES >> (3 + wide))):
                    yield blob(held.pop(kind))
        for rows in held.values():
            yield blob(rows)

    return pack


def _ordered(n: int) -> bytes:
    """Bytes in the order of the whole numbers."""
    size = (abs(n).bit_length() + 7) // 8
    plain = size.to_bytes(4, "big") + abs(n).to_bytes(size, "big")
    return b"\x01" + plain if n >= 0 else b"\x00" + bytes(255 - b for b in plain) + b"\xff"


def top_products(vectors: DataFrame, every: int = 50, top: int = TOP, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the ``top`` best rows for each query row, ties to the smaller id.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows
    but the query's own.  Rows with a null id, and vectors that are null or hold null
    or non-finite components, take no part.  Components that one of two vectors lacks
    count as 0, so an empty vector scores 0.  A repeated id is queried once for each
    row, and its other rows are candidates.  Scores are compared as whole numbers of
    any size; one that a long does not hold is returned as the nearest long.
    """
    x = F.col("v").cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null")
    rows = rows.where(~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    rows = materialize(rows.select("id", F.monotonically_increasing_id().alias("rid"), x.alias("v")), "vectors")
    asked = rows.where(F.col("id") % every == 0)
    packed = lambda df, size: df.repartition(max(1, -(-df.count() // size))).mapInArrow(_packed(size), _BLOB)
    shards, blocks = materialize(packed(rows, SHARD), "shards"), materialize(packed(asked, BLOCK), "blocks")
    parts, asks = (max(1, -(-df.count() // size)) for df, size in ((shards, GROUP), (blocks, ASKED)))

    own = lambda n: F.pmod(F.xxhash64("blob"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cells = min(parts * asks, 20_000)
    keys = ["part", "ask"]
    left = shards.withColumn("part", own(parts)).withColumn("ask", each(asks)).repartition(cells, *keys)
    right = blocks.withColumn("ask", own(asks)).withColumn("part", each(parts)).repartition(cells, *keys)

    def searched(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        get = lambda r, name: np.frombuffer(r[name], np.int64)
        held = left.select(["n", "code", "ids", "rids", "vectors"]).to_pylist()
        for k in range(right.num_rows):
            b = right.slice(k, 1).to_pylist()[0]
            qids, qrids, queries = get(b, "ids"), get(b, "rids"), _decoded(b["code"], b["vectors"], b["n"])
            best: list[list[tuple]] = [[] for _ in qids]
            for s in held:
                search_shard(get(s, "ids"), get(s, "rids"), _decoded(s["code"], s["vectors"], s["n"]), queries, qrids, best, top)
            out += [(int(r), int(q), -n, v) for r, q, found in zip(qrids, qids, best, strict=True) for n, v, _ in found]
        qrid, qid, score, found = zip(*out, strict=True) if out else ((),) * 4
        near = [max(-_LONG, min(_LONG - 1, n)) for n in score]
        wide = [_ordered(n) if n != m else None for n, m in zip(score, near, strict=True)]
        cols = [pa.array(c, pa.int64()) for c in (qrid, qid, near)]
        return pa.table([*cols, pa.array(wide, pa.binary()), pa.array(found, pa.int64())], names)

    names = ["qrid", "query_id", "score", "wide", id_col]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(searched, f"qrid long, query_id long, score long, wide binary, `{id_col}` long")
    # Scores beyond the longs tie at one end of them: above, those with exact bytes come first, below, last.
    exact = [F.when(F.col("score") > 0, F.col("wide")).desc_nulls_last(), F.when(F.col("score") < 0, F.col("wide")).desc_nulls_first()]
    rank = F.row_number().over(Window.partitionBy("qrid").orderBy(F.col("score").desc(), *exact, id_col))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", id_col, "score")
