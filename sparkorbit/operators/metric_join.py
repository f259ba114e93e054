"""Exact nearest neighbours among any number of points: a metric join by pivots.

Points go to the Voronoi cell of their nearest pivot; crowded cells are split into
blocks.  A query first meets the blocks nearest to it that hold enough points, which
bounds the distance of its k-th neighbour; by the triangle inequality it is then copied
only to the blocks that can beat that bound.  Queries of one block are dealt out again
by number, so no group of rows is larger than a stated size, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import by_rows
from ..functions.stored import stored

#: Bytes of the vectors, as doubles, of a block or of the queries that meet it in one task: as many of either as
#: make ``SIDE`` groups, but no less than ``LEAST_BYTES`` and no more than ``MOST_BYTES``.  Copies of vectors that are
#: shuffled go with the square of the points over this size.
LEAST_BYTES, BLOCK_BYTES, SIDE = 4 << 20, 8 << 20, 8
#: Values of the matrix of distances that a task holds.
TILE_VALUES = 1 << 20
#: Pivots, which every task holds.
MOST_PIVOTS = 1024
_FOUND = "q long, src long, dst long, d2 double"


def error_share(dim: int) -> float:
    """|x|^2 + |p|^2 - 2xp is off by less than this share of |x|^2 + |p|^2, the rounding of the exact distance included."""
    return 4 * (dim + 8) * np.finfo(np.float64).eps


def _own_places(mine: np.ndarray, ids: np.ndarray, by_id: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, point) of the points that have the id of a row; ``by_id`` orders the ids."""
    held = ids[by_id]
    first, after = np.searchsorted(held, mine), np.searchsorted(held, mine, "right")
    size = after - first
    row = np.repeat(np.arange(len(mine)), size)
    return row, by_id[np.repeat(first - np.cumsum(size) + size, size) + np.arange(len(row))]


def nearest(x: np.ndarray, own: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int, exclude_self: bool, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, id and squared distance of the k nearest points of each x, ties to the smaller id, in order.

    A rough distance picks all points that its rounding leaves among the nearest k,
    however many tie; those are ranked by the exact one.  ``within`` bounds the squared
    distance of each row: points that are surely beyond are left out.
    """
    square, share = (points * points).sum(axis=1), error_share(points.shape[1])
    most, step, by_id = square.max(initial=0.0), max(1, (1 << 20) // points.shape[1]), np.argsort(ids, kind="stable")
    k = min(k, len(ids))
    cols: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
    few = max(16, min(128, TILE_VALUES // max(1, len(ids))))
    for at in range(0, len(x) if k > 0 else 0, few):
        part, mine = x[at : at + few], own[at : at + few]
        with np.errstate(all="ignore"):
            norm = (part * part).sum(axis=1)
            rough = part @ points.T
            rough *= -2
            rough += square
            rough += norm[:, None]
            off = share * (norm + most) + 1e-300
        unsure = not (np.isfinite(norm).all() and np.isfinite(most) and np.isfinite(rough).all())
        if unsure:  # overflow: any of these may be near
            rough[~np.isfinite(rough)] = -np.inf
            off[:] = np.inf
        same = _own_places(mine, ids, by_id) if exclude_self else None
        if same is not None:
            rough[same] = np.inf
        if unsure:
            near_enough = np.ones(rough.shape, bool)
        elif within is not None:
            near_enough = rough <= (within[at : at + few] * (1 + 1e-9) + off)[:, None]
        else:
            near_enough = rough <= (np.partition(rough, k - 1, axis=1)[:, k - 1] + 2 * off)[:, None]
        if same is not None:
            near_enough[same] = False
        for r in range(len(part)):
            cand = np.flatnonzero(near_enough[r])
            with np.errstate(over="ignore"):
                d2 = np.concatenate([((part[r] - points[cand[i : i + step]]) ** 2).sum(axis=1) for i in range(0, max(1, len(cand)), step)])
            order = np.lexsort((ids[cand], d2))[:k]
            for c, v in zip(cols, (np.full(len(order), at + r), ids[cand[order]], d2[order]), strict=True):
                c.append(v)
    return tuple(np.concatenate(c) for c in cols)


def vectors(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """The rows of a list column as a matrix; vectors of another size, null or not finite, are refused."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    sizes = column.value_lengths()
    if column.null_count or flat.null_count or (len(column) and (sizes.to_numpy(zero_copy_only=False) != dim).any()):
        raise ValueError(f"a point has {dim} components, none of them null")
    out = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)
    if not np.isfinite(out).all():
        raise ValueError("a component is not finite")
    return out


class _Cells:
    """The pivots, and count and radii of the blocks of their cells."""

    def __init__(self, pivots: np.ndarray) -> None:
        self.pivots = pivots
        self.cell = self.count = np.zeros(0, np.int64)
        self.least = self.most = np.zeros(0)

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the distance of each x to each pivot."""
        norms = (x * x).sum(axis=1)[:, None] + (self.pivots * self.pivots).sum(axis=1)
        rough, off = norms - 2 * x @ self.pivots.T, norms * error_share(x.shape[1]) + 1e-300
        return np.sqrt(np.maximum(rough - off, 0)), np.sqrt(np.maximum(rough + off, 0))

    def first(self, low: np.ndarray, q: int, enough: int) -> np.ndarray:
        """Blocks from the nearest pivot on until they hold enough points; of a crowded cell another one for each query."""
        order = np.lexsort(((np.arange(len(self.cell)) + q) % len(self.cell), low[self.cell]))
        return order[: int(np.searchsorted(np.cumsum(self.count[order]), enough)) + 1]

    def beat(self, low: np.ndarray, high: np.ndarray, d2: float) -> np.ndarray:
        """Blocks that may hold a point within the squared distance."""
        bound = np.maximum(low[self.cell] - self.most, self.least - high[self.cell]) - 1e-9 * (high[self.cell] + self.most)
        return np.flatnonzero(np.maximum(bound, 0) ** 2 <= d2 * (1 + 1e-9))


def _group_rows(n: int, dim: int) -> int:
    """Rows of a group of n vectors."""
    return max(64, min(BLOCK_BYTES // (8 * dim), max(LEAST_BYTES // (8 * dim), -(-n // SIDE))))


def _narrow(points: DataFrame) -> bool:
    """Whether every component is one of single precision, as which it is moved at half the bytes."""
    whole = F.forall("v", lambda x: F.coalesce(x.cast("float").cast("double") == x, F.lit(False)))
    return bool(points.agg(F.min(F.coalesce(whole, F.lit(True)).cast("int"))).first()[0])


def _assign(points: DataFrame, cells: _Cells) -> DataFrame:
    """(id, v, cell, r): the nearest pivot of each point and its distance."""
    dim = cells.pivots.shape[1]

    def near(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x = vectors(b["v"], dim)
            cell = cells.distances(x)[0].argmin(axis=1) if len(x) else np.zeros(0, np.int64)
            r = np.sqrt(((x - cells.pivots[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([b["id"], b["v"], pa.array(cell, pa.int32()), pa.array(r)], ["id", "v", "cell", "r"])

    return points.select("id", "v").mapInArrow(near, "id long, v array<double>, cell int, r double")


def _wanted(queries: DataFrame, cells: _Cells, enough: int, bounded: bool) -> DataFrame:
    """(q, block): the first blocks of a query, or all others that can beat its bound ``d2`` (null: any can)."""
    dim = cells.pivots.shape[1]

    def want(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            q = b["q"].to_numpy(zero_copy_only=False)
            low, high = cells.distances(vectors(b["v"], dim))
            d2 = b["d2"].to_pylist() if bounded else []
            to = []
            for i, number in enumerate(q.tolist()):
                blocks = cells.first(low[i], number, enough)
                if bounded:
                    blocks = np.setdiff1d(cells.beat(low[i], high[i], np.inf if d2[i] is None else d2[i]), blocks)
                to.append(blocks)
            sizes = [len(t) for t in to]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, sizes)), pa.array(np.concatenate([np.zeros(0, np.int64), *to]), pa.int32())], ["q", "block"])

    cols = ["q", "v", "d2"] if bounded else ["q", "v"]
    return queries.select(*cols).mapInArrow(want, "q long, block int")


def _meet(queries: DataFrame, wanted: DataFrame, points: DataFrame, k: int, dim: int, exclude_self: bool, query_rows: int) -> DataFrame:
    """(q, src, dst, d2): of each query and block, the k nearest points of the block, none surely beyond the query's ``d2``.

    Vectors of single precision are computed with as doubles, which changes nothing.
    """
    wanted = stored(wanted)
    share = wanted.groupBy("block").agg(F.ceil(F.count("*") / query_rows).cast("int").alias("shares"))
    share = stored(share)  # a row for each block
    copies = wanted.join(F.broadcast(share), "block").select("q", "block", F.pmod(F.xxhash64("q"), "shares").cast("int").alias("share")).join(queries.select("q", "src", "v", "d2"), "q")
    spread = points.join(F.broadcast(share), "block").select("block", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "id", "v")

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        q, src = left["q"].to_numpy(), left["src"].to_numpy()
        if not len(q):
            row, dst, d2 = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        else:
            within = left["d2"].to_numpy()
            within = np.where(np.isnan(within), np.inf, within) if np.isfinite(within).any() else None
            row, dst, d2 = nearest(vectors(left["v"], dim), src, vectors(right["v"], dim), right["id"].to_numpy(), k, exclude_self, within)
        return pa.table({"q": q[row], "src": src[row], "dst": dst, "d2": d2})

    return copies.groupBy("block", "share").cogroup(spread.groupBy("block", "share")).applyInArrow(tile, _FOUND)


def knn_by_pivots(queries: DataFrame, landmarks: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", exclude_self: bool = False, block_rows: int | None = None) -> DataFrame:
    """(src, dst, rank, d2): exact nearest landmarks of each query, ties to the smaller id, for any number of either.

    Of equal landmarks only the k + 1 of the smallest ids can be neighbours; the others
    are left out before anything is joined.  Each row of ``queries`` is a query of its
    own, equal ids or not; null ids are refused, and so are vectors that are null, of
    another size or not finite.  ``block_rows`` sets the size of a block in rows.
    """
    with by_rows(queries.sparkSession):  # a row is a vector
        return _knn_by_pivots(queries, landmarks, k, id_col, vector_col, exclude_self, block_rows)


def _knn_by_pivots(queries: DataFrame, landmarks: DataFrame, k: int, id_col: str, vector_col: str, exclude_self: bool, block_rows: int | None) -> DataFrame:
    spark = queries.sparkSession
    known = lambda df: F.when(F.col(id_col).isNotNull(), F.col(id_col).cast("long")).otherwise(F.raise_error(F.lit("a point has no id")).cast("long"))
    points = landmarks.select(known(landmarks).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    number = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    points = stored(points.withColumn("_n", number).where(F.col("_n") <= k + 1).drop("_n"))
    n, moved = points.count(), "array<float>" if _narrow(points) else "array<double>"
    if not n or k < 1:
        return spark.createDataFrame([], "src long, dst long, rank int, d2 double")
    dim = points.select(F.size("v")).first()[0]
    rows = block_rows or _group_rows(n, dim)
    some = points.orderBy(F.xxhash64("id"), "id").limit(min(MOST_PIVOTS, -(-n // rows))).collect()
    cells = _Cells(np.array([r["v"] for r in some], np.float64))

    placed = stored(_assign(points, cells))
    parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / rows).cast("int").alias("parts"))  # a row for each pivot
    blocks = placed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    sizes = blocks.groupBy("cell", "part").agg(F.count("*").alias("n"), F.min("r").alias("least"), F.max("r").alias("most")).orderBy("cell", "part").collect()  # a row for each block
    named = spark.createDataFrame([(r["cell"], r["part"], i) for i, r in enumerate(sizes)], "cell int, part int, block int")
    cells.cell, cells.count = np.array([r["cell"] for r in sizes]), np.array([r["n"] for r in sizes])
    cells.least, cells.most = np.array([r["least"] for r in sizes]), np.array([r["most"] for r in sizes])
    points = stored(blocks.join(F.broadcast(named), ["cell", "part"]).select("block", "id", F.col("v").cast(moved).alias("v")))

    asked = queries.select(known(queries).alias("src"), F.col(vector_col).cast("array<double>").alias("v")).withColumn("q", F.monotonically_increasing_id())
    asked = stored(asked)
    if _narrow(asked):
        asked = asked.withColumn("v", F.col("v").cast("array<float>"))
    query_rows = _group_rows(asked.count(), dim) if block_rows is None else 2 * block_rows
    meet = lambda asked, wanted: stored(_meet(asked, wanted, points, k, dim, exclude_self, query_rows))
    near = meet(asked.withColumn("d2", F.lit(None).cast("double")), _wanted(asked, cells, k + int(exclude_self), False))
    order = Window.partitionBy("q").orderBy("d2", "dst")
    bound = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("q", "d2")
    asked = stored(asked.join(bound, "q", "left"))
    far = meet(asked, _wanted(asked, cells, k + int(exclude_self), True))
    best = near.unionByName(far).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("src", "dst", "rank", "d2")
