"""Self-tuning k-nearest-neighbour graphs, kernel posteriors, and the graph operator.

Up to ``MAX_LANDMARKS`` landmarks (graph vertices) are broadcast, and queries of any
number stream past them in Arrow batches; more landmarks are joined by pivots.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prefix import range_bin
from ..functions.scalars import information, information_bound
from ..functions.stored import stored
from .features import column_quantiles
from .metric_join import knn_by_pivots, nearest, vectors

MAX_LANDMARKS = 20_000
FLOOR = 1e-12
#: Queries, and landmarks, of a tile of dense affinities, and the share of the norms below which a difference of them is not used.
TILE_ROWS, CANCELS = 2048, 1e-3


def _matrix(vertices: DataFrame, id_col: str, vector_col: str) -> tuple[np.ndarray, np.ndarray]:
    rows = vertices.select(id_col, vector_col).limit(MAX_LANDMARKS + 1).collect()
    if len(rows) > MAX_LANDMARKS:
        raise ValueError(f"a graph has at most {MAX_LANDMARKS} vertices: sample first")
    rows.sort(key=lambda r: r[0])
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)


def knn(queries: DataFrame, landmarks: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", exclude_self: bool = False) -> DataFrame:
    """(src, dst, rank, d2): exact nearest landmarks of each query, ties to the smaller id.

    Up to ``MAX_LANDMARKS`` landmarks are broadcast; more are joined by pivots.
    """
    if landmarks.limit(MAX_LANDMARKS + 1).count() > MAX_LANDMARKS:
        return knn_by_pivots(queries, landmarks, k, id_col, vector_col, exclude_self)
    ids, points = _matrix(landmarks, id_col, vector_col)
    k = min(k, len(ids) - int(exclude_self))
    held = queries.sparkSession.sparkContext.broadcast((ids, points))

    def near(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, points = held.value
        if k < 1:
            return
        for batch in it:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            row, dst, d2 = nearest(np.array(batch.column(1).to_pylist(), np.float64), own, points, ids, k, exclude_self)
            first = np.searchsorted(row, row)
            yield pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(dst), pa.array((np.arange(len(row)) - first + 1).astype(np.int32)), pa.array(d2)], ["src", "dst", "rank", "d2"])

    return queries.select(F.col(id_col).cast("long"), vector_col).mapInArrow(near, "src long, dst long, rank int, d2 double")


def local_scales(neighbours: DataFrame, k_sigma: int) -> DataFrame:
    """(id, sigma): distance to the k_sigma-th neighbour; zero takes the median of the positive ones."""
    s = neighbours.where(F.col("rank") == k_sigma).select(F.col("src").alias("id"), F.sqrt("d2").alias("sigma"))
    if s.where("not sigma > 0").isEmpty():
        return s
    counts: dict[str, int] = {}
    middle = column_quantiles(s, {"sigma": F.when(F.col("sigma") > 0, F.col("sigma"))}, [0.5], counts)["sigma"][0]
    return s.select("id", F.when(F.col("sigma") > 0, F.col("sigma")).otherwise(F.lit(middle if counts["sigma"] else 1.0)).alias("sigma"))


def _weight(d2: Column, a: Column, b: Column) -> Column:
    return F.exp(-d2 / F.greatest(a * b, F.lit(FLOOR)))


def self_tuning_graph(vertices: DataFrame, k: int = 8, k_sigma: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst, w), both directions and symmetric, and scales (id, sigma).

    w is the mean over both directions of exp(-d2 / (sigma_i sigma_j)); a vertex is
    never its own neighbour.
    """
    n = vertices.count()
    if n < 3:
        raise ValueError("a graph has three vertices or more")
    near = stored(knn(vertices, vertices, max(2, min(k, n - 1)), id_col, vector_col, exclude_self=True))
    scales = local_scales(near, min(k_sigma, k, n - 1))
    w = near.join(scales.toDF("src", "_a"), "src").join(scales.toDF("dst", "_b"), "dst").select("src", "dst", _weight(F.col("d2"), F.col("_a"), F.col("_b")).alias("w"))
    both = w.union(w.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.groupBy("src", "dst").agg((F.sum("w") / 2).alias("w")), scales


def query_affinities(queries: DataFrame, landmarks: DataFrame, k: int = 8, k_sigma: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(src, dst, w): weights of each query's nearest landmarks.

    A query's scale of zero takes the median scale of the landmarks, so the result
    does not depend on how queries are batched.
    """
    near_l = stored(knn(landmarks, landmarks, min(k, k_sigma), id_col, vector_col, exclude_self=True))
    scales = local_scales(near_l, min(k_sigma, k))
    near = stored(knn(queries, landmarks, k, id_col, vector_col))
    own = near.where(F.col("rank") == min(k_sigma, k)).select("src", F.sqrt("d2").alias("_s"))
    middle = scales.agg(F.median("sigma").alias("_m"))
    own = own.crossJoin(F.broadcast(middle)).select("src", F.when(F.col("_s") > 0, F.col("_s")).otherwise(F.col("_m")).alias("_a"))
    return near.join(own, "src").join(scales.toDF("dst", "_b"), "dst").select("src", "dst", _weight(F.col("d2"), F.col("_a"), F.col("_b")).alias("w"))


def _numbered(points: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(place, v): the points with their places, from 0, in the order of the ids; no task orders all of them."""
    points = stored(points.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")))
    binned = stored(points.withColumn("bin", range_bin(points, "id")))
    before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sizes = binned.groupBy("bin").agg(F.count("*").alias("n")).select("bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))  # a row for each range
    return binned.join(F.broadcast(sizes), "bin").select((F.col("first") + F.row_number().over(Window.partitionBy("bin").orderBy("id", "v")) - 1).alias("place"), "v")


def _weights(x: np.ndarray, own: np.ndarray, points: np.ndarray, sigma: np.ndarray) -> Iterator[np.ndarray]:
    """Weights of all points for 64 rows of x at a time; distances that cancel are taken from the differences."""
    square = (points * points).sum(axis=1)
    most = square.max(initial=0.0)
    for at in range(0, len(x), 64):
        part = x[at : at + 64]
        norm = (part * part).sum(axis=1)[:, None]
        d2 = part @ points.T
        d2 *= -2
        d2 += square
        d2 += norm
        r, c = np.nonzero(~(d2 > CANCELS * (norm + most)) | np.isinf(d2))
        for i in range(0, len(r), 1 << 16):
            some = slice(i, i + (1 << 16))
            d2[r[some], c[some]] = ((part[r[some]] - points[c[some]]) ** 2).sum(axis=1)
        d2 /= -np.maximum(own[at : at + 64, None] * sigma, FLOOR)
        yield np.exp(d2, out=d2)


def dense_affinities(queries: DataFrame, landmarks: DataFrame, k_sigma: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(src, q, first, w: array): weights of all landmarks, by id, for each query; of the scales of ``query_affinities``.

    Each query has a number ``q`` of its own.  Up to ``MAX_LANDMARKS`` landmarks make one row
    for each query; of more, a row holds those of ``TILE_ROWS`` places, the first of which is
    ``first``, and tiles of queries and landmarks meet in tasks that hold neither side whole.
    """
    if landmarks.limit(MAX_LANDMARKS + 1).count() > MAX_LANDMARKS:
        return _dense_tiles(queries, landmarks, k_sigma, id_col, vector_col)
    ids, points = _matrix(landmarks, id_col, vector_col)
    near_l = stored(knn(landmarks, landmarks, k_sigma, id_col, vector_col, exclude_self=True))
    scales = {r["id"]: r["sigma"] for r in local_scales(near_l, min(k_sigma, max(1, len(ids) - 1))).collect()}
    sigma = np.array([scales[i] for i in ids.tolist()], np.float64)
    middle = float(np.median(sigma)) if len(sigma) else 1.0
    held = queries.sparkSession.sparkContext.broadcast((points, sigma))

    def weigh(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, sigma = held.value
        k = min(k_sigma, len(points))
        for batch in it:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                x = np.array(part.column(2).to_pylist(), np.float64)
                d2 = np.stack([((points - v) ** 2).sum(axis=1) for v in x])
                own = np.sqrt(np.partition(d2, k - 1, axis=1)[:, k - 1]) if k else np.zeros(len(x))
                own = np.where(own > 0, own, middle)
                w = np.exp(-d2 / np.maximum(own[:, None] * sigma, FLOOR))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.zeros(len(x), np.int64)), pa.array(list(w))], ["src", "q", "first", "w"])

    return queries.select(F.col(id_col).cast("long").alias("src"), F.monotonically_increasing_id().alias("q"), vector_col).mapInArrow(weigh, "src long, q long, first long, w array<double>")


def _dense_tiles(queries: DataFrame, landmarks: DataFrame, k_sigma: int, id_col: str, vector_col: str) -> DataFrame:
    """``dense_affinities`` of any number of landmarks: groups of queries by groups of landmarks."""
    marks = stored(_numbered(landmarks, id_col, vector_col))
    asked = stored(queries.select(F.col(id_col).cast("long").alias("src"), F.monotonically_increasing_id().alias("q"), F.col(vector_col).cast("array<double>").alias("v")))
    scales = stored(local_scales(knn(marks, marks, k_sigma, "place", "v", exclude_self=True), k_sigma))
    middle = scales.agg(F.median("sigma")).first()[0]
    far = knn(asked, marks.withColumnRenamed("place", "q"), k_sigma, "q", "v").where(F.col("rank") == k_sigma).select(F.col("src").alias("q"), F.sqrt("d2").alias("_s"))
    asked = asked.join(far, "q").withColumn("own", F.when(F.col("_s") > 0, F.col("_s")).otherwise(F.lit(middle)))
    rows, m, n = TILE_ROWS, scales.count(), queries.count()
    groups, tiles = max(1, -(-n // rows)), -(-m // rows)
    span = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = asked.select(F.pmod(F.xxhash64("q"), F.lit(groups)).cast("int").alias("group"), span(tiles).alias("tile"), "src", "q", "v", "own")
    right = marks.join(scales.toDF("place", "sigma"), "place").select(span(groups).alias("group"), F.floor(F.col("place") / rows).cast("int").alias("tile"), "place", "v", "sigma")

    def weigh(asked: pa.Table, marks: pa.Table) -> pa.Table:
        schema = pa.schema({"src": pa.int64(), "q": pa.int64(), "first": pa.int64(), "w": pa.list_(pa.float64())})
        if not asked.num_rows:
            return schema.empty_table()
        marks = marks.sort_by("place")
        dim, at, out = len(marks["v"][0]), 0, []
        x, points = vectors(asked["v"], dim), vectors(marks["v"], dim)
        for w in _weights(x, asked["own"].to_numpy(), points, marks["sigma"].to_numpy()):
            part = asked.slice(at, len(w)).combine_chunks()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1]), pa.int32()), pa.array(w.ravel()))
            first = pa.array(np.full(len(w), marks["place"][0].as_py()))
            out.append(pa.table([part["src"], part["q"], first, lists], schema=schema))
            at += len(w)
        return pa.concat_tables(out)

    return left.groupBy("group", "tile").cogroup(right.groupBy("group", "tile")).applyInArrow(weigh, "src long, q long, first long, w array<double>")


def affinity_totals(affinities: DataFrame, period: int) -> DataFrame:
    """(src, q, n, total, most, placed) of each query of ``dense_affinities``: number, sum and largest of its weights, and their sum by place modulo ``period``."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            w, size, first = b["w"].flatten().to_numpy(zero_copy_only=False), b["w"].value_lengths().to_numpy(zero_copy_only=False), b["first"].to_numpy()
            total, most, placed = np.zeros(len(size)), np.zeros(len(size)), np.zeros(len(size))
            upto = np.cumsum(size, dtype=np.int64)
            for r in np.flatnonzero(size):
                row = w[upto[r] - size[r] : upto[r]]
                total[r], most[r], placed[r] = row.sum(), row.max(), row @ (np.arange(first[r], first[r] + size[r]) % period)
            yield pa.RecordBatch.from_arrays([b["src"], b["q"], pa.array(size, pa.int64()), pa.array(total), pa.array(most, mask=size == 0), pa.array(placed)], ["src", "q", "n", "total", "most", "placed"])

    parts = affinities.select("src", "q", "first", "w").mapInArrow(run, "src long, q long, n long, total double, most double, placed double")
    return parts.groupBy("src", "q").agg(*(f(c).alias(c) for c, f in (("n", F.sum), ("total", F.sum), ("most", F.max), ("placed", F.sum))))


def class_priors(labels: DataFrame, label: str = "y") -> DataFrame:
    """(prior0, prior1) of labels 0 and 1; a missing class gives null."""
    p = F.avg(label)
    return labels.agg(F.when((p > 0) & (p < 1), 1 - p).alias("prior0"), F.when((p > 0) & (p < 1), p).alias("prior1"))


def kernel_posterior(edges: DataFrame, labels: DataFrame, lambda0: float = 1.0, eps: float = 1e-12, id_col: str = "id", label: str = "y") -> DataFrame:
    """(id, degree, p1): weighted votes of the neighbours, smoothed by the priors; own labels take no part."""
    priors = class_priors(labels, label)
    votes = edges.join(labels.select(F.col(id_col).alias("dst"), F.col(label).alias("_y")), "dst")
    votes = votes.groupBy("src").agg(F.sum("w").alias("degree"), F.sum(F.col("w") * F.col("_y")).alias("_v1")).crossJoin(F.broadcast(priors))
    raw1 = (F.col("_v1") + lambda0 * F.col("prior1")) / (F.col("degree") + lambda0)
    raw0 = (F.col("degree") - F.col("_v1") + lambda0 * F.col("prior0")) / (F.col("degree") + lambda0)
    c1, c0 = F.greatest(raw1, F.lit(eps)), F.greatest(raw0, F.lit(eps))
    return votes.select(F.col("src").alias(id_col), "degree", (c1 / (c0 + c1)).alias("p1"), "prior1")


def information_potential(posterior: DataFrame) -> DataFrame:
    """``posterior`` with the information ``j`` over the priors and the potential ``v`` = max(bound - j, 0)."""
    j = information(F.col("p1"), F.col("prior1"))
    return posterior.withColumn("j", j).withColumn("v", F.greatest(information_bound(F.col("prior1")) - F.col("j"), F.lit(0.0)))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("degree"))


def laplacian(edges: DataFrame) -> DataFrame:
    """(src, dst, value): entries of I - D^-1/2 W D^-1/2."""
    d = degrees(edges)
    off = edges.join(d.toDF("src", "_a"), "src").join(d.toDF("dst", "_b"), "dst").select("src", "dst", (-F.col("w") / F.sqrt(F.col("_a") * F.col("_b"))).alias("value"))
    one = d.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("value"))
    return off.union(one).groupBy("src", "dst").agg(F.sum("value").alias("value"))


def graph_operator(entries: DataFrame, potential: DataFrame, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """(src, dst, value): entries of alpha L + beta V, V the diagonal of (id, v)."""
    if alpha <= 0 or beta < 0:
        raise ValueError("alpha is positive, beta not negative")
    diagonal = potential.select(F.col("id").alias("src"), F.col("id").alias("dst"), (F.lit(beta) * F.col("v")).alias("value"))
    both = entries.select("src", "dst", (F.lit(alpha) * F.col("value")).alias("value")).union(diagonal)
    return both.groupBy("src", "dst").agg(F.sum("value").alias("value"))


def rayleigh(entries: DataFrame, vector: DataFrame) -> DataFrame:
    """One row: x' H x / x' x of a vector (id, x)."""
    hx = entries.join(vector.toDF("dst", "_x"), "dst").groupBy("src").agg(F.sum(F.col("value") * F.col("_x")).alias("_h"))
    return hx.join(vector.toDF("src", "_x"), "src").agg((F.sum(F.col("_h") * F.col("_x")) / F.sum(F.col("_x") * F.col("_x"))).alias("rayleigh"))


def degree_summary(edges: DataFrame) -> DataFrame:
    d = degrees(edges)
    n = edges.agg(F.count("*").alias("nnz"))
    return d.agg(F.min("degree").alias("least"), F.median("degree").alias("middle"), F.max("degree").alias("most")).crossJoin(n)


def ranked_neighbours(edges: DataFrame) -> DataFrame:
    """Edges with their place among the edges of a vertex, by weight."""
    return edges.withColumn("place", F.row_number().over(Window.partitionBy("src").orderBy(F.col("w").desc(), "dst")))
