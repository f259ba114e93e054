"""Smallest eigenpairs of a symmetric sparse operator that is spread over the cluster.

Block Lanczos with the three-term recurrence.  Vertices and entries are dealt into blocks
by source, and the vertices of a block into chunks.  A product is one shuffle: a chunk sends
each block the values that its entries need, in a fixed order, so that no ids go along.
The basis is written as it grows, without its copies, and read once, for the vectors of the
pairs; what a step has shuffled is removed when it is written.  The driver sees only matrices
of the number of basis vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import by_rows
from ..functions.stored import release, stored, together

#: Entries of a block, which one task holds: 12 bytes each, and at most as many rows of values.  Fewer blocks need fewer copies of a row.
BLOCK_ENTRIES = 1_000_000
#: Vertices of a chunk, of which one task holds the whole basis, and vectors of a basis.
CHUNK, BASIS = 2048, 3072
#: Entries whose products a task holds at a time.
STRIP = 1 << 16
#: Bases at most, steps between two looks at the pairs, and the residual norm at which a pair has converged.
ROUNDS, LOOK, TOLERANCE = 12, 5, 1e-8
_LAYOUT = "block int, chunk int, ids array<long>, dests array<int>, counts array<int>, places array<short>"
_STATE = "block int, chunk int, step int, dests array<int>, counts array<int>, places array<short>, now array<double>, then array<double>, gram array<double>"
_SENT = "block int, home int, chunk int, now array<double>, before array<double>, dests array<int>, counts array<int>, places array<short>"

Mix = Callable[[int, int, int, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _floats(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """All values of a column of lists, as rows of ``width``; a copy."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in parts]
    return np.concatenate([np.zeros(0), *flat]).reshape(-1, width) if width else np.zeros((0, 0))


def _lists(rows: list[np.ndarray | None], kind: pa.DataType) -> pa.Array:
    """A list for each array, null for none."""
    return pa.array([None if x is None else np.asarray(x, kind.to_pandas_dtype()).ravel() for x in rows], pa.list_(kind))


def _one(table: pa.Table, name: str, row: int = 0) -> np.ndarray:
    return table[name][row].values.to_numpy(zero_copy_only=False)


def _packed(entries: DataFrame, blocks: int) -> DataFrame:
    """(block, first, col, value, ids) of each block, its rows of entries, and (block, dest, ids): of each block, what another needs.

    A column is a place among the values that a block gets, in the order of their blocks and ids.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    dealt = entries.select(F.col("src").cast("long"), F.col("dst").cast("long"), F.col("value").cast("double")).select(place("src").alias("block"), place("dst").alias("home"), "src", "dst", "value")

    def pack(t: pa.Table) -> pa.Table:
        block = t["block"][0].as_py()
        home, src, dst, value = (t[c].to_numpy() for c in ("home", "src", "dst", "value"))
        by = np.lexsort((dst, home))
        new = np.concatenate(([True], (dst[by][1:] != dst[by][:-1]) | (home[by][1:] != home[by][:-1])))
        col = np.empty(len(by), np.int32)
        col[by] = np.cumsum(new) - 1
        needed, homes = dst[by][new], home[by][new]
        order = np.argsort(src, kind="stable")
        src = src[order]
        first = np.flatnonzero(np.concatenate(([True], src[1:] != src[:-1])))
        at = np.flatnonzero(np.concatenate(([True], homes[1:] != homes[:-1])))
        of = np.split(needed, at[1:])
        none = [None] * len(of)
        return pa.table({
            "block": pa.array([block, *homes[at].tolist()], pa.int32()), "dest": pa.array([None, *[block] * len(of)], pa.int32()), "ids": _lists([src[first], *of], pa.int64()),
            "first": _lists([first, *none], pa.int32()), "col": _lists([col[order], *none], pa.int32()), "value": _lists([value[order], *none], pa.float64()),
        })

    return dealt.groupBy("block").applyInArrow(pack, "block int, dest int, ids array<long>, first array<int>, col array<int>, value array<double>")


def _layout(packed: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunks of all blocks: their vertices, the blocks that they send to, and the places that each gets."""

    def deal(t: pa.Table) -> pa.Table:
        own = next(i for i, d in enumerate(t["dest"].to_pylist()) if d is None)
        ids, block = _one(t, "ids", own), t["block"][0].as_py()
        needs = sorted((d, np.searchsorted(ids, _one(t, "ids", i))) for i, d in enumerate(t["dest"].to_pylist()) if d is not None)
        rows = []
        for at in range(0, len(ids), chunk):
            parts = [(d, p[np.searchsorted(p, at) : np.searchsorted(p, at + chunk)] - at) for d, p in needs]
            parts = [(d, p) for d, p in parts if len(p)]
            rows.append((ids[at : at + chunk], np.array([d for d, _ in parts]), np.array([len(p) for _, p in parts]), np.concatenate([p for _, p in parts])))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int16())
        lists = [_lists([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        return pa.table([pa.array([block] * len(rows), pa.int32()), pa.array(np.arange(len(rows)), pa.int32()), *lists], ["block", "chunk", "ids", "dests", "counts", "places"])

    return packed.select("block", "dest", "ids").groupBy("block").applyInArrow(deal, _LAYOUT)


def _product(state: DataFrame, packed: DataFrame, blocks: int, widths: tuple[int, int, int], mix: Mix, back: np.ndarray | None, step: int) -> DataFrame:
    """The state of the next step: ``now`` and ``before`` are mixed from ``now`` and ``then``, ``then`` is H now - before back.

    ``widths`` are those of the state's vectors, of the new ones and of ``before``.  The first chunk of a block has the
    Gram matrix of now and then of the block.
    """
    old, width, past = widths

    def send(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for r in range(b.num_rows):
                row = pa.Table.from_batches([b.slice(r, 1)])
                home, chunk = row["block"][0].as_py(), row["chunk"][0].as_py()
                dests, counts, places = (_one(row, c) for c in ("dests", "counts", "places"))
                own = int(counts[np.flatnonzero(dests == home)[0]])  # an entry of its own for each vertex
                x, before = mix(home, chunk, own, _floats(row["now"], old), _floats(row["then"], old))
                parts = [x[p] for p in np.split(places, np.cumsum(counts)[:-1])]
                mine = lambda v: [v if d == home else None for d in dests]  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [pa.array(dests, pa.int32()), pa.array([home] * len(dests), pa.int32()), pa.array([chunk] * len(dests), pa.int32()), _lists(parts, pa.float64()),
                     _lists(mine(before), pa.float64()), _lists(mine(dests), pa.int32()), _lists(mine(counts), pa.int32()), _lists(mine(places), pa.int16())],
                    ["block", "home", "chunk", "now", "before", "dests", "counts", "places"])

    def times(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by([("home", "ascending"), ("chunk", "ascending")])
        block = right["block"][0].as_py()
        x = _floats(left["now"], width)
        first, col, value = (_one(right, c) for c in ("first", "col", "value"))
        out, ends = np.empty((len(first), width)), np.append(first, len(col))
        at = 0
        while at < len(first):  # strips of whole rows
            upto = max(at + 1, int(np.searchsorted(ends, ends[at] + STRIP, "right")) - 1)
            some = slice(ends[at], ends[upto])
            out[at:upto] = np.add.reduceat(value[some, None] * x[col[some]], first[at:upto] - ends[at], axis=0)
            at = upto
        sizes = left["now"].combine_chunks().value_lengths().to_numpy() // width
        begin = np.cumsum(sizes) - sizes
        mine = np.flatnonzero(left["home"].to_numpy() == block)
        x = x[begin[mine[0]] : begin[mine[-1]] + sizes[mine[-1]]]
        own = left.take(pa.array(mine))
        if past:
            out -= _floats(own["before"], past) @ back
        both = np.hstack((x, out))
        cut = np.cumsum(sizes[mine])[:-1]
        gram = [both.T @ both, *[None] * (len(mine) - 1)]
        columns = [own["block"], own["chunk"], pa.array(np.full(len(mine), step, np.int32)), own["dests"], own["counts"], own["places"], _lists(np.split(x, cut), pa.float64()), _lists(np.split(out, cut), pa.float64()), _lists(gram, pa.float64())]
        return pa.table(columns, ["block", "chunk", "step", "dests", "counts", "places", "now", "then", "gram"])

    sent = state.select("block", "chunk", "dests", "counts", "places", "now", "then").mapInArrow(send, _SENT)
    return sent.repartitionById(blocks, F.col("block")).groupBy("block").cogroup(packed.groupBy("block")).applyInArrow(times, _STATE)


def _gram(state: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """X'X, X'Y and Y'Y of X = now and Y = then: a matrix comes from each block."""
    total = np.zeros(4 * width * width)
    for r in state.where("gram is not null").select("gram").toLocalIterator():
        total += np.array(r["gram"])
    m = total.reshape(2 * width, 2 * width)
    return m[:width, :width], (m[:width, width:] + m[width:, :width]) / 2, m[width:, width:]


def _normal(g: np.ndarray, least: float) -> np.ndarray:
    """N such that N'GN is the identity; columns of a norm under ``least`` and dependent directions are left out."""
    d = np.sqrt(np.maximum(np.diag(g), 0))
    scale = np.where(d > least, 1 / np.maximum(d, least), 0)
    e, v = np.linalg.eigh(g * scale * scale[:, None])
    good = e > 1e-11
    return scale[:, None] * v[:, good] / np.sqrt(e[good])


def smallest_modes(entries: DataFrame, k: int, seed: int = 0, tolerance: float = TOLERANCE, block_entries: int = BLOCK_ENTRIES, basis: int = BASIS) -> tuple[list[float], DataFrame]:
    """The k smallest eigenvalues, ascending, and their vectors (id, u: array) of unit length.

    ``entries`` (src, dst, value) is symmetric and has the diagonal of every vertex, so
    each vertex is a source.  A basis of up to ``basis`` vectors grows until the pairs'
    residual norms are below ``tolerance``; then, or when it is full, the pairs start the
    next one.  Pairs that ``ROUNDS`` bases do not separate raise.
    """
    with by_rows(entries.sparkSession):  # a row of the state is a chunk, a packed one a block
        return _smallest_modes(entries, k, seed, tolerance, block_entries, basis)


def _smallest_modes(entries: DataFrame, k: int, seed: int, tolerance: float, block_entries: int, basis: int) -> tuple[list[float], DataFrame]:
    given = entries
    entries = stored(entries.groupBy("src", "dst").agg(F.sum("value").alias("value")))
    size = entries.agg(F.count("*").alias("nnz"), F.countDistinct("src").alias("n")).first()
    n, k = size["n"], min(k, size["n"])
    if not k:
        return [], given.select(F.col("src").alias("id"), F.array().cast("array<double>").alias("u"))
    # Every eigenvalue lies within a row's sum of absolute values (Gershgorin).
    top = entries.groupBy("src").agg(F.sum(F.abs("value")).alias("r")).agg(F.max("r")).first()[0] * (1 + 1e-9) + 1e-12
    enough = tolerance * max(1.0, top)
    blocks = max(1, -(-size["nnz"] // block_entries))
    dealt = stored(_packed(entries, blocks))
    release(entries)
    layout = stored(_layout(dealt))
    packed = dealt.where("dest is null").select("block", "first", "col", "value").repartitionById(blocks, F.col("block")).persist()  # each product meets it in place
    # As many vectors as pairs, so that none of equal values is missed; of few vertices all directions: the first projection is exact.
    width = n if n <= 3 * (k + 8) else max(k, 4)
    state, fresh = layout.withColumns({"now": F.array().cast("array<double>"), "then": F.array().cast("array<double>")}), True
    lead = np.zeros((0, 0))
    try:
        for round_ in range(ROUNDS):
            kept: list[DataFrame] = []
            parts: list[np.ndarray] = []  # N of each step: R N is orthonormal
            t = np.zeros((0, 0))

            def start(home, chunk, rows, now, then, lead=lead, round_=round_):  # noqa: ANN001, ANN202
                new = np.random.Generator(np.random.PCG64([seed, round_, home, chunk])).normal(size=(rows, width - lead.shape[1]))
                return np.hstack((now @ lead, new)) if lead.size else new, np.zeros((0, 0))

            mix: Mix = start
            widths, back = (lead.shape[0], width, 0), None
            while True:
                new = stored(_product(state, packed, blocks, widths, mix, back, len(kept)))
                if not kept and not fresh:
                    release(state)
                state, fresh = new, False
                g, a, w = _gram(state, widths[1])
                whole = bool(kept) and (len(t) + len(g) > min(basis, n) or np.diag(g).max() <= (enough / 10) ** 2)
                if whole or (len(t) >= k and (len(kept) % LOOK == 0 or len(t) <= 128)):
                    _, s = np.linalg.eigh(t)
                    s = s[:, np.linalg.norm(s[: parts[0].shape[1]], axis=0) > 1e-3 * np.sqrt(width / n)]  # without copies that rounding brings back: they have nothing of the start
                    last = s[len(t) - len(g) :, :k]  # H V s - theta V s = R last
                    if whole or (s.shape[1] >= k and np.einsum("ij,ik,kj->j", last, g, last).max() < (enough / 4) ** 2):
                        release(state)
                        break
                normal = _normal(g, enough / 10 if kept else 1e-300)
                alpha = normal.T @ a @ normal
                b = normal.shape[1]
                grown = np.zeros((len(t) + b, len(t) + b))
                grown[: len(t), : len(t)], grown[len(t) :, len(t) :] = t, alpha
                if len(t):
                    coupling = normal.T @ g
                    grown[len(t) :, len(t) - coupling.shape[1] : len(t)], grown[len(t) - coupling.shape[1] : len(t), len(t) :] = coupling, coupling.T
                t = grown
                kept.append(state)
                parts.append(normal)
                turn = np.vstack((-normal @ alpha, normal))
                back = turn.T @ np.block([[g, a], [a.T, w]]) @ turn  # R'R of the next R, which is Q'H R
                mix = lambda home, chunk, rows, now, then, n=normal, c=normal @ alpha: (then @ n - now @ c, now @ n)
                widths = (widths[1], b, b)

            many = min(s.shape[1], k + width)
            cuts = np.cumsum([p.shape[1] for p in parts])[:-1]
            mixed = [p @ c for p, c in zip(parts, np.split(s[:, :many], cuts), strict=True)]

            def combine(left: pa.Table, right: pa.Table) -> pa.Table:
                out = np.zeros((len(_one(right, "ids")), many))
                for r in range(left.num_rows):
                    c = mixed[left["step"][r].as_py()]
                    out += _one(left, "now", r).reshape(-1, len(c)) @ c
                zero = _lists([np.zeros(0)], pa.float64())
                return pa.table([*(right[c] for c in ("block", "chunk", "dests", "counts", "places")), _lists([out], pa.float64()), zero], ["block", "chunk", "dests", "counts", "places", "now", "then"])

            apart = lambda df: df.repartition(8 * blocks, "block", "chunk").groupBy("block", "chunk")
            rows = apart(together(kept).select("block", "chunk", "step", "now")).cogroup(apart(layout))
            pairs = rows.applyInArrow(combine, "block int, chunk int, dests array<int>, counts array<int>, places array<short>, now array<double>, then array<double>")
            same = lambda home, chunk, rows, now, then: (now, np.zeros((0, 0)))
            state = stored(_product(pairs, packed, blocks, (many, many, 0), same, None, 0))
            release(*kept)
            g, a, w = _gram(state, many)
            root = _normal(g, 1e-300)
            theta, turn = np.linalg.eigh(root.T @ a @ root)
            turn = root @ turn
            if len(theta) >= k and _residuals(state, many, turn[:, :k], theta[:k]).max() < enough:
                break
            lead = turn[:, : min(width, turn.shape[1])]
        else:
            raise ArithmeticError(f"{k} modes have not converged within {ROUNDS} rounds")
    finally:
        packed.unpersist()
    turn = turn[:, :k]

    def rotate(left: pa.Table, right: pa.Table) -> pa.Table:
        u = _floats(left["now"], many) @ turn
        return pa.table({"id": _one(right, "ids"), "u": _lists(list(u), pa.float64())})

    vectors = state.select("block", "chunk", "now").groupBy("block", "chunk").cogroup(layout.select("block", "chunk", "ids").groupBy("block", "chunk"))
    return theta[:k].tolist(), vectors.applyInArrow(rotate, "id long, u array<double>")


def _residuals(state: DataFrame, width: int, c: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Norms of H u - theta u of u = now c, summed directly."""

    def partial(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(theta))
        for b in it:
            for r in range(b.num_rows):
                x, y = (_floats(b[name].slice(r, 1), width) for name in ("now", "then"))
                total += ((y @ c - (x @ c) * theta) ** 2).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(theta))), pa.array(total)], ["at", "value"])

    rows = state.select("now", "then").mapInArrow(partial, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    return np.sqrt(np.array([r["value"] for r in sorted(rows, key=lambda r: r["at"])]))
