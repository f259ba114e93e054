"""Variable-length tracks of a jet as arrays of structs: order, transforms, summaries, relations."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

from ..functions.scalars import finite, signed_log1p

QUANTILES = (0.10, 0.25, 0.50, 0.75, 0.90)


def nest(tracks: DataFrame, jet: str, slot: list[str], fields: list[str]) -> DataFrame:
    """(jet, tracks): the tracks of each jet as an array in slot order."""
    return tracks.groupBy(jet).agg(F.array_sort(F.collect_list(F.struct(*slot, *[f for f in fields if f not in slot]))).alias("tracks"))


def top_k(tracks: Column, value: str, k: int) -> Column:
    """The k tracks of largest absolute value, ties and order by their slot."""
    n = F.size(tracks)
    keyed = F.transform(tracks, lambda t, i: F.struct((-F.abs(t[value])).alias("key"), i.alias("slot"), t.alias("t")))
    return F.when(n > 0, F.transform(F.slice(F.array_sort(keyed), 1, k), lambda x: x["t"])).otherwise(tracks)


#: The reconstructed fields of a track.
FIELDS = (
    "d0", "z0SinTheta", "dphi", "deta", "qOverP",
    "lifetimeSignedD0Significance", "lifetimeSignedZ0SinThetaSignificance",
    "phiUncertainty", "thetaUncertainty", "qOverPUncertainty",
    "numberOfPixelHits", "numberOfSCTHits",
    "numberOfInnermostPixelLayerHits", "numberOfNextToInnermostPixelLayerHits",
    "numberOfInnermostPixelLayerSharedHits", "numberOfInnermostPixelLayerSplitHits",
    "numberOfPixelSharedHits", "numberOfPixelSplitHits", "numberOfSCTSharedHits",
)
#: The transform of each track field; others stay as they are.
TRANSFORMS = {
    "d0": lambda x: signed_log1p(x),
    "z0SinTheta": lambda x: signed_log1p(x),
    "lifetimeSignedD0Significance": lambda x: signed_log1p(x),
    "lifetimeSignedZ0SinThetaSignificance": lambda x: signed_log1p(x),
    "qOverP": lambda x: signed_log1p(x, 1000.0),
    "qOverPUncertainty": lambda x: F.log1p(F.greatest(x * 1000.0, F.lit(0.0))),
    "phiUncertainty": lambda x: F.log1p(F.greatest(x, F.lit(0.0))),
    "thetaUncertainty": lambda x: F.log1p(F.greatest(x, F.lit(0.0))),
}


def transform_field(name: str, x: Column) -> Column:
    """The transformed field; null, NaN and infinite values become 0."""
    out = TRANSFORMS.get(name, lambda v: v)(x.cast("double"))
    return F.when(out.isNull() | F.isnan(out) | (F.abs(out) == float("inf")), F.lit(0.0)).otherwise(out)


def summaries(jets: DataFrame, tracks: DataFrame, jet: str, fields: list[str]) -> DataFrame:
    """Mean, deviation (population) and quantiles of each field over a jet's tracks.

    Null, NaN and infinite values count as missing; 0 without values.
    """
    aggs = []
    for f in fields:
        v = F.when(finite(F.col(f)), F.col(f))
        aggs += [F.avg(v).alias(f"{f}_mean"), F.stddev_pop(v).alias(f"{f}_std"), F.percentile(v, F.array(*map(F.lit, QUANTILES))).alias(f"_{f}")]
    per = tracks.groupBy(jet).agg(*aggs)
    names = [c for f in fields for c in (f"{f}_mean", f"{f}_std")]
    cols = [F.coalesce(c, F.lit(0.0)).alias(c) for c in names]
    cols += [F.coalesce(F.get(f"_{f}", F.lit(k)), F.lit(0.0)).alias(f"{f}_q{int(q * 100)}") for f in fields for k, q in enumerate(QUANTILES)]
    return jets.select(jet).join(per, jet, "left").select(jet, *cols)


def context(pt_mev: Column, eta: Column, n_tracks: Column) -> dict[str, Column]:
    """Log momentum in GeV, pseudorapidity with its size, and the number of tracks."""
    return {"log_pt": F.log1p(F.greatest(pt_mev / 1000, F.lit(0.0))), "eta": eta, "abs_eta": F.abs(eta), "n_tracks": n_tracks.cast("double")}


def observables(tracks: Column, significance: str, deta: str, dphi: str, hits: str) -> dict[str, Column]:
    """Jet features from its tracks: extremes and means of the significance, angular spread, hits; 0 if empty."""
    values = F.transform(tracks, lambda t: F.abs(t[significance]))
    n = F.size(tracks)
    zero = F.lit(0.0)
    total = lambda f: F.aggregate(tracks, zero, lambda a, t: a + f(t).cast("double"))
    safe = F.when(n > 0, n)
    top = F.slice(F.reverse(F.array_sort(values)), 1, 3)
    return {
        "max_significance": F.coalesce(F.array_max(values), zero),
        "mean_significance": F.coalesce(F.aggregate(values, zero, lambda a, v: a + v) / safe, zero),
        "top3_significance": F.coalesce(F.aggregate(top, zero, lambda a, v: a + v) / F.when(F.size(top) > 0, F.size(top)), zero),
        "angular_rms": F.coalesce(F.sqrt(total(lambda t: t[deta] * t[deta] + t[dphi] * t[dphi]) / safe), zero),
        "hit_sum": total(lambda t: t[hits]),
    }


#: The jet features by what they describe.
FEATURE_GROUPS = {
    "Impact parameter": ("max_abs_d0_significance", "mean_top3_abs_d0_significance", "max_abs_z0_significance"),
    "Track kinematics": ("track_angular_rms", "mean_abs_deta", "mean_abs_dphi", "mean_abs_q_over_p"),
    "Hit structure": ("mean_pixel_hits", "mean_sct_hits", "mean_shared_hits", "mean_split_hits"),
    "Jet context": ("jet_log_pt", "jet_abs_eta", "tracks_used", "tracks_total"),
}


def jet_features(tracks: Column, fields: dict[str, str | list[str]], log_pt: Column, eta: Column, total: Column) -> dict[str, Column]:
    """The features of ``FEATURE_GROUPS`` of an ordered array of tracks; means and extremes of none are 0.

    ``fields`` names the fields d0, z0 (significances), deta, dphi, q_over_p, pixel
    and sct, and lists of fields, summed, as shared and split.  The leading three
    tracks are the first three of the array.
    """
    zero = F.lit(0.0)

    def mean(t: Column, f) -> Column:
        return F.coalesce(F.try_divide(F.aggregate(t, zero, lambda a, x: a + f(x).cast("double")), F.size(t)), zero)

    get = lambda name: lambda x: x[fields[name]]
    size = lambda name: lambda x: F.abs(x[fields[name]])
    summed = lambda name: lambda x: sum((x[f] for f in fields[name]), F.lit(0))
    most = lambda name: F.coalesce(F.array_max(F.transform(tracks, size(name))).cast("double"), zero)
    angle = lambda x: x[fields["deta"]] * x[fields["deta"]] + x[fields["dphi"]] * x[fields["dphi"]]
    return {
        "max_abs_d0_significance": most("d0"),
        "mean_top3_abs_d0_significance": mean(F.slice(tracks, 1, 3), size("d0")),
        "max_abs_z0_significance": most("z0"),
        "track_angular_rms": F.sqrt(mean(tracks, angle)),
        "mean_abs_deta": mean(tracks, size("deta")),
        "mean_abs_dphi": mean(tracks, size("dphi")),
        "mean_abs_q_over_p": mean(tracks, size("q_over_p")),
        "mean_pixel_hits": mean(tracks, get("pixel")),
        "mean_sct_hits": mean(tracks, get("sct")),
        "mean_shared_hits": mean(tracks, summed("shared")),
        "mean_split_hits": mean(tracks, summed("split")),
        "jet_log_pt": log_pt,
        "jet_abs_eta": F.abs(eta),
        "tracks_used": F.size(tracks).cast("double"),
        "tracks_total": total.cast("double"),
    }


def track_batch(jets: DataFrame, tracks: Column, fields: list[str], significance: str, k: int, pt: str = "pt", eta: str = "eta") -> DataFrame:
    """``jets`` with ``x``, the k leading tracks as arrays of transformed fields, and ``context``.

    Tracks are those of the largest absolute significance; ``context`` counts all of
    them.  A jet without tracks has an empty ``x``.
    """
    n = F.when(tracks.isNotNull(), F.size(tracks)).otherwise(0)
    x = F.transform(top_k(tracks, significance, k), lambda t: F.array(*(transform_field(f, t[f]) for f in fields)))
    cols = context(F.col(pt), F.col(eta), n)
    return jets.withColumns({"x": F.coalesce(x, F.array().cast("array<array<double>>")), "context": F.array(*(c.cast("double") for c in cols.values()))})


def known_flavours(jets: DataFrame, label: str = "label_raw") -> DataFrame:
    """``jets`` with y (1 for flavour 5, 0 for 0); other and null flavours make the query fail."""
    refused = F.raise_error(F.lit("a flavour is neither 0 nor 5")).cast("int")
    return jets.withColumn("y", F.when(F.col(label) == 5, 1).when(F.col(label) == 0, 0).otherwise(refused))


def relations(tracks: DataFrame, jet: str, slot: str, coords: list[str]) -> DataFrame:
    """(jet, i, j, d2): squared distances of the ordered pairs of different tracks of a jet.

    Jets hold a bounded number of tracks, so pairs stay within that square.
    """
    one = tracks.select(jet, F.col(slot).alias("i"), *(F.col(c).alias(f"_a{k}") for k, c in enumerate(coords)))
    two = tracks.select(jet, F.col(slot).alias("j"), *(F.col(c).alias(f"_b{k}") for k, c in enumerate(coords)))
    d2 = sum((F.pow(F.col(f"_a{k}") - F.col(f"_b{k}"), F.lit(2.0)) for k in range(len(coords))), F.lit(0.0))
    return one.join(two, jet).where("i <> j").select(jet, "i", "j", d2.alias("d2"))


def local_adjacency(pairs: DataFrame, jet: str, k: int) -> DataFrame:
    """(jet, i, j, w): exp(-d2 / 2) of the k nearest, normalized for each i."""
    order = Window.partitionBy(jet, "i").orderBy("d2", "j")
    near = pairs.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= k)
    w = F.exp(-0.5 * F.least(F.col("d2"), F.lit(50.0)))
    return near.withColumn("w", w / F.sum(w).over(Window.partitionBy(jet, "i"))).select(jet, "i", "j", "w")


def parallel_adjacency(pairs: DataFrame, jet: str, temperature: float, floor: float = 1e-6) -> DataFrame:
    """(jet, i, j, w): heat kernel of all other tracks, normalized for each i."""
    w = F.exp(-F.least(F.col("d2") / (2 * temperature * temperature), F.lit(50.0))) + floor
    return pairs.withColumn("w", w / F.sum(w).over(Window.partitionBy(jet, "i"))).select(jet, "i", "j", "w")


def messages(adjacency: DataFrame, values: DataFrame, jet: str, slot: str, value: str, steps: int) -> DataFrame:
    """(jet, slot, step, value): the adjacency applied 1 .. steps times to a track value."""
    now = values.select(jet, F.col(slot).alias("j"), F.col(value).alias("_v"))
    out = None
    for s in range(1, steps + 1):
        now = adjacency.join(now, [jet, "j"]).groupBy(jet, F.col("i").alias("j")).agg(F.sum(F.col("w") * F.col("_v")).alias("_v"))
        part = now.select(jet, F.col("j").alias(slot), F.lit(s).alias("step"), F.col("_v").alias(value))
        out = part if out is None else out.unionByName(part)
    return out


REPRESENTATIONS = ("set", "graph", "sequential", "parallel", "hybrid")


#: Pairs of tracks that a task holds at a time.
PAIRS = 1 << 19


def _near(begin: np.ndarray, slot: np.ndarray, coords: np.ndarray, unknown: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, d2) of the ordered pairs of different tracks of a jet, all pairs of an i together; nan where d2 is nan, -1 where a coordinate is null."""
    size = np.diff(begin)
    first, of = np.repeat(begin[:-1], size), np.repeat(size, size)
    upto = np.cumsum(of)
    at = 0
    while at < len(of):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
        n = of[at:end]
        i = np.repeat(np.arange(at, end), n)
        j = np.repeat(first[at:end] - np.cumsum(n) + n, n) + np.arange(len(i))
        other = slot[i] != slot[j]
        i, j = i[other], j[other]
        d2 = np.zeros(len(i))
        for c in coords:
            d2 = d2 + (c[i] - c[j]) ** 2
        d2[unknown[i] | unknown[j]] = -1
        yield i, j, d2
        at = end


def _exp(x: np.ndarray) -> np.ndarray:
    """The exponential of the C library: numpy's own may differ in the last bit, by the place of a value."""
    return np.fromiter(map(math.exp, x.tolist()), np.float64, len(x))


def _weighed(i: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    return w / np.bincount(i, w, n)[i]


def _message(i: np.ndarray, j: np.ndarray, w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.stack([np.bincount(i, w * f[j], len(f)) for f in x]) if len(i) else np.zeros_like(x)


def node_inputs(tracks: DataFrame, jet: str, slot: str, fields: list[str], representation: str, coords: list[str], k: int = 4, temperature: float = 1.0, steps: int = 2) -> DataFrame:
    """(jet, slot, x): what an encoder reads of a track, by representation.

    set: its fields; graph: fields, messages A x of the k nearest, x - A x and x * A x;
    sequential: fields and 1 .. ``steps`` messages; parallel: as graph, with the heat
    kernel of all tracks; hybrid: sequential, then the kernel's messages and x - them.
    A track without neighbours has messages of 0.  Tracks are gathered by jet, in one
    shuffle; pairs exist only inside a task, ``PAIRS`` at a time.
    """
    if representation not in REPRESENTATIONS:
        raise ValueError(f"a representation is one of {REPRESENTATIONS}")
    if representation == "set":
        return tracks.select(jet, slot, F.array(*(F.col(f).cast("double") for f in fields)).alias("x"))
    names = [f"_{k}" for k in range(len(fields) + len(coords))]
    row = F.struct(F.col(slot).alias("_slot"), *(F.col(c).cast("double").alias(n) for c, n in zip([*fields, *coords], names, strict=True)))
    nested = tracks.where(F.col(jet).isNotNull()).groupBy(jet).agg(F.collect_list(row).alias("t"))
    schema = StructType([tracks.schema[jet], tracks.schema[slot]]).add("x", ArrayType(DoubleType()))
    local, whole = representation in ("graph", "sequential", "hybrid"), representation in ("parallel", "hybrid")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            lists = batch.column(1)
            flat = lists.flatten()
            begin = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
            place = flat.field("_slot").to_numpy(zero_copy_only=False)
            columns = [flat.field(n) for n in names]
            gone = np.stack([c.is_null().to_numpy(zero_copy_only=False) for c in columns])
            values = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in columns])
            x, n = np.where(gone, 0.0, values)[: len(fields)], len(place)
            near: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
            all_, blocks = np.zeros_like(x), []
            with np.errstate(all="ignore"):
                for i, j, d2 in _near(begin, place, values[len(fields) :], gone[len(fields) :].any(axis=0)):
                    known = np.where(d2 < 0, 50.0, d2)  # a distance that is null or nan weighs as the largest
                    if local:
                        order = np.lexsort((place[j], d2, i))
                        start = np.searchsorted(i, i)  # i ascends, in this order too
                        at = order[np.arange(len(i)) - start < k]
                        for held, v in zip(near, (i[at], j[at], _exp(-0.5 * np.fmin(known[at], 50.0))), strict=True):
                            held.append(v)
                    if whole:
                        kernel = _exp(-np.fmin(np.where(d2 < 0, 50.0, d2 / (2 * temperature * temperature)), 50.0)) + 1e-6
                        all_ += _message(i, j, _weighed(i, kernel, n), x)
                if local:
                    i, j, w = (np.concatenate(v) for v in near)
                    w, now = _weighed(i, w, n), x
                    for _ in range(1 if representation == "graph" else steps):
                        now = np.nan_to_num(_message(i, j, w, now), nan=0.0, posinf=np.inf, neginf=-np.inf)
                        blocks.append(now)
                if whole:
                    blocks.append(np.nan_to_num(all_, nan=0.0, posinf=np.inf, neginf=-np.inf))
                own, last = values[: len(fields)], blocks[-1]
                parts = [own, *blocks, *([] if representation == "sequential" else [own - last]), *([own * last] if representation in ("graph", "parallel") else [])]
            none = gone[: len(fields)]
            masks = [none, *(np.zeros_like(none) for _ in blocks), *(none for _ in parts[1 + len(blocks) :])]
            out, mask = np.concatenate(parts).T, np.concatenate(masks).T
            made = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, out.shape[1]), pa.int32()), pa.array(out.ravel(), mask=mask.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), np.diff(begin)))), flat.field("_slot"), made], schema.fieldNames())

    return nested.mapInArrow(run, schema)


def parallel_messages(tracks: DataFrame, jet: str, slot: str, coords: list[str], value: str, temperature: float, steps: int, floor: float = 1e-6) -> DataFrame:
    """``messages`` over ``parallel_adjacency`` of the ``relations`` of tracks: (jet, slot, step, value).

    Tracks are gathered by jet, in one shuffle; pairs exist only inside a task, as weights
    of up to ``PAIRS`` pairs at a time.  Slots of a jet are different from each other.  A
    track without neighbours has no rows, a null value adds nothing, and a message of
    nulls alone is null.
    """
    names = [f"_{k}" for k in range(len(coords) + 1)]
    row = F.struct(F.col(slot).alias("_slot"), *(F.col(c).cast("double").alias(n) for c, n in zip([value, *coords], names, strict=True)))
    nested = tracks.where(F.col(jet).isNotNull() & F.col(slot).isNotNull()).groupBy(jet).agg(F.collect_list(row).alias("t"))
    schema = StructType([tracks.schema[jet], tracks.schema[slot]]).add("step", IntegerType()).add(value, DoubleType())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            lists = batch.column(1)
            flat = lists.flatten()
            begin = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
            place = flat.field("_slot").to_numpy(zero_copy_only=False)
            columns = [flat.field(n) for n in names]
            gone = np.stack([c.is_null().to_numpy(zero_copy_only=False) for c in columns])
            values = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in columns])
            n = len(place)
            now, known = np.where(gone[0], 0.0, values[0]), ~gone[0]
            of = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), np.diff(begin))))
            for step in range(1, steps + 1):
                out, any_known, met = np.zeros(n), np.zeros(n, bool), np.zeros(n, bool)
                with np.errstate(all="ignore"):
                    for i, j, d2 in _near(begin, place, values[1:], gone[1:].any(axis=0)):
                        w = _exp(-np.fmin(np.where(d2 < 0, 50.0, d2 / (2 * temperature * temperature)), 50.0)) + floor
                        w = _weighed(i, w, n)
                        use = known[j]
                        out += np.bincount(i[use], w[use] * now[j[use]], n)
                        met[i] = True
                        any_known[i[use]] = True
                now, known = out, any_known
                at = pa.array(np.flatnonzero(met))
                made = pa.array(out[met], mask=~any_known[met])
                yield pa.RecordBatch.from_arrays([of.take(at), flat.field("_slot").take(at), pa.array(np.full(len(at), step, np.int32)), made], schema.fieldNames())

    return nested.mapInArrow(run, schema)


def _kept(keep: float, seed: int):
    """Places of a jet's tracks that are kept, in batches: the remainder of SplitMix64 of jet * 1000 + place is below the share."""
    add, cut = np.uint64((seed + 0x9E3779B97F4A7C15) % (1 << 64)), np.uint64(int(round(keep * 10_000)))

    def run(jet: pd.Series, size: pd.Series) -> pd.Series:
        n = np.maximum(size.to_numpy(), 0)
        begin = np.cumsum(n) - n
        place = np.arange(n.sum()) - np.repeat(begin, n)
        z = (np.repeat(jet.to_numpy(), n) * 1000 + place).astype(np.uint64) + add
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
        return pd.Series(np.split(z % np.uint64(10_000) < cut, begin[1:])) if len(n) else pd.Series([], dtype=object)

    return F.pandas_udf(run, "array<boolean>")


def dropout(tracks: Column, jet: Column, keep: float, seed: int = 0) -> Column:
    """Tracks kept by a hash of jet and place; the first one stays if none is."""
    whole = F.coalesce(jet.cast("long"), F.lit(0))
    mask = _kept(keep, seed)(whole, F.coalesce(F.size(tracks), F.lit(0)))
    kept = F.transform(F.filter(F.arrays_zip(tracks.alias("t"), mask.alias("k")), lambda x: x["k"]), lambda x: x["t"])
    return F.when(jet.isNotNull() & (F.size(kept) > 0), kept).otherwise(F.slice(tracks, 1, 1))
