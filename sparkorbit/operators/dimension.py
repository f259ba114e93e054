"""Choosing modes: field projection, spectral blocks, prefixes, class scatter, gate gradients."""

from __future__ import annotations

import sys

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stored import stored
from .bootstrap import draws
from .roles import ranked

EPS = sys.float_info.epsilon


def spectral_blocks(eigen: DataFrame) -> DataFrame:
    """(k, epsilon, block): eigenvalues closer than 100 sqrt(eps) max(1, largest) share a block.

    One row for each mode, so a window over all of them is small.
    """
    order = Window.orderBy("epsilon", "k")
    tol = 100 * EPS**0.5 * F.greatest(F.lit(1.0), F.max(F.abs("epsilon")).over(Window.partitionBy()))
    gap = F.col("epsilon") - F.lag("epsilon").over(order)
    start = F.when(gap > tol, 1).otherwise(0)
    return eigen.withColumn("_s", start).withColumn("block", F.sum("_s").over(order)).drop("_s")


def field_projection(modes: DataFrame, field: DataFrame, eigen: DataFrame) -> DataFrame:
    """(k, block, c, q): the share of a field (id, g, degree) in modes (id, k, phi), averaged in blocks.

    c_k = sum d phi (g - mean) / sqrt(sum d phi^2), g's mean weighted by degree;
    q is the block average of c^2, normalized.
    """
    mean = field.agg((F.sum(F.col("degree") * F.col("g")) / F.sum("degree")).alias("_m"))
    rows = modes.join(field, "id").crossJoin(F.broadcast(mean))
    d, phi = F.col("degree"), F.col("phi")
    c = F.sum(d * phi * (F.col("g") - F.col("_m"))) / F.sqrt(F.greatest(F.sum(d * phi * phi), F.lit(1e-300)))
    power = rows.groupBy("k").agg(c.alias("c")).join(spectral_blocks(eigen).select("k", "block"), "k")
    power = power.withColumn("_p", F.avg(F.col("c") * F.col("c")).over(Window.partitionBy("block")))
    total = F.sum("_p").over(Window.partitionBy())
    return power.select("k", "block", "c", F.when(total > 0, F.col("_p") / F.nullif(total, F.lit(0.0))).otherwise(F.lit(0.0)).alias("q"))


def ranks(shares: DataFrame) -> DataFrame:
    """One row: participation rank 1 / sum q^2 and entropy rank exp(-sum q ln q)."""
    q = F.col("q")
    return shares.agg(F.try_divide(F.lit(1.0), F.sum(q * q)).alias("participation"), F.exp(-F.sum(F.when(q > 0, q * F.ln(q)).otherwise(0.0))).alias("entropy"))


def select_prefix(shares: DataFrame, mass: float = 0.9, k_min: int = 1) -> DataFrame:
    """One row: modes of the prefix that holds ``mass`` of q and the participation rank, to the end of its block."""
    run = shares.withColumn("_cum", F.sum("q").over(Window.orderBy("k")))
    need = run.agg(F.coalesce(F.min(F.when(F.col("_cum") >= mass - 1e-12, F.col("k"))), F.max("k")).alias("_k"), F.ceil(F.try_divide(F.lit(1.0), F.sum(F.col("q") * F.col("q")))).alias("_p"), F.max("k").alias("_all"))
    k = F.least(F.greatest(F.lit(k_min), F.col("_p"), F.col("_k")), F.col("_all"))
    at = shares.crossJoin(F.broadcast(need.select(k.cast("int").alias("raw"))))
    block = at.where(F.col("k") == F.col("raw")).select("block", "raw")
    return shares.join(F.broadcast(block), "block").groupBy("raw").agg(F.max("k").alias("selected")).select("raw", "selected")


def class_scatter(state: DataFrame, labels: DataFrame) -> DataFrame:
    """(y, i, j, e): means over each class of the products of state components (id, k, a)."""
    rows = state.join(labels.select("id", "y"), "id")
    pairs = rows.select("id", "y", F.col("k").alias("i"), F.col("a").alias("_a")).join(state.select("id", F.col("k").alias("j"), F.col("a").alias("_b")), "id")
    return pairs.groupBy("y", "i", "j").agg(F.avg(F.col("_a") * F.col("_b")).alias("e"))


def gate_gradient(state: DataFrame, measurement: DataFrame, prior1: float) -> DataFrame:
    """(id, k, p, grad) of the information under gates on the modes; labels take no part.

    p = a' M a, M of entries (i, j, m); the gradient to the gate of mode k at 1 is
    ln(p pi0 / ((1 - p) pi1)) 2 a_k ((M a)_k - p a_k).
    """
    ma = state.withColumnRenamed("k", "j").join(F.broadcast(measurement), "j").groupBy("id", F.col("i").alias("k")).agg(F.sum(F.col("m") * F.col("a")).alias("_ma"))
    rows = state.join(ma, ["id", "k"]).withColumn("p", F.sum(F.col("a") * F.col("_ma")).over(Window.partitionBy("id")))
    p = F.least(F.greatest(F.col("p"), F.lit(1e-12)), F.lit(1 - 1e-12))
    log = F.ln(p * (1 - prior1) / ((1 - p) * prior1))
    return rows.select("id", "k", "p", (log * 2 * F.col("a") * (F.col("_ma") - F.col("p") * F.col("a"))).alias("grad"))


def block_scores(gradients: DataFrame, blocks: DataFrame) -> DataFrame:
    """(block, first, size, score): mean square over rows of the block's summed gradient."""
    per = gradients.join(F.broadcast(blocks.select("k", "block")), "k").groupBy("id", "block").agg(F.sum("grad").alias("_g"))
    score = per.groupBy("block").agg(F.avg(F.col("_g") * F.col("_g")).alias("score"))
    return blocks.groupBy("block").agg(F.min("k").alias("first"), F.count("*").alias("size")).join(score, "block")


def greedy_blocks(scores: DataFrame, mass: float = 0.9, least: int = 2) -> DataFrame:
    """Blocks by falling score, with ``selected`` until mass, participation rank and least size are reached."""
    order = Window.orderBy(F.col("score").desc(), "first")
    whole = Window.partitionBy()
    q = F.col("score") / F.nullif(F.sum("score").over(whole), F.lit(0.0))
    rows = scores.withColumn("q", F.coalesce(q, F.lit(0.0))).withColumn("rank", F.row_number().over(order))
    rows = rows.withColumn("mass", F.sum("q").over(order)).withColumn("modes", F.sum("size").over(order))
    rows = rows.withColumn("_p", F.coalesce(F.try_divide(F.lit(1.0), F.sum(F.col("q") * F.col("q")).over(whole)), F.lit(1.0)))
    done = (F.col("mass") >= mass - 1e-12) & (F.col("rank") >= F.ceil("_p")) & (F.col("modes") >= least)
    end = F.coalesce(F.min(F.when(done, F.col("rank"))).over(whole), F.max("rank").over(whole))
    return rows.withColumn("selected", F.col("rank") <= end).select("block", "first", "size", "score", "rank", "mass", "modes", "selected")


def ranked_subset(scores: DataFrame, size: int) -> DataFrame:
    """Whole blocks by falling score of a mode until they have ``size`` modes; the block that reaches it is not split."""
    order = Window.orderBy((F.col("score") / F.col("size")).desc(), "first")
    rows = scores.withColumn("modes", F.sum("size").over(order))
    return rows.where(F.col("modes") - F.col("size") < size)


def screening_measurement(state: DataFrame, labels: DataFrame, modes: int, rho: float = 1e-3) -> list[list[list[float]]]:
    """M_c = S^-1/2 E_c S^-1/2 of both classes, E_c their scatter plus rho / 2 on the diagonal, S their sum.

    The scatter is a table of modes^2 entries a class; the root is taken on the driver.
    """
    e = np.zeros((2, modes, modes))
    for r in class_scatter(state, labels).collect():
        e[r["y"], r["i"] - 1, r["j"] - 1] = r["e"]
    if not e[0].any() or not e[1].any():
        raise ValueError("every class needs states")
    e += rho / 2 * np.eye(modes)
    value, vector = np.linalg.eigh(e.sum(axis=0))
    t = (vector / np.sqrt(np.maximum(value, 1e-12))) @ vector.T
    m = t @ e @ t
    return ((m + m.transpose(0, 2, 1)) / 2).tolist()


def measurement_frame(df: DataFrame, m: list[list[float]]) -> DataFrame:
    """(i, j, m) of a matrix, from 1."""
    rows = [(i + 1, j + 1, float(v)) for i, r in enumerate(m) for j, v in enumerate(r)]
    return df.sparkSession.createDataFrame(rows, "i int, j int, m double")


def row_draws(ids: DataFrame, replicates: int, seed: int = 0) -> DataFrame:
    """(replicate, id, w): multinomial multiplicities of the rows, as many draws as rows."""
    rows = stored(ranked(ids.select("id").distinct().withColumn("_one", F.lit(1)), "id", ["_one"], seed).drop("_one"))
    n = rows.count()
    return draws(ids, replicates, n, n, seed + 1).join(rows, "_r").select("replicate", "id", "w")


def bootstrap_prefix(modes: DataFrame, field: DataFrame, eigen: DataFrame, replicates: int, mass: float = 0.9, k_min: int = 1, seed: int = 0) -> DataFrame:
    """(replicate, selected): the prefix choice on rows drawn with replacement."""
    w = stored(row_draws(field, replicates, seed))
    drawn = field.join(w, "id").withColumn("degree", F.col("degree") * F.col("w"))
    mean = drawn.groupBy("replicate").agg((F.sum(F.col("degree") * F.col("g")) / F.sum("degree")).alias("_m"))
    d, phi = F.col("degree"), F.col("phi")
    c = F.sum(d * phi * (F.col("g") - F.col("_m"))) / F.sqrt(F.greatest(F.sum(d * phi * phi), F.lit(1e-300)))
    power = modes.join(drawn.join(F.broadcast(mean), "replicate"), "id").groupBy("replicate", "k").agg(c.alias("c")).join(F.broadcast(spectral_blocks(eigen).select("k", "block")), "k")
    power = power.withColumn("_p", F.avg(F.col("c") * F.col("c")).over(Window.partitionBy("replicate", "block")))
    q = F.coalesce(F.try_divide(F.col("_p"), F.sum("_p").over(Window.partitionBy("replicate"))), F.lit(0.0))
    run = power.select("replicate", "k", "block", q.alias("q")).withColumn("_cum", F.sum("q").over(Window.partitionBy("replicate").orderBy("k")))
    per = run.groupBy("replicate").agg(F.coalesce(F.min(F.when(F.col("_cum") >= mass - 1e-12, F.col("k"))), F.max("k")).alias("_k"), F.ceil(F.try_divide(F.lit(1.0), F.sum(F.col("q") * F.col("q")))).alias("_p"), F.max("k").alias("_all"))
    raw = per.select("replicate", F.least(F.greatest(F.lit(k_min), F.col("_p"), F.col("_k")), F.col("_all")).cast("int").alias("raw"))
    end = run.join(raw, "replicate").where("k = raw").select("replicate", F.col("block").alias("_block"))
    return run.join(end, "replicate").where(F.col("block") == F.col("_block")).groupBy("replicate").agg(F.max("k").alias("selected"))


def bootstrap_record(replicates: DataFrame, selected: int) -> DataFrame:
    """One row: how often the choice of the replicates is its mode and that of all rows, with median, least and most."""
    per = replicates.groupBy("selected").agg(F.count("*").alias("n"))
    top = F.max(F.struct("n", (-F.col("selected")).alias("k")))
    row = per.agg(F.sum("n").alias("repetitions"), top.alias("_t"), F.sum(F.when(F.col("selected") == selected, F.col("n")).otherwise(0)).alias("_e"))
    row = row.select("repetitions", (-F.col("_t.k")).alias("mode"), (F.col("_t.n") / F.col("repetitions")).alias("mode_fraction"), (F.col("_e") / F.col("repetitions")).alias("exact_fraction"))
    return row.crossJoin(F.broadcast(replicates.agg(F.median("selected").alias("median"), F.min("selected").alias("least"), F.max("selected").alias("most"))))  # a row for each replicate


def mode_records(shares: DataFrame, eigen: DataFrame, selected: int) -> DataFrame:
    """A row for each mode: eigenvalue, block, coefficient and its power, share, running share, whether selected."""
    run = F.sum("q").over(Window.orderBy("k"))
    rows = shares.join(eigen.select("k", "epsilon"), "k")
    return rows.select("k", "epsilon", "block", "c", (F.col("c") * F.col("c")).alias("power"), "q", run.alias("cumulative"), (F.col("k") <= selected).alias("selected"))


def gated_records(scores: DataFrame, blocks: DataFrame, mass: float = 0.9, least: int = 2) -> DataFrame:
    """A row for each mode: its part of the block's score and share, its rank by them, and whether its block is selected."""
    chosen = greedy_blocks(scores, mass, least)
    share = F.coalesce(F.try_divide(F.col("score"), F.sum("score").over(Window.partitionBy())), F.lit(0.0))
    rows = blocks.select("k", "epsilon", "block").join(chosen.withColumn("q", share).select("block", "size", "score", "q", "selected"), "block")
    rows = rows.select("k", "epsilon", "block", (F.col("score") / F.col("size")).alias("score"), (F.col("q") / F.col("size")).alias("weight"), "selected")
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.col("weight").desc(), "k")))


def gated_bootstrap(gradients: DataFrame, blocks: DataFrame, replicates: int, mass: float = 0.9, least: int = 2, seed: int = 0) -> DataFrame:
    """(replicate, k): the modes that each replicate selects from rows drawn with replacement."""
    per = stored(gradients.join(F.broadcast(blocks.select("k", "block")), "k").groupBy("id", "block").agg(F.sum("grad").alias("_g")))
    w = row_draws(per, replicates, seed)
    score = per.join(w, "id").groupBy("replicate", "block").agg((F.sum(F.col("w") * F.col("_g") * F.col("_g")) / F.sum("w")).alias("score"))
    sizes = blocks.groupBy("block").agg(F.min("k").alias("first"), F.count("*").alias("size"))
    rows = score.join(F.broadcast(sizes), "block")
    order, whole = Window.partitionBy("replicate").orderBy(F.col("score").desc(), "first"), Window.partitionBy("replicate")
    rows = rows.withColumn("q", F.coalesce(F.try_divide(F.col("score"), F.sum("score").over(whole)), F.lit(0.0))).withColumn("rank", F.row_number().over(order))
    rows = rows.withColumn("mass", F.sum("q").over(order)).withColumn("modes", F.sum("size").over(order))
    rows = rows.withColumn("_p", F.coalesce(F.try_divide(F.lit(1.0), F.sum(F.col("q") * F.col("q")).over(whole)), F.lit(1.0)))
    done = (F.col("mass") >= mass - 1e-12) & (F.col("rank") >= F.ceil("_p")) & (F.col("modes") >= least)
    end = F.coalesce(F.min(F.when(done, F.col("rank"))).over(whole), F.max("rank").over(whole))
    chosen = rows.withColumn("_end", end).where(F.col("rank") <= F.col("_end")).select("replicate", "block")
    return chosen.join(F.broadcast(blocks.select("k", "block")), "block").select("replicate", "k")


def inclusion(selected: DataFrame, replicates: int) -> DataFrame:
    """(k, frequency): the share of replicates that select a mode; modes never selected are left out."""
    return selected.groupBy("k").agg((F.count("*") / replicates).alias("frequency"))


def checkpoints(shares: DataFrame, widths: list[int], mass: float = 0.9, k_min: int = 1) -> DataFrame:
    """(width, selected, ceiling, stable): the prefix choice with the first ``width`` modes alone.

    A choice that takes all modes touches the ceiling; it is stable if it equals that
    of the width before and touches no ceiling.
    """
    out = None
    for w in widths:
        part = shares.where(F.col("k") <= w)
        part = part.withColumn("q", F.col("q") / F.sum("q").over(Window.partitionBy()))
        row = select_prefix(part, mass, k_min).select(F.lit(w).alias("width"), "selected")
        out = row if out is None else out.unionByName(row)
    out = out.withColumn("ceiling", F.col("selected") >= F.col("width"))
    same = F.lag("selected").over(Window.orderBy("width")) == F.col("selected")
    return out.withColumn("stable", F.coalesce(same, F.lit(False)) & ~F.col("ceiling"))
