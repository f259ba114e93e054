"""The classifier end to end: graph, potential, modes, gated selection, quadratic readout.

Roles keep labels apart: landmarks carry the graph and its posterior, other rows the
gate gradients (without their labels), and further ones the readout.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clip
from ..functions.stored import stored
from . import dimension, graph, readout, spectrum
from .roles import proportional_sample


@dataclass
class OrbitalClassifier:
    """``fit`` on rows (id, x, y), then ``predict_proba`` on rows (id, x)."""

    k: int = 12
    k_sigma: int = 6
    modes: int = 24
    betas: tuple[float, ...] = (0.5, 1.0, 2.0)
    mass: float = 0.9
    max_landmarks: int = 16_000
    max_readout: int = readout.MAX_ROWS
    id_col: str = "id"
    vector_col: str = "x"
    label: str = "y"
    fitted: dict = field(default_factory=dict)
    candidates: list[dict] = field(default_factory=list)

    def _parts(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Landmarks and readout rows: disjoint halves by a hash of the id, both of bounded size with the shares of the classes."""
        half = F.pmod(F.xxhash64(self.id_col), F.lit(2))
        rows = df.select(F.col(self.id_col).alias("id"), F.col(self.vector_col).alias("x"), F.col(self.label).cast("int").alias("y"))
        a = proportional_sample(rows.where(half == 0), self.max_landmarks, "id")
        b = proportional_sample(rows.where(half == 1), self.max_readout, "id", seed=1)
        return stored(a), stored(b)

    def _states(self, queries: DataFrame, fit: dict) -> DataFrame:
        w = graph.query_affinities(queries, fit["landmarks"], self.k, self.k_sigma, "id", "x")
        w = stored(w)
        post = graph.kernel_posterior(w.select("src", "dst", "w"), fit["landmarks"].select("id", "y"))
        pot = graph.information_potential(post)
        return spectrum.extend_modes(w, fit["long"], pot, fit["eigen"], 1.0, fit["beta"])

    def fit(self, df: DataFrame) -> OrbitalClassifier:
        """Choose beta by the log loss of a readout on a part of the readout rows; keep the best.

        ``candidates`` records every beta.  One without a stable prefix is passed over,
        and so is one that selects its last stable mode, unless all do.
        """
        landmarks, rest = self._parts(df)
        edges, _ = graph.self_tuning_graph(landmarks, self.k, self.k_sigma, "id", "x")
        edges = stored(edges)
        post = graph.kernel_posterior(edges, landmarks.select("id", "y"))
        pot = stored(graph.information_potential(post))
        deg, lap = graph.degrees(edges), stored(graph.laplacian(edges))
        best, self.candidates = None, []
        for beta in self.betas:
            eigen, modes = spectrum.solve_modes(graph.graph_operator(lap, pot.select("id", "v"), 1.0, beta), self.modes, deg)
            long = modes.select("id", F.posexplode("phi").alias("k", "phi")).withColumn("k", F.col("k") + 1)
            fit = {"landmarks": landmarks, "eigen": eigen, "long": long, "beta": beta}
            ext = stored(self._states(rest, fit))
            prefix = spectrum.stable_prefix(ext.select("k", "stable")).first()["prefix"]
            if not prefix:
                self.candidates.append({"beta": beta, "prefix": 0, "selected": [], "ceiling": True, "loss": None})
                continue
            state = spectrum.states(ext, list(range(1, prefix + 1)))
            state = stored(state)
            prior = landmarks.agg(F.avg("y")).first()[0]
            screen = dimension.screening_measurement(state, landmarks.select("id", "y").union(rest.select("id", "y")), prefix)
            m1 = dimension.measurement_frame(state, screen[1])
            blocks = dimension.spectral_blocks(eigen.where(F.col("k") <= prefix))
            chosen = dimension.greedy_blocks(dimension.block_scores(dimension.gate_gradient(state, m1, prior), blocks), self.mass)
            selected = sorted(r["k"] for r in chosen.where("selected").join(blocks, "block").select("k").collect())
            picked = spectrum.states(ext, selected)
            rows = picked.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "a"))).alias("s")).join(rest.select("id", "y"), "id")
            rows = stored(rows.select("id", F.col("s.a").alias("a"), "y"))
            probe = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5)) == 0
            trial = readout.fit_states(rows.where(~probe))
            p = clip(readout.quadratic(F.col("a"), trial.m[1]), 1e-7, 1 - 1e-7)
            loss = float(rows.where(probe).agg(F.avg(-F.ln(F.when(F.col("y") == 1, p).otherwise(1 - p)))).first()[0])
            ceiling = max(selected) >= prefix
            self.candidates.append({"beta": beta, "prefix": prefix, "selected": selected, "ceiling": ceiling, "loss": loss})
            if best is None or (ceiling, loss) < best_key:
                best_key = (ceiling, loss)
                best = fit | {"loss": loss, "selected": selected, "readout": readout.fit_states(rows), "prefix": prefix}
        if best is None:
            raise ArithmeticError("no operator has a stable prefix of modes")
        self.fitted = best
        return self

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """(id, p): probability of label 1."""
        rows = df.select(F.col(self.id_col).alias("id"), F.col(self.vector_col).alias("x"))
        ext = self._states(rows, self.fitted)
        state = spectrum.states(ext, self.fitted["selected"])
        place = F.create_map(*(F.lit(v) for k, s in enumerate(self.fitted["selected"]) for v in (s, k + 1)))
        state = state.withColumn("k", place[F.col("k")])
        p = readout.probability(state, self.fitted["readout"].entries(state)).select(F.col("id").alias(self.id_col), "p")
        return p.withColumn("p", F.least(F.greatest("p", F.lit(0.0)), F.lit(1.0)))
