"""Feature maps: ``fit(df)`` reads quantiles and moments, ``transform`` is a projection.

Null, NaN and infinite values are missing.  Quantiles are exact: a sketch brackets each
of them, and only values inside the brackets are counted and ordered, so neither does a
task hold a whole column nor are all values shuffled.  ``save`` and ``load_map`` keep a
fitted map as JSON.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import clean_sentinel, clip, finite, met_pair, pair_kinematics, topology, wrap_angle


#: Rows that a task sorts at a time, of which each ``STEP``-th value enters the sketch, and half of the width of a bracket in ranks.
BUFFER_ROWS, STEP, SLACK = 1 << 17, 256, 0.0015


#: Bytecodes of a method up to which the JVM compiles it; a longer one runs some ten times slower.
METHOD_BYTES = 8000


@contextmanager
def _compiled(spark: SparkSession) -> Iterator[None]:
    """Stages whose code is too long for the JVM to compile are run operator by operator inside, in shorter methods."""
    name = "spark.sql.codegen.hugeMethodLimit"
    held = spark.conf.get(name)
    spark.conf.set(name, str(METHOD_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, held)


def _buffers(it: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The finite values of each column, of up to ``BUFFER_ROWS`` rows at a time."""
    held, rows = [], 0

    def columns() -> Iterator[np.ndarray]:
        for k in range(held[0].num_columns):
            x = np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]).astype(np.float64, copy=False)
            yield x[np.isfinite(x)]

    for batch in it:
        held.append(batch)
        rows += batch.num_rows
        if rows >= BUFFER_ROWS:
            yield columns()
            held, rows = [], 0
    if rows:
        yield columns()


def _sketch(df: DataFrame) -> DataFrame:
    """(c, v, n): number of a column and every ``STEP``-th of its sorted values, by task; rows without v count the values."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for buffer in _buffers(it):
            for k, x in enumerate(buffer):
                size = len(x)
                x = np.sort(x)[STEP // 2 :: STEP]
                none = np.arange(len(x) + 1) == len(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x) + 1, k), pa.int32()), pa.array(np.append(x, 0.0), mask=none), pa.array(np.where(none, size, 0))], ["c", "v", "n"])

    return df.mapInArrow(run, "c int, v double, n long")


def _bracketed(df: DataFrame, brackets: list[tuple[int, float, float]]) -> DataFrame:
    """(k, v, n): how often the values inside bracket k = (column, low, high) occur; the row without v counts those below."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for buffer in _buffers(it):
            for c, x in enumerate(buffer):
                for k, low, high in ((k, low, high) for k, (of, low, high) in enumerate(brackets) if of == c):
                    v, n = np.unique(x[(x >= low) & (x <= high)], return_counts=True)
                    none = np.arange(len(v) + 1) == 0
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(none), k), pa.int32()), pa.array(np.append(0.0, v), mask=none), pa.array(np.append((x < low).sum(), n))], ["k", "v", "n"])

    return df.mapInArrow(run, "k int, v double, n long").groupBy("k", "v").agg(F.sum("n").alias("n"))


#: Steps of the shares at which a sketch is read.
GRID = 1000


def _order_statistics(df: DataFrame, columns: dict[str, Column], wanted: Callable[[int, int], list[tuple[int, int]]]) -> tuple[int, dict[str, int], dict[str, dict[tuple[int, int], tuple[float, float]]]]:
    """Rows, finite values of each column, and the values at the pairs of ranks (from 0) that ``wanted`` names for a column of n values, n > 0, and a number of rows.

    The first pass over the rows takes a sketch, the second one counts the values next to
    each pair and those below.  A bracket that misses its ranks, which the counts tell, is
    replaced by all values of the column.
    """
    with _compiled(df.sparkSession):
        names = list(columns)
        values = df.select(*(v.cast("double").alias(str(k)) for k, v in enumerate([*columns.values(), F.lit(0.0)])))  # the last one counts the rows
        steps = F.array(*(F.lit(j / GRID) for j in range(GRID + 1)))
        rows = _sketch(values).groupBy("c").agg(F.sum("n").alias("n"), F.percentile_approx("v", steps, F.lit(10_000)).alias("q")).collect()  # a row for each column
        held = {r["c"]: r for r in rows}
        total = held[len(names)]["n"] if held else 0
        sizes, brackets, ranks = dict.fromkeys(names, 0), [], []
        for c, name in enumerate(names):
            sizes[name] = n = held[c]["n"] if held else 0
            for pair in sorted(set(wanted(n, total))) if n else []:
                q = held[c]["q"] if n >= 64 * STEP else None  # too few values for a sketch
                a, b = ((r / max(1, n - 1) + d) * GRID for r, d in zip(pair, (-SLACK, SLACK), strict=True))
                low = -math.inf if q is None or a <= 0 else q[math.floor(a)]
                high = math.inf if q is None or b >= GRID else q[math.ceil(b)]
                brackets.append((c, low, high))
                ranks.append(pair)
        found: dict[str, dict[tuple[int, int], tuple[float, float]]] = {n: {} for n in names}
        todo = list(range(len(brackets)))
        while todo:
            upto = F.sum("n").over(Window.partitionBy("k").orderBy(F.col("v").asc_nulls_first()))
            run = _bracketed(values, [brackets[k] for k in todo]).withColumn("upto", upto)
            at = lambda j: F.element_at(F.array(*(F.lit(ranks[k][j]).cast("long") for k in todo)), F.col("k") + 1)  # noqa: B023, E731
            below = F.max(F.when(F.col("v").isNull(), F.col("upto")))
            ends = (F.min(F.when(F.col("upto") > at(j), F.struct("upto", "v"))) for j in (0, 1))
            missed = []
            for r in run.groupBy("k").agg(below.alias("below"), F.max("upto").alias("most"), *(e.alias(n) for e, n in zip(ends, ("low", "high"), strict=True))).collect():  # a row for each bracket
                k = todo[r["k"]]
                if r["below"] <= ranks[k][0] and ranks[k][1] < r["most"]:
                    found[names[brackets[k][0]]][ranks[k]] = (r["low"]["v"], r["high"]["v"])
                else:
                    brackets[k] = (brackets[k][0], -math.inf, math.inf)
                    missed.append(k)
            todo = missed
    return total, sizes, found


def _between(share: float, n: int) -> tuple[int, int, float]:
    """The two ranks of n values that a linear quantile lies between, and how far."""
    at = share * (n - 1)
    return math.floor(at), math.ceil(at), at - math.floor(at)


def column_quantiles(df: DataFrame, columns: dict[str, Column], shares: list[float], counts: dict[str, int] | None = None) -> dict[str, list[float]]:
    """Exact linear quantiles of the finite values of several columns, zeros without values; ``counts`` receives their numbers."""
    _, sizes, found = _order_statistics(df, columns, lambda n, _: [_between(p, n)[:2] for p in shares])
    if counts is not None:
        counts.update(sizes)
    out = {}
    for c, n in sizes.items():
        out[c] = []
        for low, high, part in (_between(p, n) for p in shares) if n else []:
            a, b = found[c][low, high]
            out[c].append(a + part * (b - a))
    return {c: q or [0.0] * len(shares) for c, q in out.items()}


def filled_quantiles(df: DataFrame, columns: dict[str, Column], shares: list[float]) -> tuple[int, dict[str, tuple[int, float, list[float]]]]:
    """Number of rows and, of each column, its number of finite values, their median, and the linear quantiles of the column with the others replaced by that median.

    The filled column is the sorted one with the median put in after the lower of the two
    values it lies between, so its quantiles are found with the median, in the same passes.
    """

    def origin(rank: int, n: int, total: int) -> int | None:
        """The rank among the values of a rank of the filled column; None: the median."""
        low = _between(0.5, n)[0]
        return rank if rank <= low else None if rank <= low + total - n else rank - (total - n)

    def wanted(n: int, total: int) -> list[tuple[int, int]]:
        filled = (tuple(origin(r, n, total) for r in _between(p, total)[:2]) for p in shares)
        known = ([r for r in pair if r is not None] for pair in filled)
        return [_between(0.5, n)[:2], *((pair[0], pair[-1]) for pair in known if pair)]

    total, sizes, found = _order_statistics(df, columns, wanted)
    out = {}
    for c, n in sizes.items():
        if not n:
            out[c] = (0, 0.0, [0.0] * len(shares))
            continue
        at = {r: v for pair, both in found[c].items() for r, v in zip(pair, both, strict=True)}
        low, high, part = _between(0.5, n)
        median = at[low] + part * (at[high] - at[low])
        value = lambda r: median if r is None else at[r]  # noqa: B023, E731
        quantiles = []
        for p in shares:
            low, high, part = _between(p, total)
            a, b = value(origin(low, n, total)), value(origin(high, n, total))
            quantiles.append(a + part * (b - a))
        out[c] = (n, median, quantiles)
    return total, out


def flag_quantile(share: float, ones: int, total: int) -> float:
    """The linear quantile of ``total`` flags, of which ``ones`` are 1 and the others 0."""
    low, high, part = _between(share, total)
    a, b = (float(r >= total - ones) for r in (low, high))
    return a + part * (b - a)


@dataclass
class RobustMap:
    """(x - median) / (q high - q low), clipped; a range of zero divides by ``flat``."""

    columns: list[str]
    low: float = 0.10
    high: float = 0.90
    limit: float = 12.0
    flat: float = 1.0
    params: dict[str, tuple[float, float]] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> RobustMap:
        return self.of(column_quantiles(df, {c: F.col(c) for c in self.columns}, [self.low, 0.5, self.high]))

    def of(self, quantiles: dict[str, list[float]]) -> RobustMap:
        """The map of columns whose low quantile, median and high quantile are known."""
        self.columns = list(quantiles)
        for c, (a, m, b) in quantiles.items():
            self.params[c] = (m, b - a if b - a > (0 if self.flat == 1.0 else self.flat) else self.flat)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        missing = [c for c in self.columns if c not in df.columns]
        if missing or not self.params:
            raise ValueError(f"not fitted, or columns are missing: {missing}")
        return df.withColumns({c: clip((F.col(c) - m) / s, -self.limit, self.limit) for c, (m, s) in self.params.items()})


@dataclass
class StandardMap:
    """Median-imputed, constant columns dropped, (x - mean) / population deviation."""

    columns: list[str]
    params: dict[str, tuple[float, float, float]] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> StandardMap:
        medians = {c: q[0] for c, q in column_quantiles(df, {c: F.col(c) for c in self.columns}, [0.5]).items()}
        row = df.agg(*(F.struct(F.avg(v), F.stddev_pop(v)).alias(c) for c, v in ((c, self._filled(c, medians[c])) for c in self.columns))).first()
        self.params = {c: (medians[c], row[c][0], row[c][1]) for c in self.columns if row[c][1]}
        return self

    @staticmethod
    def _filled(c: str, median: float) -> Column:
        return F.when(finite(F.col(c).cast("double")), F.col(c).cast("double")).otherwise(F.lit(median))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select(*(c for c in df.columns if c not in self.columns), *(((self._filled(c, m) - mean) / std).alias(c) for c, (m, mean, std) in self.params.items()))


@dataclass
class ImputeMap:
    """Sentinels become null, a flag for each column with nulls in the fit, nulls become medians, robust scale.

    ``scale_flags`` scales the flags like the columns.
    """

    columns: list[str]
    limit: float = 10.0
    scale_flags: bool = False
    medians: dict[str, float] = field(default_factory=dict)
    flagged: list[str] = field(default_factory=list)
    robust: RobustMap | None = None

    def _filled(self, df: DataFrame) -> DataFrame:
        clean = {c: clean_sentinel(F.col(c)) for c in self.columns}
        flags = {f"{c}_missing": clean[c].isNull().cast("double") for c in self.flagged}
        return df.select(*(c for c in df.columns if c not in self.columns), *(F.coalesce(v, F.lit(self.medians[c])).alias(c) for c, v in clean.items()), *(v.alias(n) for n, v in flags.items()))

    def fit(self, df: DataFrame, also: dict[str, Column] | None = None) -> ImputeMap:
        """``also`` are more columns whose missing values are counted."""
        robust = RobustMap([], limit=self.limit)
        shares = [robust.low, 0.5, robust.high]
        total, held = filled_quantiles(df, {c: clean_sentinel(F.col(c)) for c in self.columns} | (also or {}), shares)
        self.missing = {c: total - n for c, (n, _, _) in held.items()}
        held = {c: held[c] for c in self.columns}
        self.medians = {c: median for c, (_, median, _) in held.items()}
        self.flagged = [c for c, (n, _, _) in held.items() if n < total]
        scaled = {c: q for c, (_, _, q) in held.items()}
        if self.scale_flags:
            scaled |= {f"{c}_missing": [flag_quantile(p, total - held[c][0], total) for p in shares] for c in self.flagged}
        self.robust = robust.of(scaled)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return self.robust.transform(self._filled(df))


def periodic(df: DataFrame, angle: str, reference: str | None = None) -> DataFrame:
    """sin and cos of an angle, or of its difference to a reference angle, in its place."""
    a = F.col(angle) if reference is None else wrap_angle(F.col(angle) - F.col(reference))
    return df.withColumns({f"{angle}_sin": F.sin(a), f"{angle}_cos": F.cos(a)}).drop(angle)


#: Objects of the two compact maps.
HIGGS_OBJECTS = ("PRI_tau", "PRI_lep", "PRI_jet_leading", "PRI_jet_subleading")


#: Pairs of them whose kinematics are added.
HIGGS_PAIRS = (("PRI_tau", "PRI_lep"), ("PRI_tau", "PRI_jet_leading"), ("PRI_lep", "PRI_jet_leading"), ("PRI_jet_leading", "PRI_jet_subleading"))


def higgs_physics(df: DataFrame) -> DataFrame:
    """Angles as sin and cos, kinematics of objects with the missing momentum and of pairs, topology of the Higgs columns."""
    clean = {c: clean_sentinel(F.col(c)) for c in df.columns if c.startswith(("PRI_", "DER_"))}
    out = df.withColumns(clean)
    new: dict[str, Column] = {}
    for c in clean:
        if c.endswith("_phi"):
            new |= {f"{c}__sin": F.sin(c), f"{c}__cos": F.cos(c)}
    for a in HIGGS_OBJECTS:
        new |= {f"{a[4:]}_met__{k}": v for k, v in met_pair(F.col(f"{a}_pt"), F.col(f"{a}_phi"), F.col("PRI_met"), F.col("PRI_met_phi")).items()}
    for a, b in HIGGS_PAIRS:
        new |= {f"{a[4:]}_{b[4:]}__{n}": v for n, v in pair_kinematics(*(F.col(f"{o}_{q}") for o in (a, b) for q in ("pt", "eta", "phi"))).items()}
    if "PRI_jet_num" in df.columns:
        kind = topology(F.col("PRI_jet_num"))
        new |= {f"topology_{n}": (kind == k).cast("double") for k, n in enumerate(("0", "1", "2plus"))}
    return out.withColumns(new).drop(*(c for c in clean if c.endswith("_phi")))


def log_if_positive(df: DataFrame, columns: list[str], fitted: dict[str, bool] | None = None) -> tuple[DataFrame, dict[str, bool]]:
    """``df`` with <column>__log1p of the columns whose fitted minimum is not negative; the flags belong to the fit."""
    if fitted is None:
        with _compiled(df.sparkSession):
            row = df.agg(*(F.min(F.when(finite(F.col(c)), F.col(c))).alias(c) for c in columns)).first()
        fitted = {c: row[c] is not None and row[c] >= 0 for c in columns}
    return df.withColumns({f"{c}__log1p": F.when(F.col(c).isNotNull(), F.log1p(F.greatest(F.col(c), F.lit(0.0)))) for c in columns if fitted[c]}), fitted


def _kept(df: DataFrame, columns: list[str]) -> list[str]:
    return [c for c in df.columns if c not in columns]


#: Parts of the names of columns whose logarithm is added if they are never negative.
LOG_NAMES = ("_pt", "_mass", "_sumet")


@dataclass
class HiggsPhysicsMap:
    """``higgs_physics`` with logarithms of momenta, masses and sums, medians for missing values, flags scaled like the rest."""

    columns: list[str]
    keys: tuple[str, ...] = ()
    logged: dict[str, bool] = field(default_factory=dict)
    impute: ImputeMap | None = None

    def _mapped(self, df: DataFrame) -> DataFrame:
        out = higgs_physics(df.select(*self.keys, *self.columns))
        logs = [c for c in self.columns if any(n in c for n in LOG_NAMES) and c in out.columns]
        out, self.logged = log_if_positive(out, logs, self.logged or None)
        return out

    def fit(self, df: DataFrame) -> HiggsPhysicsMap:
        self.logged = {}
        mapped = self._mapped(df)
        self.impute = ImputeMap(_kept(mapped, list(self.keys)), scale_flags=True).fit(mapped)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return self.impute.transform(self._mapped(df))


#: Angles of the compact Higgs map, of which the last is the reference.
HIGGS_ANGLES = (*(f"{a}_phi" for a in HIGGS_OBJECTS), "PRI_met_phi")


@dataclass
class CompactHiggsMap:
    """Columns that are no angle, sin and cos of four angles against that of the missing momentum, unscaled flags.

    A flag stands for every original column with missing values in the fit.
    """

    columns: list[str]
    keys: tuple[str, ...] = ()
    flagged: list[str] = field(default_factory=list)
    impute: ImputeMap | None = None

    def _mapped(self, df: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
        missing = [c for c in HIGGS_ANGLES if c not in self.columns]
        if missing:
            raise ValueError(f"columns are missing: {missing}")
        clean = {c: clean_sentinel(F.col(c)) for c in self.columns}
        plain = {c: v for c, v in clean.items() if not c.endswith("_phi")}
        for a in HIGGS_OBJECTS:
            d = clean[f"{a}_phi"] - clean["PRI_met_phi"]
            plain |= {f"sin_dphi_{a}_met": F.sin(d), f"cos_dphi_{a}_met": F.cos(d)}
        return df.select(*self.keys, *(v.alias(c) for c, v in plain.items()), *(v.isNull().cast("double").alias(f"missing__{c}") for c, v in clean.items())), plain

    def fit(self, df: DataFrame) -> CompactHiggsMap:
        mapped, plain = self._mapped(df)
        seen = {c: F.when(F.col(f"missing__{c}") == 0, F.lit(0.0)) for c in self.columns if c not in plain}
        self.impute = ImputeMap(list(plain)).fit(mapped, seen)
        self.flagged = [c for c in self.columns if self.impute.missing[c]]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        mapped, plain = self._mapped(df)
        out = self.impute.transform(mapped)
        return out.select(*self.keys, *plain, *(f"missing__{c}" for c in self.flagged))


#: Columns of the SUSY table, its angles and their pairs.
SUSY_COLUMNS = (
    "lep1_pt", "lep1_eta", "lep1_phi", "lep2_pt", "lep2_eta", "lep2_phi", "missing_energy", "missing_phi",
    "MET_rel", "axial_MET", "M_R", "M_TR_2", "R", "MT2", "S_R", "M_Delta_R", "dPhi_r_b", "cos_theta_r1",
)
SUSY_ANGLES = (2, 5, 7)
SUSY_PAIRS = ((2, 5, "lep1_lep2"), (2, 7, "lep1_met"), (5, 7, "lep2_met"))


@dataclass
class SusyMap:
    """15 columns, sin and cos of three angles and of their differences, medians for missing values, scaled flags."""

    columns: list[str] = field(default_factory=lambda: list(SUSY_COLUMNS))
    keys: tuple[str, ...] = ()
    impute: ImputeMap | None = None

    def _mapped(self, df: DataFrame) -> DataFrame:
        if len(self.columns) != 18:
            raise ValueError("the SUSY map has 18 columns")
        x = [clean_sentinel(F.col(c)) for c in self.columns]
        out = {c: x[k] for k, c in enumerate(self.columns) if k not in SUSY_ANGLES}
        for k in SUSY_ANGLES:
            out |= {f"sin_{self.columns[k]}": F.sin(x[k]), f"cos_{self.columns[k]}": F.cos(x[k])}
        for a, b, name in SUSY_PAIRS:
            out |= {f"sin_dphi_{name}": F.sin(x[a] - x[b]), f"cos_dphi_{name}": F.cos(x[a] - x[b])}
        return df.select(*self.keys, *(v.alias(c) for c, v in out.items()))

    def fit(self, df: DataFrame) -> SusyMap:
        mapped = self._mapped(df)
        self.impute = ImputeMap(_kept(mapped, list(self.keys)), scale_flags=True).fit(mapped)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return self.impute.transform(self._mapped(df))


@dataclass
class TrackScaler:
    """Fields of nested tracks: (x - median) / (q90 - q10) over the tracks of all jets, clipped.

    A range below ``flat`` divides by it; missing values become 0 after scaling.
    """

    fields: list[str]
    limit: float = 10.0
    flat: float = 1e-6
    params: dict[str, tuple[float, float]] = field(default_factory=dict)

    def fit(self, df: DataFrame, tracks: str = "tracks") -> TrackScaler:
        rows = df.select(F.explode(tracks).alias("t"))
        held = column_quantiles(rows, {f: F.col("t")[f] for f in self.fields}, [0.1, 0.5, 0.9])
        self.params = {f: (m, max(b - a, self.flat)) for f, (a, m, b) in held.items()}
        return self

    def transform(self, df: DataFrame, tracks: str = "tracks") -> DataFrame:
        if not self.params:
            raise ValueError("not fitted")

        def scaled(t: Column) -> Column:
            for f, (m, s) in self.params.items():
                v = t[f].cast("double")
                t = t.withField(f, F.when(finite(v), clip((v - m) / s, -self.limit, self.limit)).otherwise(F.lit(0.0)))
            return t

        return df.withColumn(tracks, F.transform(tracks, scaled))


@dataclass
class IdentityMap:
    """The columns as they are; a value that is not finite makes the query fail."""

    columns: list[str]

    def fit(self, df: DataFrame) -> IdentityMap:
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        missing = [c for c in self.columns if c not in df.columns]
        if missing:
            raise ValueError(f"columns are missing: {missing}")
        refused = F.raise_error(F.lit("a feature is not finite")).cast("double")
        return df.withColumns({c: F.when(finite(F.col(c).cast("double")), F.col(c).cast("double")).otherwise(refused) for c in self.columns})


#: Maps by the name of a data set or of what they do.
MAPS = {"robust": RobustMap, "standard": StandardMap, "impute": ImputeMap, "higgs": CompactHiggsMap, "higgs_physics": HiggsPhysicsMap, "susy": SusyMap, "densenet": StandardMap, "tracks": TrackScaler, "identity": IdentityMap}


def make_map(name: str, columns: list[str], **how):
    """The feature map of this name."""
    if name not in MAPS:
        raise ValueError(f"a map is one of {sorted(MAPS)}")
    return MAPS[name](columns, **how)


def save_map(fitted, path: str) -> None:
    """A fitted map as JSON."""
    kind = next(k for k, v in MAPS.items() if type(fitted) is v)
    Path(path).write_text(json.dumps({"kind": kind, "map": asdict(fitted)}, indent=1))


def load_map(path: str):
    """The map that ``save_map`` wrote."""

    def made(kind: type, held: dict):
        out = kind(**held)
        for name, inner in (("impute", ImputeMap), ("robust", RobustMap)):
            if isinstance(getattr(out, name, None), dict):
                setattr(out, name, made(inner, getattr(out, name)))
        if hasattr(out, "params"):
            out.params = {c: tuple(v) for c, v in out.params.items()}
        return out

    data = json.loads(Path(path).read_text())
    return made(MAPS[data["kind"]], data["map"])
