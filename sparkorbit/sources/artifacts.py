"""Frozen splits, locked scores and fitted objects as tables and JSON below a folder."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import align, roles
from ..operators.estimator import OrbitalClassifier
from ..operators.readout import Readout
from . import files
from .tables import SchemaError, check_schema

#: Roles of a frozen split and the residues of their event numbers modulo 10.
FROZEN_ROLES = {"base": {0, 1, 2, 3, 4, 5}, "operator_validation": {6, 7}, "derivative_gate": {8}, "wp_validation": {8}, "independent_test": {9}}


def write_split(split: DataFrame, path: str) -> None:
    """Rows (source_row, event_number, role [, part])."""
    split.write.mode("overwrite").parquet(path)


def read_split(spark: SparkSession, path: str, residues: dict[str, set[int]] | None = FROZEN_ROLES) -> DataFrame:
    """A frozen split: known roles, every row once, no event in two roles, residues (None: any); else refused."""
    df = check_schema(spark.read.parquet(path), ["source_row", "event_number", "role"])
    held = residues or {r["role"]: set(range(10)) for r in df.select("role").distinct().limit(100).collect()}
    faults = roles.split_violations(df, df.select("source_row").distinct().count(), held, nested={"encoder_train": "base", "encoder_early_stop": "base", "architecture_validation": "base"}, part="part" if "part" in df.columns else None).first().asDict()
    if any(faults.values()):
        raise SchemaError(f"the split is not valid: {faults}")
    return df


def read_split_arrays(spark: SparkSession, path: str, names: tuple[str, ...] = tuple(FROZEN_ROLES)) -> DataFrame:
    """A split of index arrays in an NPZ file as rows (source_row, event_number, role)."""
    with np.load(path, allow_pickle=False) as held:
        missing = [n for n in ("sampled_source_rows", "sampled_event_numbers", *names) if n not in held.files]
        if missing:
            raise SchemaError(f"arrays are missing: {missing}")
        rows, events = held["sampled_source_rows"], held["sampled_event_numbers"]
        if len(rows) != len(events) or (np.diff(rows) <= 0).any() or (len(rows) and rows[0] < 0):
            raise SchemaError("source rows ascend from 0 on and have an event each")
        out = []
        for n in names:
            if len(held[n]) and not 0 <= held[n].min() <= held[n].max() < len(rows):
                raise SchemaError(f"{n} has places outside the sample")
            out += [(int(rows[k]), int(events[k]), n) for k in held[n]]
    if sorted(r[0] for r in out) != rows.tolist():
        raise SchemaError("the roles do not hold every row once")
    return spark.createDataFrame(out, "source_row long, event_number long, role string")


#: File names of state exports below a run's folder, the first kind that is there counts.
STATE_FILES = (
    "self_configuring_locked_test_orbitals.csv.gz",
    "self_configuring_locked_test_orbitals.csv",
    "self_configuring_locked_test_predictions_with_orbitals.csv.gz",
    "self_configuring_locked_test_predictions.csv.gz",
    "self_configuring_locked_test_orbitals.npz",
    "*locked*test*orbital*.csv*",
    "*locked*test*state*.csv*",
    "*locked*test*orbital*.npz",
)
#: Prefixes of the columns that hold a state, and arrays that do; the first one that is there counts.
STATE_COLUMNS = ("normalized_orbital", "selected_orbital", "orbital", "phi", "psi")
STATE_ARRAYS = ("orbitals", "normalized_state")
STATE_SCHEMA = "source_row long, event_number long, y int, state array<double>"


def find_states(spark: SparkSession, root: str, patterns: tuple[str, ...] = STATE_FILES) -> DataFrame:
    """(path, bytes, digest, kind) of the state exports anywhere below a folder; executors read and digest them.

    ``kind`` is the number of the pattern that the file's name has first.
    """
    out = None
    for k, p in enumerate(patterns):
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", p).load(root)
        found = found.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("digest"), F.lit(k).alias("kind"))
        out = found if out is None else out.unionByName(found)
    return out.groupBy("path", "bytes", "digest").agg(F.min("kind").alias("kind"))


def choose_states(found: DataFrame) -> str | None:
    """The path of the export to read, or None: of the first kind that holds states.

    CSV files without state columns are passed over.  Several files of a kind are one if
    their contents are equal, else refused.
    """
    each = found.groupBy("kind").agg(F.countDistinct("digest").alias("n"), F.array_sort(F.collect_set("path")).alias("paths"))
    for row in each.orderBy("kind").collect():  # a row for each pattern
        path = row["paths"][0]
        if not path.endswith(".npz") and not _has_states(found.sparkSession.read.csv(path, header=True).columns):
            continue
        if row["n"] > 1:
            raise SchemaError(f"state exports differ: {row['paths'][:10]}")
        return path
    return None


def _has_states(columns: list[str]) -> bool:
    try:
        return bool(state_columns(columns))
    except SchemaError:
        return False


def state_columns(columns: list[str]) -> list[str]:
    """The columns of a state, by number: those of the first prefix of ``STATE_COLUMNS`` that has any."""
    for prefix in STATE_COLUMNS:
        held = sorted((int(m[1]), c) for c in columns if (m := re.fullmatch(prefix + r"_?(\d+)", c, re.IGNORECASE)))
        if held:
            return [c for _, c in held]
    raise SchemaError("no state columns")


def read_states(spark: SparkSession, path: str, label: str = "y") -> DataFrame:
    """(source_row, event_number, y, state) of a CSV, or of the arrays of an NPZ file, which an executor reads."""
    if not path.endswith(".npz"):
        df = spark.read.csv(path, header=True)
        columns = state_columns(df.columns)
        check_schema(df, ["source_row", "event_number", label])
        number = lambda c: F.col(c).cast("double").cast("long")
        return df.select(number("source_row").alias("source_row"), number("event_number").alias("event_number"), number(label).cast("int").alias("y"), F.array(*(F.col(c).cast("double") for c in columns)).alias("state"))

    def arrays(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in it:
            for content in frame["content"]:
                with np.load(io.BytesIO(content), allow_pickle=False) as held:
                    state = next((n for n in STATE_ARRAYS if n in held.files), None)
                    missing = [n for n in ("source_row", "event_number", label) if n not in held.files]
                    if missing or state is None:
                        raise SchemaError(f"arrays are missing: {missing or ['orbitals']}")
                    keys, values = [held[n] for n in ("source_row", "event_number", label)], held[state].astype(float)
                if values.ndim != 2 or not values.shape[1] or {len(k) for k in keys} != {len(values)}:
                    raise SchemaError("a state array has a row for each jet and a column for each mode")
                for i in range(0, len(values), 10_000):
                    part = slice(i, i + 10_000)
                    yield pd.DataFrame({"source_row": keys[0][part], "event_number": keys[1][part], "y": keys[2][part], "state": list(values[part])})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(arrays, STATE_SCHEMA)


def align_states(expected: DataFrame, states: DataFrame, keys: list[str] = align.KEYS, prefix: str = "phi_") -> DataFrame:
    """``expected`` with the columns ``prefix``<number> of exactly its rows, renamed orbital_1 ..., all finite."""
    columns = align.orbital_columns(states.columns, prefix)
    if not columns:
        raise SchemaError(f"no columns {prefix}<number>")
    check_schema(states, keys)
    finite = F.lit(True)
    for c in columns:
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    checked = states.select(*keys, *(F.col(c).alias(f"orbital_{k + 1}") for k, c in enumerate(columns)), finite.cast("double").alias("_finite"))
    if states.count() != expected.count() or checked.where("_finite = 0").limit(1).count():
        raise align.AlignmentError("states have other rows, or values that are not finite")
    return align.align_predictions(expected, checked, "_finite", "_ok", keys).drop("_ok").join(checked.drop("_finite"), keys)


def read_comparison(spark: SparkSession, reference: DataFrame, baselines: dict[str, DataFrame], keys: list[str] = align.KEYS, score: str = "score") -> DataFrame:
    """The reference's rows with the score of every baseline, all aligned one to one."""
    out = reference
    for name, df in baselines.items():
        out = align.align_predictions(out, df, score, name, keys)
    return out


def with_features(left: DataFrame, right: DataFrame, key: str = "source_row", complete: bool = False) -> DataFrame:
    """A left join on a key that both have once; ``complete`` also asks for a partner of every row."""
    for df in (left, right):
        if df.groupBy(key).count().where("count > 1").limit(1).count():
            raise align.AlignmentError(f"{key} repeats")
    if complete and (left.join(right, key, "left_anti").limit(1).count() or right.join(left, key, "left_anti").limit(1).count()):
        raise align.AlignmentError("rows without a partner")
    return left.join(right, key, "left")


def metric_intervals(metrics: DataFrame, intervals: DataFrame, key: str = "method") -> DataFrame:
    """Metrics with their intervals, one row for each method; a method without intervals has nulls."""
    return with_features(metrics, intervals, key)


def comparison_table(points: DataFrame, efficiencies: list[float], value: str = "rejection") -> DataFrame:
    """(method, <value>_<percent> ...): a value of the working points by efficiency."""
    out = points.groupBy("method").pivot("efficiency", efficiencies).agg(F.first(value))
    return out.select("method", *(F.col(f"`{e}`").alias(f"{value}_{round(e * 100)}") for e in efficiencies))


def write_matrix(entries: DataFrame, path: str) -> None:
    """A sparse matrix as rows (src, dst, value), in order of the rows."""
    entries.select("src", "dst", "value").repartitionByRange("src").sortWithinPartitions("src", "dst").write.mode("overwrite").parquet(path)


def write_vertices(path: str, posterior: DataFrame, potential: DataFrame, states: DataFrame, eigen: DataFrame, selected: list[int]) -> None:
    """Posterior, information, potential and state of every vertex, and the eigenvalues with their selection."""
    phi = states.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "phi"))).alias("_p")).select("id", F.transform("_p", lambda x: x["phi"]).alias("phi"))
    rows = posterior.select("id", "degree", "p1").join(potential.select("id", "j", "v"), "id").join(phi, "id")
    rows.write.mode("overwrite").parquet(f"{path}/vertices")
    eigen.withColumn("selected", F.col("k").isin(*selected)).write.mode("overwrite").parquet(f"{path}/eigen")


def save_classifier(model: OrbitalClassifier, path: str) -> None:
    """A fitted classifier: tables of landmarks, modes and eigenvalues, its readout and parameters as JSON."""
    fit = model.fitted
    if not fit:
        raise ValueError("not fitted")
    for name in ("landmarks", "eigen", "long"):
        fit[name].write.mode("overwrite").parquet(f"{path}/{name}")
    own = {n: getattr(model, n) for n in ("k", "k_sigma", "modes", "betas", "mass", "max_landmarks", "max_readout", "id_col", "vector_col", "label")}
    kept = {n: fit[n] for n in ("beta", "loss", "selected", "prefix")} | {"readout": fit["readout"].m.tolist(), "readout_loss": fit["readout"].loss}
    files.replace_json(f"{path}/model.json", {"parameters": own, "fitted": kept})


def load_classifier(spark: SparkSession, path: str) -> OrbitalClassifier:
    """The classifier that ``save_classifier`` wrote; its readout is checked."""
    held = files.read_json(f"{path}/model.json")
    model = OrbitalClassifier(**held["parameters"] | {"betas": tuple(held["parameters"]["betas"])})
    fit = dict(held["fitted"])
    readout = Readout(np.array(fit.pop("readout")), fit.pop("readout_loss"))
    readout.check()
    model.fitted = fit | {n: spark.read.parquet(f"{path}/{n}") for n in ("landmarks", "eigen", "long")} | {"readout": readout}
    return model
