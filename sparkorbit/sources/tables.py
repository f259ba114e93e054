"""Readers with schema checks, and writers of results."""

from __future__ import annotations

import json
import math
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..operators.features import SUSY_COLUMNS
from ..operators.roles import group_conflicts, group_limit, proportional_sample


class SchemaError(ValueError):
    """Columns that are missing or may not be there."""


def check_schema(df: DataFrame, required: list[str], forbidden: list[str] = ()) -> DataFrame:
    """``df`` if it has all required and no forbidden columns; reads no rows."""
    missing = [c for c in required if c not in df.columns]
    present = [c for c in forbidden if c in df.columns]
    if missing or present:
        raise SchemaError(f"missing: {missing}; forbidden: {present}")
    return df


def read_parquet(spark: SparkSession, path: str, required: list[str] = (), forbidden: list[str] = ()) -> DataFrame:
    return check_schema(spark.read.parquet(path), list(required), list(forbidden))


#: Spellings of the two classes, and columns of a header CSV that are no features.
LABELS = {"b": 0, "s": 1, "background": 0, "signal": 1, "0": 0, "1": 1, "0.0": 0, "1.0": 1}
DROPPED = ("EventId", "EventID", "event_id", "Weight", "weight", "KaggleSet", "KaggleWeight")


def encode_labels(df: DataFrame, column: str, name: str = "y") -> DataFrame:
    """0 / 1 from b, s, background, signal, 0, 1; else from the two distinct values in order."""
    known = F.create_map(*(F.lit(v) for pair in LABELS.items() for v in pair))
    y = known[F.lower(F.trim(F.col(column).cast("string")))]
    if not df.where(y.isNull()).limit(1).count():
        return df.withColumn(name, y)
    values = sorted(r[0] for r in df.select(column).distinct().limit(3).collect())
    if len(values) != 2:
        raise ValueError("labels need two values")
    return df.withColumn(name, (F.col(column) == F.lit(values[1])).cast("int"))


def read_header_csv(spark: SparkSession, path: str, label: str, drop: tuple[str, ...] = DROPPED, sample: int = 0, seed: int = 0) -> DataFrame:
    """A CSV with header: id and weight columns dropped, numbers, columns without any value dropped.

    ``sample`` rows keep the shares of the classes; 0 takes all.
    """
    df = spark.read.csv(path, header=True).drop(*drop)
    numbers = [c for c in df.columns if c != label]
    df = df.select(label, *(F.expr(f"try_cast(`{c}` as double)").alias(c) for c in numbers))
    row = df.agg(*(F.count(c).alias(c) for c in numbers)).first()
    out = encode_labels(df.select(label, *(c for c in numbers if row[c])), label)
    if sample <= 0:
        return out
    # The key is a hash of the row, so that the sample does not depend on the files' partitioning.
    return proportional_sample(out.withColumn("_key", F.xxhash64(*out.columns)), sample, "_key", seed=seed).drop("_key")


def read_plain_csv(spark: SparkSession, path: str, names: list[str], first: int = 0) -> DataFrame:
    """A CSV without header, of the named doubles, and ``source_row``, a row's number in the order of the files.

    Other widths are refused by the parser; ``first`` rows in that order, 0 for all.
    """
    schema = StructType([StructField(n, DoubleType()) for n in names])
    df = spark.read.csv(path, schema=schema, mode="FAILFAST", enforceSchema=True)
    numbered = df.withColumn("_m", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_m", 33))
    counts = numbered.groupBy("_p").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_p", before.alias("_before"))  # a row for each partition
    out = numbered.join(F.broadcast(offsets), "_p").withColumn("source_row", F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
    return (out.where(F.col("source_row") < first) if first > 0 else out).select("source_row", *names)


def read_susy(spark: SparkSession, path: str, first: int = 0) -> DataFrame:
    """Label y and the 18 named columns of the SUSY table, its ``first`` rows in file order; each row is a group."""
    df = read_plain_csv(spark, path, ["y", *SUSY_COLUMNS], first).withColumn("y", F.col("y").cast("int"))
    labels = {r["y"] for r in df.select("y").distinct().limit(3).collect()}
    if labels != {0, 1}:
        raise SchemaError(f"labels are {sorted(map(str, labels))}, not 0 and 1")
    return df.withColumn("group_id", F.col("source_row").cast("string"))


def read_wide_csv(spark: SparkSession, path: str, prefix: str = "f_", group: str | None = None, label: str | None = None, sample: int = 0, seed: int = 0) -> DataFrame:
    """A CSV of many columns prefix + number as one array; equal rows share a group unless one is named.

    Only the header is read to find the columns.  Groups of several labels are
    refused; ``sample`` keeps whole groups, about so many rows, 0 all.
    """
    names = spark.read.csv(path, header=True).columns
    cols = sorted((c for c in names if c.startswith(prefix) and c[len(prefix) :].isdigit()), key=lambda c: int(c[len(prefix) :]))
    if not cols:
        raise SchemaError(f"no columns {prefix}<number>")
    schema = StructType([StructField(c, DoubleType() if c in set(cols) else StringType()) for c in names])
    df = spark.read.csv(path, schema=schema, header=True, mode="FAILFAST")
    owner = F.col(group) if group else F.xxhash64(*cols).cast("string")
    out = df.select(*(c for c in names if c not in set(cols)), F.array(*cols).alias("x"), owner.alias("group_id"))
    if label is None:
        return out
    out = encode_labels(out, label)
    if group_conflicts(out, "group_id", "y").limit(1).count():
        raise SchemaError("a group has several labels")
    return group_limit(out.withColumn("_g", F.xxhash64("group_id")), sample, "_g", "y", seed).drop("_g")


#: The tables by name.
DATASETS = {
    "higgs": lambda spark, path, sample=0, seed=0: read_header_csv(spark, path, "Label", sample=sample, seed=seed),
    "susy": lambda spark, path, sample=0, seed=0: read_susy(spark, path, sample),
    "densenet": lambda spark, path, sample=0, seed=0: read_wide_csv(spark, path, label="label", sample=sample, seed=seed),
}


def read_dataset(spark: SparkSession, name: str, path: str, sample: int = 0, seed: int = 0) -> DataFrame:
    """The table of this name: features, y and, where rows belong together, group_id."""
    if name not in DATASETS:
        raise ValueError(f"a data set is one of {sorted(DATASETS)}")
    return DATASETS[name](spark, path, sample=sample, seed=seed)


def read_predictions(spark: SparkSession, path: str, required: list[str], label: str = "y", key: str = "source_row") -> DataFrame:
    """A CSV (gzip too) of predictions: required columns, unique keys, both classes.

    The header names the columns; required ones are numbers, the label is an integer,
    and so are the key and the event number.  Others stay text.
    """
    df = check_schema(spark.read.csv(path, header=True), [*required, label, key])
    kinds = {c: "double" for c in required} | {c: "long" for c in (key, "event_number") if c in df.columns} | {label: "int"}
    df = df.withColumns({c: F.col(c).cast("double").cast(k) for c, k in kinds.items()})
    faults = df.groupBy(key).count().where("count > 1").limit(1).count()
    if faults or {r[0] for r in df.select(label).distinct().limit(3).collect()} != {0, 1}:
        raise SchemaError("rows repeat, or a class is missing")
    return df


def write_table(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Parquet, or CSV with header and gzip."""
    if form == "csv":
        df.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)
    else:
        df.write.mode("overwrite").parquet(path)


def to_json(value: object) -> object:
    """Plain JSON values: numbers that are not finite become null, array scalars plain numbers."""
    if isinstance(value, dict):
        return {str(k): to_json(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [to_json(v) for v in value]
    if hasattr(value, "item"):
        value = value.item()
    return None if isinstance(value, float) and not math.isfinite(value) else value


def write_json(value: object, path: str) -> None:
    Path(path).write_text(json.dumps(to_json(value), indent=1, sort_keys=True))
