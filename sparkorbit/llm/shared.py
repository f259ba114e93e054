"""Storage and size-check helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a slim side (a few longs a row) may be broadcast: under 64 MB.
BROADCAST_ROWS = 1_000_000
#: Bytes up to which a side with long rows may be broadcast.
BROADCAST_BYTES = 64 << 20
#: A key is heavy if it has more than this share of all rows, and this many: there are at most 1 / share of them.
HEAVY_SHARE, HEAVY_ROWS = 1 / 10_000, 256

_written: list[tuple[SparkSession, str]] = []


#: Rows of an Arrow batch of documents: a Python worker holds a few MB of text at once.
ARROW_ROWS = 500


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver did, and keep their batches small.

    The session's Arrow batch size is set to ``ARROW_ROWS`` if it is the default.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # the default
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (root, paths)))


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    If it is unset, a local session gets a temporary one; on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="sparkorbit-")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; removed when the driver ends."""
    path = f"{shared_dir(spark)}/sparkorbit/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def kept(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder that stays when the driver ends."""
    return f"{shared_dir(spark)}/sparkorbit-kept/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write the rows as a table in the shared folder and read it again."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``materialize`` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_scratch", None)
        if path is not None:
            _delete(df.sparkSession, path)
            _written.remove((df.sparkSession, path))
            df._scratch = None


def _remove() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            return


atexit.register(_remove)


def is_small(df: DataFrame) -> bool:
    """Whether the (materialized) side has at most ``BROADCAST_ROWS`` rows."""
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def checked_broadcast(df: DataFrame) -> DataFrame:
    """Broadcast hint if the side is small; else a shuffle join."""
    return F.broadcast(df) if is_small(df) else df


def broadcast_by_size(df: DataFrame, size: Column) -> DataFrame:
    """Broadcast hint if the rows of the (materialized) side have at most ``BROADCAST_BYTES``, of ``size`` each."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else df


def heavy_keys(counts: DataFrame, keys: list[str]) -> DataFrame | None:
    """The heavy keys of ``counts``, which has the keys and ``n``, the rows that have them; None if there are none.

    They are 1 / ``HEAVY_SHARE`` at most, whatever the number of rows.
    """
    least = max(HEAVY_ROWS, int((counts.agg(F.sum("n")).first()[0] or 0) * HEAVY_SHARE))
    heavy = materialize(counts.where(F.col("n") > least).select(*keys), "heavy")
    return heavy if heavy.limit(1).count() else None


def join_by_key(rows: DataFrame, values: DataFrame, keys: list[str], heavy: DataFrame | None) -> DataFrame:
    """``rows`` (materialized) with the columns of ``values``, which has one row for each of the non-null keys.

    Rows of heavy keys stay where they are and get their values by broadcast; the
    others are joined as Spark sees fit.
    """
    if heavy is None:
        return rows.join(values, keys)
    light = rows.join(F.broadcast(heavy), keys, "left_anti").join(values, keys)
    some = values.join(F.broadcast(heavy), keys, "left_semi")
    return light.unionByName(rows.join(F.broadcast(some), keys))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them as far as columns of ``df`` clash with them."""
    held = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in held:
            name = "_" + name
        out.append(name)
    return out


def text_of(col: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))
