"""Tables written to the shared folder, so that what follows reads them instead of computing them again."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; if it is unset, a local session gets a temporary folder and a cluster an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="sparkorbit-")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What a query that runs inside has shuffled is removed at its end, not when the driver happens to collect garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if held is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, held)


def stored(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written once; ``release`` or the end of the driver removes them, and what they shuffled goes at once."""
    path = f"{shared_dir(df.sparkSession)}/sparkorbit-core/{uuid.uuid4().hex}"
    _written.append((df.sparkSession, path))
    with _shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored = path
    return out


def together(tables: list[DataFrame]) -> DataFrame:
    """The rows of tables of one schema made by ``stored``, as one scan."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*(df._stored for df in tables))


def release(*tables: DataFrame) -> None:
    """Remove tables made by ``stored`` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_stored", None)
        if path is not None:
            _delete(df.sparkSession, path)
            _written.remove((df.sparkSession, path))
            df._stored = None


@contextmanager
def scope() -> Iterator[None]:
    """Remove at the end the tables that ``stored`` has made inside; nothing may read them afterwards."""
    held = len(_written)
    try:
        yield
    finally:
        for spark, path in _written[held:]:
            _delete(spark, path)
        del _written[held:]


@atexit.register
def _remove() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            return
