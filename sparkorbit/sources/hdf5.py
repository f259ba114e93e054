"""HDF5 compound datasets: a data source of row ranges, and the rows of a table read once for each chunk.

Needs h5py on the driver and the executors; where it is missing, reading is refused.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from .tables import SchemaError
from .workers import importable

#: Rows of a chunk where the dataset has none, and of a partition, about.
CHUNK, PART_ROWS = 4096, 100_000
ROW = "source_row"
PUSH = "spark.sql.python.filterPushdown.enabled"


def _h5py():
    try:
        import h5py
    except ImportError:
        raise SchemaError("reading HDF5 needs h5py, which is not installed here") from None
    return h5py


def kinds_of(dtype: np.dtype, fields: list[str] | None = None) -> dict[str, str]:
    """Spark types of the fields of a compound type; unknown fields are refused."""
    names = list(dtype.names or ()) if fields is None else fields
    unknown = [c for c in names if c not in (dtype.names or ())]
    if unknown:
        raise SchemaError(f"no fields {unknown}")
    return {c: {"i": "long", "u": "long", "b": "boolean"}.get(dtype[c].kind, "double") for c in names}


def chunk_ranges(n: int, chunk: int, low: int = 0, high: int | None = None, rows: int = PART_ROWS) -> list[tuple[int, int]]:
    """Ranges of whole chunks, cut at ``low`` and ``high``, of about ``rows`` rows each."""
    high = n if high is None else min(n, high)
    low, step = max(0, low), max(1, rows // chunk) * chunk
    cuts = range(low // step * step, high, step)
    return [(max(low, a), min(high, a + step)) for a in cuts if max(low, a) < min(high, a + step)]


class Range(InputPartition):
    def __init__(self, first: int, end: int) -> None:
        self.first, self.end = first, end


class Hdf5Source(DataSource):
    """Format ``hdf5_rows``: options ``path`` and ``dataset``; a schema with some of the fields reads those alone."""

    @classmethod
    def name(cls) -> str:
        return "hdf5_rows"

    def schema(self) -> str:
        with _h5py().File(self.options["path"], "r") as f:
            kinds = kinds_of(f[self.options["dataset"]].dtype)
        return ", ".join([f"{ROW} long", *(f"`{c}` {k}" for c, k in kinds.items())])

    def reader(self, schema: StructType) -> DataSourceReader:
        kind = PushingReader if self.options.get("pushdown") == "true" else Hdf5Reader
        return kind(schema, dict(self.options))


class Hdf5Reader(DataSourceReader):
    """A partition for each range of chunks."""

    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.path, self.dataset = options["path"], options["dataset"]
        self.rows = int(options.get("rowsperpartition", PART_ROWS))  # keys come in lower case
        self.schema, self.low, self.high = schema, 0, None

    def partitions(self) -> list[InputPartition]:
        with _h5py().File(self.path, "r") as f:
            data = f[self.dataset]
            kinds_of(data.dtype, [c for c in self.schema.names if c != ROW])
            return [Range(a, b) for a, b in chunk_ranges(len(data), data.chunks[0] if data.chunks else CHUNK, self.low, self.high, self.rows)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fields, kinds = [c for c in self.schema.names if c != ROW], to_arrow_schema(self.schema)
        with _h5py().File(self.path, "r") as f:
            data = f[self.dataset]
            chunk = data.chunks[0] if data.chunks else CHUNK
            for a, b in chunk_ranges(len(data), chunk, partition.first, partition.end, chunk):
                held = data.fields(fields)[a:b] if fields else None
                cols = [pa.array(np.arange(a, b)) if c == ROW else pa.array(np.ascontiguousarray(held[c])) for c in self.schema.names]
                yield pa.RecordBatch.from_arrays([x.cast(k.type) for x, k in zip(cols, kinds, strict=True)], schema=kinds)


class PushingReader(Hdf5Reader):
    """Comparisons of the row number cut the ranges; for sessions that push filters to Python sources."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) != (ROW,):
                yield f
                continue
            least, most = self.low, self.high
            if isinstance(f, EqualTo):
                least, most = f.value, f.value + 1
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                least = f.value + isinstance(f, GreaterThan)
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                most = f.value + isinstance(f, LessThanOrEqual)
            else:
                if isinstance(f, In) and f.value:
                    least, most = min(f.value), max(f.value) + 1
                yield f  # rows in between are still to be left out
            self.low = max(self.low, least)
            self.high = most if self.high is None else self.high if most is None else min(self.high, most)


def read_hdf5(spark: SparkSession, path: str, dataset: str, fields: list[str] | None = None, rows_per_part: int = PART_ROWS) -> DataFrame:
    """``source_row`` and fields of a compound dataset, by ranges of whole chunks (None: all fields).

    With ``spark.sql.python.filterPushdown.enabled``, filters on ``source_row`` cut what is read.
    """
    importable(spark)
    spark.dataSource.register(Hdf5Source)
    reader = spark.read.format("hdf5_rows").option("dataset", dataset).option("rowsPerPartition", rows_per_part)
    reader = reader.option("pushdown", spark.conf.get(PUSH, "false"))
    if fields is not None:
        with _h5py().File(path, "r") as f:
            reader = reader.schema(", ".join([f"{ROW} long", *(f"`{c}` {k}" for c, k in kinds_of(f[dataset].dtype, fields).items())]))
    return reader.load(path)


def increasing(rows: list[int]) -> list[int]:
    """The rows, if each is larger than the one before and none below 0; else refused."""
    held = np.asarray(rows, dtype=np.int64)
    if held.ndim != 1 or (np.diff(held) <= 0).any() or (len(held) and held[0] < 0):
        raise SchemaError("source rows strictly increase, from 0 on")
    return held.tolist()


def read_rows(spark: SparkSession, path: str, dataset: str, fields: list[str], rows: DataFrame) -> DataFrame:
    """``source_row`` and fields of the rows of a table (source_row): each chunk that holds any is read once.

    Rows that repeat, are null or lie outside the dataset are refused.
    """
    importable(spark)
    with _h5py().File(path, "r") as f:
        data = f[dataset]
        n, chunk, kinds = len(data), data.chunks[0] if data.chunks else CHUNK, kinds_of(data.dtype, fields)

    def read(frame: pd.DataFrame) -> pd.DataFrame:
        at = np.sort(frame[ROW].to_numpy())
        if frame[ROW].isna().any() or at[0] < 0 or at[-1] >= n or (np.diff(at) == 0).any():
            raise SchemaError(f"source rows are distinct and lie in 0 to {n - 1}")
        first = int(at[0]) // chunk * chunk
        with _h5py().File(path, "r") as f:
            held = f[dataset].fields(fields)[first : min(first + chunk, n)]
        cast = {"long": np.int64, "boolean": bool, "double": np.float64}
        return pd.DataFrame({ROW: at} | {c: held[c][at - first].astype(cast[k]) for c, k in kinds.items()})

    schema = ", ".join([f"{ROW} long", *(f"`{c}` {k}" for c, k in kinds.items())])
    return rows.select(F.col(ROW).cast("long")).groupBy(F.floor(F.col(ROW) / chunk).alias("_chunk")).applyInPandas(read, schema)
