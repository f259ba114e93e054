"""Arrow batches of a number of rows, for jobs whose rows are known to be small."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Rows of a batch, and the limit in bytes at which Spark does not measure a batch.
BATCH_ROWS, UNMEASURED = 4096, (1 << 31) - 1


@contextmanager
def by_rows(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside send batches of up to ``BATCH_ROWS`` rows to Python, whatever their bytes.

    Under a limit in bytes Spark measures the batch before each row, and a column of arrays
    is measured over all its rows: the time of a batch grows with the square of its rows.
    """
    names = {"spark.sql.execution.arrow.maxBytesPerBatch": UNMEASURED, "spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS}
    held = {n: spark.conf.get(n, None) for n in names}
    try:
        for n, v in names.items():
            spark.conf.set(n, str(v))
        yield
    finally:
        for n, v in held.items():
            if v is None:
                spark.conf.unset(n)
            else:
                spark.conf.set(n, v)
