"""Batches for Python are limited by rows while a distributed solver or join runs, and as before afterwards."""

import pytest

from sparkorbit.functions import batches
from sparkorbit.operators import eigensolver, metric_join

BYTES, ROWS = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.mark.parametrize("module", [eigensolver, metric_join])
def test_jobs_run_with_batches_by_rows(spark, monkeypatch, module):
    seen, old, before = [], module.stored, (spark.conf.get(BYTES), spark.conf.get(ROWS))
    monkeypatch.setattr(module, "stored", lambda df: (seen.append((spark.conf.get(BYTES), spark.conf.get(ROWS))), old(df))[1])
    if module is eigensolver:
        df = spark.createDataFrame([(i, i, float(i)) for i in range(5)], "src long, dst long, value double")
        assert module.smallest_modes(df, 2)[0] == pytest.approx([0, 1], abs=1e-9)
    else:
        df = spark.createDataFrame([(i, [float(i)]) for i in range(5)], "vec_id long, embedding array<double>")
        assert module.knn_by_pivots(df, df, 1).count() == 5
    assert seen and set(seen) == {(str(batches.UNMEASURED), str(batches.BATCH_ROWS))}
    assert (spark.conf.get(BYTES), spark.conf.get(ROWS)) == before


def test_settings_come_back_after_an_error(spark):
    before = spark.conf.get(BYTES), spark.conf.get(ROWS)
    with pytest.raises(KeyError), batches.by_rows(spark):
        raise KeyError
    assert (spark.conf.get(BYTES), spark.conf.get(ROWS)) == before
