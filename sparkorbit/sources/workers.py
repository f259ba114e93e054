"""Python workers find this package where the driver did."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def importable(spark: SparkSession) -> None:
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (root, paths)))
