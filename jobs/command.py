"""The command line that the jobs share: a config file, plain paths, and a session that ends with the job."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path


def main(doc: str, run: Callable[..., dict], paths: tuple[str, ...], config: str, argv: list[str] | None = None) -> None:
    """Call ``run(spark, **paths, **config)`` in a session of its own and log what it returns."""
    args = argparse.ArgumentParser(description=doc)
    args.add_argument("--config", default=str(Path(__file__).with_name(config)), help="JSON file of settings")
    for p in paths:
        args.add_argument(f"--{p}", required=True, help="path, local or remote")
    given = vars(args.parse_args(argv))
    settings = json.loads(Path(given.pop("config")).read_text())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")

    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName(run.__module__).getOrCreate()
    try:
        logging.getLogger(run.__module__).info("done: %s", run(spark, **given, **settings))
    finally:
        spark.stop()
