"""Small text files on any file system that Spark reaches, made at once or not at all."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from .tables import to_json


def _at(path: str, spark: SparkSession | None = None):
    spark = spark or SparkSession.active()
    held = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(path))
    return held, held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _kind(e: Py4JJavaError) -> str:
    return e.java_exception.getClass().getSimpleName()


def exists(path: str) -> bool:
    at, fs = _at(path)
    return bool(fs.exists(at))


def read_json(path: str) -> object:
    at, fs = _at(path)
    try:
        stream = fs.open(at)
    except Py4JJavaError as e:
        raise FileNotFoundError(path) if _kind(e) == "FileNotFoundException" else e from None
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _write(path, fs, value: object, overwrite: bool) -> None:
    stream = fs.create(path, overwrite)
    try:
        stream.write(bytearray(json.dumps(to_json(value), indent=1, sort_keys=True).encode()))
    finally:
        stream.close()


def create_json(path: str, value: object) -> bool:
    """Write a file that is not there yet; False if it is, also if another process is quicker."""
    at, fs = _at(path)
    try:
        _write(at, fs, value, False)
    except Py4JJavaError as e:
        if _kind(e) == "FileAlreadyExistsException" or fs.exists(at):
            return False
        raise
    return True


def replace_json(path: str, value: object) -> None:
    """Write a file, in place of one that is there: beside it first, so that a reader never sees half of it."""
    at, fs = _at(path)
    beside = _at(f"{path}.{uuid.uuid4().hex}")[0]
    _write(beside, fs, value, True)
    if not fs.rename(beside, at):  # some file systems do not rename onto a file
        fs.delete(at, False)
        if not fs.rename(beside, at):
            raise OSError(f"{path} cannot be written")
