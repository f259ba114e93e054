"""Digests, file checks and guards that keep a frozen test from being scored twice or by other code."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .tables import to_json

#: Size and Adler-32 of the published files.
PUBLISHED = {
    "small": ("mc-flavtag-ttbar-small.h5", 3055139850, "8d7e9098"),
    "medium": ("mc-flavtag-ttbar-medium.h5", 13935881976, "e29be59c"),
    "large": ("mc-flavtag-ttbar-large.h5", 90797951148, "61adcbcb"),
}
_BLOCK = 1 << 24


class GuardError(RuntimeError):
    """A file, a manifest or a stored score that is not the expected one."""


def _blocks(path: str | Path):
    with open(path, "rb") as f:
        while block := f.read(_BLOCK):
            yield block


def file_sha256(path: str | Path) -> str:
    held = hashlib.sha256()
    for block in _blocks(path):
        held.update(block)
    return held.hexdigest()


def file_adler32(path: str | Path) -> str:
    value = 1
    for block in _blocks(path):
        value = zlib.adler32(block, value)
    return f"{value:08x}"


def tree_sha256(root: str | Path, pattern: str = "*.py") -> str:
    """The digest of the names and contents of all files below a folder."""
    held = hashlib.sha256()
    for path in sorted(Path(root).rglob(pattern)):
        held.update(f"{path.relative_to(root).as_posix()}\0{file_sha256(path)}\n".encode())
    return held.hexdigest()


def index_sha256(rows: list[int]) -> str:
    """The digest of a list of row numbers, as little-endian 64-bit numbers."""
    return hashlib.sha256(b"".join(int(r).to_bytes(8, "little", signed=True) for r in rows)).hexdigest()


def check_file(path: str | Path, size: int, adler32: str) -> dict:
    """Size first, then Adler-32; anything else than expected is refused."""
    found = Path(path).stat().st_size
    if found != size:
        raise GuardError(f"{path} has {found} bytes, not {size}")
    digest = file_adler32(path)
    if digest != adler32:
        raise GuardError(f"{path} has Adler-32 {digest}, not {adler32}")
    return {"file": Path(path).name, "size": size, "adler32": digest}


def check_published(path: str | Path, tier: str | None = None) -> dict:
    """``check_file`` for a published file, its tier by name if it is not given."""
    tier = tier or next((t for t, (name, _, _) in PUBLISHED.items() if name == Path(path).name), None)
    if tier not in PUBLISHED:
        raise GuardError(f"no published file is named {Path(path).name}")
    return {"tier": tier} | check_file(path, *PUBLISHED[tier][1:])


def resolve_input(path: str | None, roots: list[str], name: str) -> Path:
    """The explicit path, or the one file of this name below the roots; several are one if their content is equal."""
    if path:
        if not Path(path).exists():
            raise FileNotFoundError(path)
        return Path(path)
    found = sorted({p.resolve() for r in roots for p in Path(r).rglob(name) if p.is_file()})
    if not found:
        raise FileNotFoundError(f"{name} below {roots}")
    if len({file_sha256(p) for p in found}) > 1:
        raise GuardError(f"several files are named {name}: {[str(p) for p in found]}")
    return found[0]


def score_once(status: str | Path, context: dict) -> None:
    """Record that a test is scored; a second time, or in another context than the frozen one, is refused.

    Who creates ``<status>.scored`` may score: of several at once, one.  Paths may be
    on any file system that Spark reaches; a session is needed.
    """
    path = str(status)
    if files.exists(f"{path}.scored"):
        raise GuardError("this test has been scored already")
    if files.exists(path):
        held = files.read_json(path)
        changed = [k for k, v in held.get("context", {}).items() if to_json(context.get(k)) != v]
        if changed:
            raise GuardError(f"the run differs from the frozen one in {changed}")
    if not files.create_json(f"{path}.scored", {"scored": True, "context": context}):
        raise GuardError("this test has been scored already")


def freeze_context(status: str | Path, context: dict) -> None:
    """Record the context in which a test may be scored, once."""
    if files.exists(f"{status}.scored") or not files.create_json(str(status), {"context": context}):
        raise GuardError("a context is frozen already")


def digest_of(df: DataFrame) -> str:
    """A digest of the rows of a table, whatever their order: a 128-bit sum of their hashes, and their number."""
    wide = lambda salt: F.sum(F.xxhash64(*df.columns, F.lit(salt)).cast("decimal(38,0)"))
    row = df.agg(F.count("*").alias("n"), wide(1).alias("a"), wide(2).alias("b")).first()
    return hashlib.sha256(f"{sorted(df.columns)}{row['n']} {row['a']} {row['b']}".encode()).hexdigest()


def cached_scores(spark: SparkSession, path: str, model_digest: str, keys: DataFrame, score: Callable[[], DataFrame], name: str = "p", most: float = 1e-6, check: bool = False) -> DataFrame:
    """Scores stored beside ``path``, made by ``score`` the first time; ``<path>.json`` is their receipt.

    Later runs read them if the model and the keys are those of the receipt, and
    refuse otherwise; ``check`` scores again and refuses a difference above ``most``.
    """
    receipt, ids = f"{path}.json", digest_of(keys)
    if not files.exists(receipt):
        own = f"{path}-{uuid.uuid4().hex}"  # of several runs at once each writes its own; the receipt names one
        score().write.parquet(own)
        files.create_json(receipt, {"model": model_digest, "keys": ids, "scores": digest_of(spark.read.parquet(own)), "path": own})
    held = files.read_json(receipt)
    stored = spark.read.parquet(held["path"])
    if (held["model"], held["keys"], held["scores"]) != (model_digest, ids, digest_of(stored)):
        raise GuardError("the stored scores are of another model, of other rows, or changed")
    if check:
        again = score().select(*keys.columns, F.col(name).alias("_p"))
        row = stored.join(again, keys.columns).agg(F.count("*").alias("n"), F.max(F.abs(F.col(name) - F.col("_p"))).alias("d")).first()
        if row["n"] != stored.count() or (row["d"] or 0.0) > most:
            raise GuardError(f"stored scores differ from new ones by {row['d']}")
    return stored


def check_manifest(manifest: dict, fields: int, context_fields: int, tracks: int, roles: dict[str, int]) -> dict:
    """A baseline's manifest: input sizes, roles, a selection without the test, and a complete training."""
    faults = []
    inputs, training = manifest.get("inputs", {}), manifest.get("training", {})
    for name, want in (("fields", fields), ("context_fields", context_fields), ("tracks", tracks)):
        if inputs.get(name) != want:
            faults.append(f"{name} is {inputs.get(name)}, not {want}")
    if manifest.get("roles") != roles:
        faults.append("roles have other sizes")
    if manifest.get("test_used_for_selection") is not False:
        faults.append("a selection without the test is not recorded")
    done, asked = training.get("completed", 0), training.get("requested", 0)
    if done < 1 or done > asked or (training.get("whole") and done != asked):
        faults.append("the training is not complete")
    if faults:
        raise GuardError("; ".join(faults))
    return manifest


def environment() -> dict:
    """Versions of what the engine needs, and whether each can be imported; h5py is needed for HDF5 alone."""
    import importlib
    import sys

    out = {"python": sys.version.split()[0]}
    for name in ("pyspark", "numpy", "pandas", "pyarrow", "h5py"):
        try:
            out[name] = getattr(importlib.import_module(name), "__version__", "unknown")
        except ImportError:
            out[name] = None
    return out
