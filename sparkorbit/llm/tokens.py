"""Token counts by field and line, and training-order materialisation of token ids.

Both encode whole documents with a public byte-level vocabulary, given as a file
of ranks; a worker loads it once.  The path has to lead to the file on every
worker: put it in their image or on a mount that they share.
"""

from __future__ import annotations

import base64
import functools
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as K
from .shared import checked_broadcast, materialize

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_OF_TEXT = 50256


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> tuple["tiktoken.Encoding", np.ndarray]:  # noqa: F821, UP037
    """The encoder of a rank file and the UTF-8 length of each of its tokens."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        size[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), size


# -- token counts -----------------------------------------------------------

RULES = ("majority", "first", "split")


def token_shares(sizes: np.ndarray, ends: np.ndarray, rule: str = "majority") -> tuple[np.ndarray, int]:
    """Tokens of each section, and the number of tokens that cross a boundary.

    ``sizes`` are the byte lengths of a document's tokens, ``ends`` the byte offsets
    at which its sections end; the sections cover the document.  The intervals of
    the tokens are joined with those of the sections: a token within one section
    counts there.  One that crosses counts for the section with most of its bytes,
    the earliest of several (``majority``), for the one it begins in (``first``), or
    for each by its share of the bytes (``split``).
    """
    stop = np.cumsum(sizes)
    start = stop - sizes
    a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop - 1, "right")
    crossing = np.flatnonzero(a != b)
    out = np.bincount(a, minlength=len(ends)).astype(np.float64)
    if rule != "first":
        for t in crossing:
            edges = np.concatenate(([start[t]], ends[a[t] : b[t]], [stop[t]]))
            part = np.diff(edges)
            out[a[t]] -= 1
            if rule == "majority":
                out[a[t] + int(np.argmax(part))] += 1
            else:
                out[a[t] : b[t] + 1] += part / sizes[t]
    return out, len(crossing)


def count_tokens(docs: DataFrame, fields: tuple[str, ...] = ("source", "lang", "text"), body: str = "text", id_col: str = "doc_id", vocabulary: str = VOCABULARY, rule: str = "majority") -> DataFrame:
    """(id, n_tokens, n_crossing, <field>_tokens, line_tokens): tokens of every row of ``docs``.

    A document is its fields in order with a space between two; it is encoded once,
    as a whole.  The sections are the fields, the ``body`` cut into its lines; a space
    or line break belongs to the section that it ends.  ``line_tokens`` are those of
    the body's lines.  Null fields are empty; an empty table gives an empty result.  Counts are whole numbers unless ``rule`` is split.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    number = "double" if rule == "split" else "long"
    kind = pa.float64() if rule == "split" else pa.int64()

    def in_chunks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of at most ``K.CHUNK`` bytes of text, or of one row: lists of lines are held for those alone."""
        for batch in it:
            offs = sum((K.utf8(batch.column(k + 1))[1] for k in range(len(fields))), np.zeros(batch.num_rows + 1, np.int64))
            for i, j in K.chunks(offs):
                yield batch.slice(i, j - i)

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, size = encoder(vocabulary)
        for batch in in_chunks(it):
            texts = [[v or "" for v in batch.column(k + 1).to_pylist()] for k in range(len(fields))]
            n, crossed, lines = [], [], []
            sums: list[list] = [[] for _ in fields]
            for row in zip(*texts, strict=True):
                parts = [(k, p) for k, v in enumerate(row) for p in (v.split("\n") if fields[k] == body else (v,))]
                owner = [k for k, _ in parts]
                ends = np.cumsum([len(p.encode()) + 1 for _, p in parts])
                ends[-1] -= 1  # nothing follows the last one
                ids = enc.encode_to_numpy(" ".join(row), disallowed_special=())
                share, c = token_shares(size[ids], ends, rule)
                owner = np.array(owner)
                n.append(len(ids))
                crossed.append(c)
                for k in range(len(fields)):
                    sums[k].append(share[owner == k].sum())
                lines.append(share[owner == fields.index(body)] if body in fields else [])
            cast = (lambda v: v) if rule == "split" else (lambda v: np.rint(v).astype(np.int64))
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(crossed, pa.int64()), *(pa.array(cast(np.array(s, np.float64)), kind) for s in sums)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([cast(np.asarray(v, np.float64)) for v in lines], pa.list_(kind))], names)

    names = [id_col, "n_tokens", "n_crossing", *(f"{f}_tokens" for f in fields), "line_tokens"]
    key = docs.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"`{id_col}` {key}", "n_tokens long", "n_crossing long", *(f"`{f}_tokens` {number}" for f in fields), f"line_tokens array<{number}>"])
    picked = docs.select(F.col(id_col).alias("key"), *(F.col(f).cast("string").alias(f"f{k}") for k, f in enumerate(fields)))
    return picked.mapInArrow(counted, schema)


# -- training order ---------------------------------------------------------

LENGTH = 512
SHARD_BYTES = 64 << 20
LEAST_SHARDS = 64
#: Equal rows that are encoded at once.
COPIES = 16
_ROUNDS = 6


def feistel(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """The keyed permutation of 0 .. size - 1: a balanced Feistel network, cycle-walked into the range."""
    half = max(1, (max(1, size - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = K.mix(np.arange(1, _ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(key))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (K.mix(right ^ k) & mask)
        return (left << shift) | right

    out = once(np.asarray(index, np.uint64))
    while (outside := out >= np.uint64(size)).any():
        out[outside] = once(out[outside])
    return out


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if urlparse(uri).scheme else (fs.LocalFileSystem(), uri)


def record_codec() -> pa.Codec:
    """How records are packed on their way to the shards: a third of zlib's time for nearly its size."""
    return pa.Codec("zstd", compression_level=1)


def shard_name(shard: int) -> str:
    return f"tokens-{shard:07d}.bin"


def write_training_order(docs: DataFrame, out_dir: str, key: int = 1, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end: int = END_OF_TEXT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write all token sequences in training order below ``out_dir``; return their manifest.

    A text, encoded whole and closed by ``end``, is cut into sequences of ``length``
    tokens, the last one padded with ``end``; null and empty texts have none.
    Sequence k of a document has the index number * (most sequences a text can have) + k;
    the keyed permutation of that index range puts the sequences in order, and the slot
    is the place in it, from 0 without gaps.  The number is id - smallest id if ids are
    single and none is null; else a hash of the id, the text and the copy's number among
    equal rows, so copies and null ids get places of their own.
    Ranges of the permuted index are the shards: files of consecutive slots with
    records of 2 * ``length`` bytes (little-endian), so slot s stands at byte
    (s - first slot) * 2 * length of its shard.  Equal ids are ordered by content.

    ``out_dir``/index has the first slot of every shard and its number of records, so
    a reader needs no manifest.  An empty table gives no shards.

    Manifest: slot, shard, byte_offset, the id, seq, n_tokens (without padding) and
    tokens_crc32 of the record.  Files appear under their names only when whole, and
    a task that runs again writes the same bytes.
    """
    whole = docs.schema[id_col].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    number = F.col(id_col).cast("long") if whole else F.shiftrightunsigned(F.xxhash64(id_col), 24)
    picked = docs.select(F.col(id_col).alias("key"), F.when(F.col(id_col).isNotNull(), number).alias("number"), F.col(text_col).alias("text")).where("text <> ''")
    size = F.octet_length("text")
    slim = materialize(picked.select("number", F.xxhash64("text").alias("x"), size.alias("size")), "slim")
    stats = slim.agg(F.min("number").alias("low"), F.max("number").alias("high"), F.max("size").alias("most"), F.sum("size").alias("all")).first()
    low, high = stats["low"] or 0, stats["high"] or 0
    each = max(1, ((stats["most"] or 0) + 1 + length - 1) // length)  # a token has a byte or more
    equal = materialize(slim.groupBy("number", "x").agg(F.count("*").alias("n")), "equal")
    copied = materialize(equal.where("n > 1").select("number", "x"), "copied")
    single = not equal.groupBy("number").agg(F.sum("n").alias("n")).where("n > 1 or number is null").limit(1).count()
    bits = 61 - each.bit_length()
    if not single or (high - low + 1) * each >= 1 << 62:
        single, low, high = False, 0, (1 << bits) - 1
    size_all = (high - low + 1) * each
    # Up to COPIES equal rows are encoded once.
    picked = picked.withColumn("copy", F.lit(0).cast("long")).withColumn("times", F.lit(1).cast("long"))
    if copied.limit(1).count():
        mine = checked_broadcast(copied.select(F.col("number").alias("its_number"), F.col("x").alias("its_x")))
        same = F.col("number").eqNullSafe(F.col("its_number")) & (F.xxhash64("text") == F.col("its_x"))
        some = picked.join(mine, same, "left_semi").groupBy("key", "number", "text").agg(F.count("*").alias("n"))
        some = some.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))))
        some = some.withColumn("times", F.least(F.lit(COPIES).cast("long"), F.col("n") - F.col("copy")))
        if equal.where(F.col("n") > COPIES).limit(1).count():
            some = some.repartition("number", "copy")
        picked = picked.join(mine, same, "left_anti").union(some.select(picked.columns))
    if not single:
        picked = picked.withColumn("number", F.xxhash64("number", "text"))
    shards = max(LEAST_SHARDS, -(-(stats["all"] or 0) // shard_bytes))
    stride = 2 * length

    def encoded(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, _ = encoder(vocabulary)
        codec = record_codec()
        for batch in it:
            numbers = batch.column(1).to_numpy()
            firsts, copies = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            data, offs = K.utf8(batch.column(2))
            for i, j in K.chunks(offs):
                row, seq, n, crc, packed, copy = [], [], [], [], [], []
                for r in range(i, j):
                    ids = enc.encode_to_numpy(bytes(data[offs[r] : offs[r + 1]]).decode(), disallowed_special=())
                    full = np.full(-(-(len(ids) + 1) // length) * length, end, "<u2")
                    full[: len(ids)] = ids
                    for k in range(0, len(full), length):
                        record = full[k : k + length].tobytes()
                        size, times = min(length, len(ids) + 1 - k), int(copies[r])
                        row += [r] * times
                        seq += [k // length] * times
                        n += [size] * times
                        crc += [zlib.crc32(record)] * times
                        packed += [codec.compress(record[: 2 * size], asbytes=True)] * times
                        copy += range(int(firsts[r]), int(firsts[r]) + times)
                if single:
                    number = (numbers[row] - low).astype(np.uint64)
                else:
                    number = K.mix(numbers[row].view(np.uint64) ^ K.mix(np.array(copy, np.uint64))) >> np.uint64(64 - bits)
                index = number * np.uint64(each) + np.array(seq, np.uint64)
                place = feistel(index, size_all, key)
                width = -(-size_all // shards)
                cols = [pa.array((place // np.uint64(width)).astype(np.int32)), pa.array(place.astype(np.int64)), batch.column(0).take(pa.array(row)), pa.array(seq, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["shard", "place", "key", "seq", "n_tokens", "tokens_crc32", "packed"])

    def written(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(out_dir)
        store.create_dir(root, recursive=True)
        codec = record_codec()
        shard, out, part, at = None, None, "", 0

        def close() -> None:
            if out is not None:
                out.close()
                store.move(part, f"{root}/{shard_name(shard)}")

        for batch in it:
            inner = []
            for s, n, packed in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist(), batch.column(6), strict=True):
                if s != shard:
                    close()
                    shard, part, at = s, f"{root}/.{shard_name(s)}.{uuid.uuid4().hex}", 0
                    out = store.open_output_stream(part)
                record = np.full(length, end, "<u2")
                record[:n] = np.frombuffer(codec.decompress(packed.as_py(), 2 * n, asbytes=True), "<u2")
                out.write(record.tobytes())
                inner.append(at)
                at += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(inner, pa.int64()), *(batch.column(k) for k in (2, 3, 4, 5))], ["shard", "inner", "key", "seq", "n_tokens", "tokens_crc32"])
        close()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = picked.mapInArrow(encoded, f"shard int, place long, key {kind}, seq long, n_tokens long, tokens_crc32 long, packed binary")
    rows = rows.repartitionById(int(shards), F.col("shard")).sortWithinPartitions("shard", "place", "tokens_crc32", "packed")
    rows = rows.mapInArrow(written, f"shard int, inner long, key {kind}, seq long, n_tokens long, tokens_crc32 long")
    rows = materialize(rows, "manifest")
    counts = rows.groupBy("shard").agg(F.count("*").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), "n")
    firsts.coalesce(1).write.mode("overwrite").parquet(f"{out_dir}/index")
    firsts = docs.sparkSession.read.schema(firsts.schema).parquet(f"{out_dir}/index")
    out = rows.join(F.broadcast(firsts), "shard")  # a row for each shard file
    return out.select((F.col("first") + F.col("inner")).alias("slot"), "shard", (F.col("inner") * stride).alias("byte_offset"), F.col("key").alias(id_col), "seq", "n_tokens", "tokens_crc32")


def read_slots(out_dir: str, start: int, count: int, length: int = LENGTH) -> Iterator[np.ndarray]:
    """The records of ``count`` slots from ``start`` on, in order: a few sequential reads, found by the shards' index."""
    store, root = _open(out_dir)
    index = pq.read_table(f"{root}/index", filesystem=store).sort_by("first")
    firsts, sizes, shards = (index.column(c).to_numpy() for c in ("first", "n", "shard"))
    stop = min(start + count, int(firsts[-1] + sizes[-1]) if len(firsts) else 0)
    k = int(np.searchsorted(firsts, start, "right")) - 1
    while start < stop:
        with store.open_input_file(f"{root}/{shard_name(int(shards[k]))}") as source:
            source.seek(int(start - firsts[k]) * 2 * length)
            end = min(stop, int(firsts[k] + sizes[k]))
            for _ in range(start, end):
                yield np.frombuffer(source.read(2 * length), "<u2")
        start, k = end, k + 1
