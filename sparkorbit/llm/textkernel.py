"""Vectorized words and word shingles over the UTF-8 bytes of whole Arrow batches.

Words are runs of bytes other than space and 0x09-0x0D; A-Z are lower-cased.
Every word gets a 64-bit value from a prefix polynomial over its bytes, every
run of five words a 64-bit value mixed from those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WIDTH = 5
#: Bytes of text handled at once; a longer text is handled alone.
CHUNK = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240607))
_odd = lambda n: _rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_odd(1)[0])
_UNBASE = pow(_BASE, -1, 1 << 64)
_MUL = _odd(WIDTH)
_SALT = _odd(WIDTH + 1)
_byte = _odd(256)
_byte[65:91] = _byte[97:123]
_VALUE = _byte
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, CHUNK + 1), base, np.uint64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if n <= 4 * CHUNK:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets into them; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64, len(col) + 1, col.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of all words."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    solid = ~_SPACE[data]
    first = np.empty(n, bool)
    first[0] = True
    np.logical_not(solid[:-1], out=first[1:])
    edges = offs[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    first[edges] = True
    last = np.empty(n, bool)
    last[-1] = True
    np.logical_not(solid[1:], out=last[:-1])
    last[edges - 1] = True
    starts = np.flatnonzero(solid & first)
    ends = np.flatnonzero(solid & last) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def word_values(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit value for each word, the same wherever it stands."""
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * _powers_of(_BASE, len(data)), out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * _powers_of(_UNBASE, len(data) + 1)[starts])


def shingles(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of all five-word shingles with their bounds by row (n + 1); fewer words make one."""
    starts, ends, row = words(data, offs)
    value = word_values(data, starts, ends)
    n = len(offs) - 1
    per = np.bincount(row, minlength=n)
    if len(value) >= WIDTH:
        whole = row[: len(row) - WIDTH + 1] == row[WIDTH - 1 :]
        out = np.zeros(len(whole), np.uint64)
        for j in range(WIDTH):
            out += value[j : len(value) - WIDTH + 1 + j] * _MUL[j]
        out, at = mix(out[whole] + _SALT[0]), row[: len(whole)][whole]
    else:
        out, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    few = np.flatnonzero((per > 0) & (per < WIDTH))
    if len(few):
        begin = np.concatenate(([0], np.cumsum(per)))
        short = np.zeros(len(few), np.uint64)
        for j in range(WIDTH - 1):
            has = per[few] > j
            short[has] += value[begin[few[has]] + j] * _MUL[j]
        short = mix(short + _SALT[per[few]])
        order = np.argsort(np.concatenate((at, few)), kind="stable")
        out, at = np.concatenate((out, short))[order], np.concatenate((at, few))[order]
    return out, np.concatenate(([0], np.cumsum(np.bincount(at, minlength=n))))
