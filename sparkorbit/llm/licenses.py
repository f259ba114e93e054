"""License scans by template markup.

A template of mandatory words, optional regions and replaceable regions is compiled
into a token automaton; a stretch of words is accepted if its mandatory wording stands
there exactly and in order.  Every template begins with two mandatory words: places of
those pairs are found in whole Arrow batches, and the automata run from there.

Words are runs of letters a-z, digits and non-ASCII characters after A-Z are lower-cased.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkernel as K
from .license_texts import PHRASES, TEMPLATES
from .shared import fresh, importable

_PART = re.compile(r"\[\[|\]\]|\{\{(\d+)-(\d+)\}\}|([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SOLID = np.zeros(256, bool)
_SOLID[48:58] = _SOLID[97:123] = _SOLID[128:] = True


def _lower(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


@dataclass(frozen=True)
class Automaton:
    """Bit i of a state set is 'before item i'; an item takes one word, ``any`` word or stands for a jump."""

    label: str
    words: dict[bytes, int]  # the items that a word moves on
    any: int  # the items that every word moves on
    jumps: tuple[tuple[int, int], ...]  # ascending (from, to): items that may be passed over
    accept: int
    mandatory: int  # number of mandatory words
    base: bool

    def close(self, states: int) -> int:
        for a, b in self.jumps:
            if states >> a & 1:
                states |= 1 << b
        return states

    def step(self, states: int, word: bytes) -> int:
        moved = states & (self.any | self.words.get(word, 0))
        return self.close(moved << 1) if moved else 0


def parse(markup: str) -> list:
    """Items of a template: a word, (least, most) words of any kind, or the list of an optional region."""
    stack: list[list] = [[]]
    for m in _PART.finditer(_lower(markup)):
        if m[0] == "[[":
            stack.append([])
        elif m[0] == "]]":
            region = stack.pop()
            if not stack:
                raise ValueError("an optional region ends that did not begin")
            if region:
                stack[-1].append(region)
        elif m[3]:
            stack[-1].append(m[3])
        else:
            stack[-1].append((int(m[1]), int(m[2])))
    if len(stack) > 1:
        raise ValueError("an optional region does not end")
    return stack[0]


def build(label: str, markup: str, base: bool = False) -> Automaton:
    """The automaton of a template, which begins with two mandatory words."""
    items = parse(markup)
    if len(items) < 2 or not all(isinstance(x, str) for x in items[:2]):
        raise ValueError(f"{label}: a template begins with two mandatory words")
    words: dict[bytes, int] = {}
    jumps: list[tuple[int, int]] = []
    place, free, mandatory = 0, 0, 0

    def lay(part: list, optional: bool) -> None:
        nonlocal place, free, mandatory
        for x in part:
            if isinstance(x, str):
                words[x.encode()] = words.get(x.encode(), 0) | 1 << place
                place, mandatory = place + 1, mandatory + (not optional)
            elif isinstance(x, tuple):
                least, most = x
                for k in range(most):
                    if k >= least:
                        jumps.append((place, place - k + most))
                    free |= 1 << place
                    place += 1
            else:
                begin = place
                lay(x, True)
                jumps.append((begin, place))

    lay(items, False)
    return Automaton(label, words, free, tuple(sorted(jumps)), 1 << place, mandatory, base)


@lru_cache(maxsize=8)
def automata(templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: tuple[tuple[str, str], ...] = PHRASES) -> tuple[Automaton, ...]:
    return (*(build(label, text, True) for text, label in phrases), *(build(label, text) for label, text in templates))


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words of lower-cased bytes."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    solid = _SOLID[data]
    begins = np.empty(len(data), bool)
    begins[0] = True
    np.logical_not(solid[:-1], out=begins[1:])
    cuts = offs[1:-1]
    cuts = cuts[cuts < len(data)]
    begins[cuts] = True
    ends = np.empty(len(data), bool)
    ends[-1] = True
    np.logical_not(solid[1:], out=ends[:-1])
    ends[cuts[cuts > 0] - 1] = True
    first = np.flatnonzero(solid & begins)
    return first, np.flatnonzero(solid & ends) + 1, np.searchsorted(offs, first, "right") - 1


def _heads(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first eight bytes of each word, zero where it is shorter."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    size, out = ends - starts, np.zeros(len(starts), np.uint64)
    for k in range(8):
        out |= np.where(size > k, padded[starts + k], 0).astype(np.uint64) << np.uint64(8 * k)
    return out


def _head(word: bytes) -> int:
    return int.from_bytes(word[:8].ljust(8, b"\0"), "little")


def matches(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, machines: tuple[Automaton, ...]) -> Iterator[tuple[int, Automaton, int]]:
    """(first word, automaton, word after the last) of every place where one accepts, each as long as it can be."""
    by_pair: dict[tuple[int, int], list[tuple[Automaton, tuple[bytes, bytes]]]] = {}
    for m in machines:
        pair = tuple(next(w for w, held in m.words.items() if held >> k & 1) for k in range(2))
        by_pair.setdefault((_head(pair[0]), _head(pair[1])), []).append((m, pair))
    heads = _heads(data, starts, ends)
    at = np.flatnonzero(np.isin(heads[:-1], np.array([a for a, _ in by_pair], np.uint64)) & np.isin(heads[1:], np.array([b for _, b in by_pair], np.uint64)) & (rows[:-1] == rows[1:]))
    raw = data.tobytes() if len(at) else b""
    word = lambda i: raw[starts[i] : ends[i]]
    last = np.searchsorted(rows, rows[at], "right").tolist()
    for i, after in zip(at.tolist(), last, strict=True):
        for m, pair in by_pair.get((int(heads[i]), int(heads[i + 1])), ()):
            if (word(i), word(i + 1)) != pair:
                continue
            states, j, end = m.close(1), i, 0
            while states and j < after:
                states = m.step(states, word(j))
                j += 1
                if states & m.accept:
                    end = j
            if end:
                yield i, m, end


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: tuple[tuple[str, str], ...] = PHRASES, text_col: str = "text", prefix: str = "license_") -> DataFrame:
    """The columns of ``docs`` with ``license_words``, ``license_spans`` and ``license_score``.

    Spans are (label, base, start, end) in words from 0, the end exclusive, sorted by start
    and label; every place where a template is accepted counts, and a place takes the
    longest stretch that it accepts.  ``base`` marks the phrases.  The score is m / (m + 1),
    m the most mandatory words of an accepted template; 0 if there is none.  Null and empty
    texts have no words.  A place costs at most as many steps as its template may take
    words, so a text of any length takes time in proportion.  Columns of ``docs`` whose
    names clash stay, and the new ones get underscores before theirs.
    """
    importable(docs.sparkSession)
    names = fresh(docs, *(prefix + c for c in ("words", "spans", "score")))
    at = docs.columns.index(text_col)
    span = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("end", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = automata(templates, phrases)
        for whole in batches:
            _, cuts = K.utf8(whole.column(at))
            for lo, hi in K.chunks(cuts):
                batch = whole.slice(lo, hi - lo)
                data, offs = K.utf8(batch.column(at))
                data = _LOWER[data]
                starts, ends, rows = tokens(data, offs)
                count = np.bincount(rows, minlength=len(batch))
                before = np.cumsum(count) - count
                spans: list[list[dict]] = [[] for _ in range(len(batch))]
                most = np.zeros(len(batch))
                for i, m, end in matches(data, starts, ends, rows, machines):
                    r = int(rows[i])
                    spans[r].append({"label": m.label, "base": m.base, "start": i - int(before[r]), "end": end - int(before[r])})
                    most[r] = max(most[r], m.mandatory)
                for s in spans:
                    s.sort(key=lambda x: (x["start"], x["label"]))
                made = [pa.array(count.astype(np.int64)), pa.array(spans, pa.list_(span)), pa.array(most / (most + 1))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*(f"c{i}" for i in range(len(batch.columns))), *names])

    kinds = ["long", "array<struct<label:string,base:boolean,start:long,end:long>>", "double"]
    held = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    out = docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).mapInArrow(scan, ", ".join(filter(None, [held, *(f"{n} {k}" for n, k in zip(names, kinds, strict=True))])))
    return out.toDF(*docs.columns, *names)
