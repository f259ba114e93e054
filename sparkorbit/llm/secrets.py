"""Secret scans over a trigram inverted index.

Each rule's regex is turned into a Boolean query over the trigrams that every
match must contain.  Postings of those trigrams are intersected to candidate
documents, which the regex then verifies.  Rules without mandatory trigrams scan
every text.  Offsets are code points; built from DataFrame functions alone.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import checked_broadcast, materialize, text_of


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


#: In the order in which spans of equal start are listed.  Runs shorter than 20 or 24
#: characters fail, so the bounds stand in the patterns of ``access`` and ``hex``.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
RULES = (
    *BASE,
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{20,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
_MOST = 64


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Clauses of which one holds in every match: sets of lower-case trigrams; empty if none is mandatory."""
    clauses = {frozenset()}
    for words in _runs(parser.parse(pattern)):
        grams = {frozenset(w[i : i + 3] for i in range(len(w) - 2)) for w in words}
        both = {a | b for a in clauses for b in grams}
        clauses = {a for a in both if not any(b < a for b in both)} if len(both) <= _MOST else clauses
    return [] if frozenset() in clauses else sorted(clauses, key=sorted)


def _runs(tree) -> list[set[str]]:
    """Sets of strings that follow in every match, with anything between; one string of each set is there."""
    done, now = [], {""}

    def cross(more: set[str]) -> None:
        nonlocal now
        if len(now) * len(more) > _MOST:
            flush()
        now = {a + b for a in now for b in more}

    def flush() -> None:
        nonlocal now
        done.append(now)
        now = {""}

    for op, arg in tree:
        if op is sre.LITERAL:
            cross({chr(arg).lower()})
        elif op is sre.IN and all(k is sre.LITERAL for k, _ in arg) and len(arg) <= 8:
            cross({chr(v).lower() for _, v in arg})
        elif op is sre.SUBPATTERN:
            part = _runs(arg[-1])
            cross(part[0])
            for p in part[1:]:
                flush()
                now = p
        elif op is sre.BRANCH:
            parts = [_runs(b) for b in arg[1]]
            if all(len(p) == 1 for p in parts):
                cross(set().union(*(p[0] for p in parts)))
            else:  # a branch with a gap: only its first run counts
                flush()
                done.append(set().union(*(p[0] for p in parts)))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, sub = arg
            part = _runs(sub)
            if (low, high) == (0, 1) and len(part) == 1:
                cross(part[0] | {""})
            else:
                if low:
                    cross(part[0])
                flush()
        elif op is not sre.AT:
            flush()
    return [*done, now]


def any_of(grams: list[str]) -> str:
    """A regex that finds, in one pass, every place where one of the trigrams stands, overlaps included."""
    tails: dict[str, list[str]] = {}
    for g in grams:
        tails.setdefault(g[0], []).append(g[1:])
    quoted = lambda s: re.sub(r"([^\w])", r"\\\1", s)
    return "(?=(" + "|".join(f"{quoted(a)}(?:{'|'.join(map(quoted, rest))})" for a, rest in tails.items()) + "))" if grams else ""


def candidates(docs: DataFrame, rules: tuple[Rule, ...], id_col: str, text_col: str) -> tuple[DataFrame, list[int]]:
    """(cand_id, mask) with a bit for each rule whose query the id's postings satisfy; rules that scan fully."""
    queries = [trigram_query(r.pattern) for r in rules]
    full = [k for k, q in enumerate(queries) if not q]
    grams = sorted({g for q in queries for c in q for g in c})
    clause_rows = [(k, c, g, 1 << b, (1 << len(clause)) - 1) for k, q in enumerate(queries) for c, clause in enumerate(q) for b, g in enumerate(sorted(clause))]
    spark = docs.sparkSession
    clauses = spark.createDataFrame(clause_rows, "rule int, clause int, gram string, bit long, whole long")
    held = F.array_distinct(F.regexp_extract_all(F.lower(text_of(text_col)), F.lit(any_of(grams)), F.lit(1))) if grams else F.array().cast("array<string>")
    postings = docs.select(F.explode(held).alias("gram"), F.col(id_col).alias("cand_id"))
    met = postings.join(F.broadcast(clauses), "gram")  # a row for each trigram of the rules
    met = met.groupBy("cand_id", "rule", "clause").agg(F.bit_or("bit").alias("bits"), F.first("whole").alias("whole")).where("bits = whole")
    return materialize(met.groupBy("cand_id").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("mask")), "candidates"), full


#: Matches that one fold takes; their spans are copied at each of its steps.
_FOLD = 64


def _spans(text: Column, rule: Rule, k: int) -> Column:
    """Spans of the matches that count: array of (start, kind, end).

    Offsets are running sums of the lengths of gaps and matches: within blocks of
    ``_FOLD`` matches first, then over the blocks.
    """
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    rows = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), whole.alias("all"), F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("kept"))
    rows = F.transform(rows, lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["all"]).alias("all"), (F.length(x["kept"]) >= rule.least).alias("kept")))
    kind = "array<struct<start:int,kind:int,end:int>>"
    none = F.array().cast(kind)

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + x["gap"]
        end = start + x["all"]
        span = F.array(F.struct(start.alias("start"), F.lit(k).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["kept"], F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    def blocks(r: Column) -> Column:
        n = F.size(r) - 1  # the last gap has no match after it
        cut = lambda b: F.transform(F.sequence(b * _FOLD, F.least(n, (b + 1) * _FOLD) - 1), lambda i: F.get(r, i))
        each = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _FOLD).cast("int")), lambda b: F.aggregate(cut(b), F.struct(F.lit(0).alias("at"), none.alias("spans")), step))
        return F.when(n > 0, each).otherwise(F.array().cast(f"array<struct<at:int,spans:{kind}>>"))

    def joined_up(each: Column) -> Column:
        ends = F.aggregate(each, F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x["at"])))
        moved = lambda e: F.transform(each, lambda x, i: F.transform(x["spans"], lambda s: F.struct((s["start"] + F.get(e, i)).alias("start"), s["kind"].alias("kind"), (s["end"] + F.get(e, i)).alias("end"))))
        return F.flatten(F.transform(F.array(ends), moved)[0])

    # The lambdas bind the lengths and the blocks, which are then made only once.
    return F.transform(F.transform(F.array(rows), blocks), joined_up)[0]


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` and ``secret_spans``: array of (start, kind, end), kind an index into ``rules``.

    Spans of one kind are leftmost and do not overlap; those of all kinds are sorted
    by start, then kind.  Null and empty texts have none.  Rows of a repeated id are
    candidates together and verified one by one.
    """
    found, full = candidates(docs, rules, id_col, text_col)
    docs = docs.drop("secret_spans")
    packed = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("own_id"), text_of(text_col).alias("whole_text"))
    packed = packed.join(checked_broadcast(found), packed["own_id"].eqNullSafe(found["cand_id"]), "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    parts = []
    for k, rule in enumerate(rules):
        due = F.col("whole_text").rlike(rule.pattern) if k in full else F.coalesce(F.col("mask"), F.lit(0)).bitwiseAND(F.lit(1 << k)) != 0
        parts.append(F.when(due, _spans(F.col("whole_text"), rule, k)).otherwise(none))
    return packed.select("row.*", F.array_sort(F.concat(*parts)).alias("secret_spans"))


def joined(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of the spans, comma-joined."""
    names = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
