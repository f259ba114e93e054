import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkorbit.llm import queries, shared, topk
from sparkorbit.llm import tokens as T
from sparkorbit.llm.line_dedup import Lines, dedup_lines, segment_keys, within
from sparkorbit.llm.shared import scratch
from sparkorbit.llm.topk import search_shard, top_products


# -- tokens -------------------------------------------------------------------


def test_shares_by_rule():
    sizes, ends = np.array([3, 4, 2, 1]), np.array([4, 4, 9, 10])  # tokens at 0-3, 3-7, 7-9, 9-10
    assert T.token_shares(sizes, ends, "majority")[0].tolist() == [1, 0, 2, 1]
    assert T.token_shares(sizes, ends, "first")[0].tolist() == [2, 0, 1, 1]
    share, crossing = T.token_shares(sizes, ends, "split")
    assert share.tolist() == [1.25, 0, 1.75, 1] and crossing == 1
    assert T.token_shares(np.array([4]), np.array([2, 4]))[0].tolist() == [1, 0]  # ties: the earlier one


def test_counts_match_the_encoder(spark, odd_docs, no_docs):
    enc, _ = T.encoder(T.VOCABULARY)
    rows = T.count_tokens(odd_docs).collect()
    texts = sorted(" ".join(r[c] or "" for c in ("source", "lang", "text")) for r in odd_docs.collect())
    assert sorted(r["n_tokens"] for r in rows) == sorted(len(enc.encode_ordinary(t)) for t in texts)
    for r in rows:
        assert r["n_tokens"] == r["source_tokens"] + r["lang_tokens"] + r["text_tokens"] and sum(r["line_tokens"]) == r["text_tokens"]
    split = T.count_tokens(odd_docs, rule="split").collect()
    assert all(abs(r["source_tokens"] + r["lang_tokens"] + r["text_tokens"] - r["n_tokens"]) < 1e-6 for r in split)
    assert T.count_tokens(no_docs).count() == 0
    with pytest.raises(ValueError):
        T.count_tokens(odd_docs, rule="none")


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 5000), st.integers(0, 1 << 62))
def test_feistel_is_a_permutation(n, key):
    assert np.array_equal(np.sort(T.feistel(np.arange(n), n, key)), np.arange(n))


def test_training_order_round_trip(spark, odd_docs, no_docs):
    enc, _ = T.encoder(T.VOCABULARY)
    out = scratch(spark, "order")
    manifest = T.write_training_order(odd_docs, out, length=64)
    rows = sorted(manifest.collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in rows] == list(range(len(rows)))
    records = list(T.read_slots(out, 0, len(rows) + 5, 64))
    whole = {}
    for r, x in zip(rows, records, strict=True):
        assert zlib.crc32(x.tobytes()) == r["tokens_crc32"] and (x[r["n_tokens"] :] == T.END_OF_TEXT).all()
        if r["doc_id"] not in (2, None):
            whole.setdefault(r["doc_id"], {})[r["seq"]] = x[: r["n_tokens"]].tolist()
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect() if r["text"]}
    for d, parts in whole.items():
        assert sum((parts[k] for k in range(len(parts))), []) == [*enc.encode_ordinary(texts[d]), T.END_OF_TEXT]
    assert set(whole) == {d for d in texts if d not in (2, None)}
    some = list(T.read_slots(out, 5, 3, 64))
    assert all(np.array_equal(a, b) for a, b in zip(some, records[5:8], strict=True))
    other = T.write_training_order(odd_docs.repartition(3), scratch(spark, "order"), length=64)
    key = lambda r: (r["slot"], r["doc_id"], r["seq"], r["tokens_crc32"])
    assert sorted(map(str, map(key, other.collect()))) == sorted(map(str, map(key, rows)))
    assert T.write_training_order(no_docs, scratch(spark, "order")).count() == 0


def test_slots_are_ranks_of_the_permuted_index(spark):
    enc, _ = T.encoder(T.VOCABULARY)
    rows = [(i * 3 + 5, " ".join(f"w{j}" for j in range(i * 7 % 90 + 1))) for i in range(50)]
    got = T.write_training_order(spark.createDataFrame(rows, "doc_id long, text string"), scratch(spark, "order"), key=9, length=32).collect()
    each = -(-(max(len(t.encode()) for _, t in rows) + 1) // 32)
    size = (max(d for d, _ in rows) - 5 + 1) * each
    places = []
    for d, t in rows:
        for k in range(-(-(len(enc.encode_ordinary(t)) + 1) // 32)):
            places.append((int(T.feistel(np.array([(d - 5) * each + k]), size, 9)[0]), d, k))
    assert [(d, k) for _, d, k in sorted(places)] == [(r["doc_id"], r["seq"]) for r in sorted(got, key=lambda r: r["slot"])]


def test_many_long_texts_in_one_batch(spark):
    """More text than one chunk takes: every row comes out once, with its own lines."""
    enc, _ = T.encoder(T.VOCABULARY)
    rows = [(i, "s", None, f"line {i} of some\n" * (20_000 + i) if i % 3 else "short") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").coalesce(1)
    got = {r["doc_id"]: r for r in T.count_tokens(df).collect()}
    assert sorted(got) == list(range(12))
    for i, _, _, text in rows:
        assert len(got[i]["line_tokens"]) == text.count("\n") + 1 and got[i]["text_tokens"] == sum(got[i]["line_tokens"])
        assert got[i]["n_tokens"] == len(enc.encode_ordinary(f"s  {text}"))


def test_shares_of_fields_and_lines_by_plain_spans(spark):
    enc, _ = T.encoder(T.VOCABULARY)
    rows = [(1, "en", "web", "one\ntwo three\n\nfour's  é𝒳"), (2, None, "b", "\n\nx"), (3, "de", None, None), (4, "", "", "a" * 50 + "\nb")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    for r in T.count_tokens(df).collect():
        row = next(x for x in rows if x[0] == r["doc_id"])
        fields = [row[2] or "", row[1] or "", row[3] or ""]
        owner = []  # of each byte: the section, its separator included
        for k, part in enumerate([fields[0], fields[1], *fields[2].split("\n")]):
            owner += [k] * (len(part.encode()) + 1)
        share, at = {}, 0
        for t in enc.encode_ordinary(" ".join(fields)):
            n = len(enc.decode_single_token_bytes(t))
            span = owner[at : at + n]
            best = max(sorted(set(span)), key=lambda k: (span.count(k), -k))
            share[best] = share.get(best, 0) + 1
            at += n
        lines = [share.get(2 + k, 0) for k in range(len(fields[2].split("\n")))]
        assert (r["source_tokens"], r["lang_tokens"], r["line_tokens"]) == (share.get(0, 0), share.get(1, 0), lines)


def test_copies_and_null_ids_have_places_of_their_own(spark):
    rows = [(i, f"copied text {i} " * 60) for i in range(20)] * 2 + [(None, f"text without id {i}") for i in range(40)] + [(99, "often")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(T.write_training_order(df, scratch(spark, "order"), length=64).collect(), key=lambda r: r["slot"])
    again = T.write_training_order(df.repartition(7), scratch(spark, "order"), length=64).collect()
    key = lambda r: (r["slot"], str(r["doc_id"]), r["seq"], r["tokens_crc32"])
    assert sorted(map(key, again)) == list(map(key, got))
    ids = [r["doc_id"] for r in got]
    assert ids.count(None) == 40 and ids.count(99) == 40 and all(ids.count(i) % 2 == 0 and i in ids for i in range(20))
    assert sum(key(a)[1:] == key(b)[1:] for a, b in zip(got, got[1:])) <= 20
    assert len({r["shard"] for r in got if r["doc_id"] is None}) > 3 and len({r["shard"] for r in got if r["doc_id"] == 99}) > 3


def test_shard_files_of_the_query_are_kept(spark, sf, monkeypatch):
    out = []
    monkeypatch.setattr(queries, "write_training_order", lambda docs, path, *a: out.append(path) or docs)
    queries.op9_training_order(spark, sf)
    assert out and out[0] not in {path for _, path in shared._written}


# -- lines --------------------------------------------------------------------


def edit(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


@settings(max_examples=150, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12), st.integers(1, 3))
def test_banded_distance(a, b, edits):
    x, y = (np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in (a, b))
    assert within([x], [y], edits)[0] == (edit(a, b) <= edits)


@settings(max_examples=150, deadline=None)
@given(st.text("abcé𝒳", min_size=8, max_size=14), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 13), st.sampled_from("abz")), max_size=2))
def test_near_lines_share_a_key(a, edits):
    b = list(a)
    for op, at, c in edits:
        at = min(at, len(b) - 1)
        b[at : at + (op > 0)] = [c] if op < 2 else []
    data = np.frombuffer((a + "\n" + "".join(b)).encode(), np.uint8)
    lines = Lines(data, np.array([0, len(data)]))
    key, at, probe = segment_keys(lines, 2, 6)
    sets = [({*key[(at == k) & (probe == 0)].tolist()}, {*key[at == k].tolist()}) for k in (0, 1)]
    assert sets[0][0] & sets[1][1] or sets[1][0] & sets[0][1]


def test_lines_match_brute_force(spark):
    rng = random.Random(4)
    stock = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(5, 60))).strip() or "x" for _ in range(25)]
    docs = []
    for d in range(40):
        lines = []
        for _ in range(rng.randint(0, 7)):
            s = list(rng.choice(stock))
            for _ in range(rng.choice((0, 0, 1, 2, 3))):
                s[rng.randrange(len(s))] = rng.choice("abcxyz")
            lines.append("  " * rng.randint(0, 1) + "".join(s) + "\t" * rng.randint(0, 1))
        docs.append((d * 3 % 41, "\n".join(lines)))
    docs += [(100, None), (101, "\n\n"), (102, " ")]
    got = {r["doc_id"]: r for r in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    occ = [(d, k, x.strip(" \t\r\x0b\x0c")) for d, t in docs for k, x in enumerate((t or "").split("\n"))]
    occ = [o for o in occ if o[2]]
    texts = sorted({o[2] for o in occ})
    parent = {t: t for t in texts}

    def find(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[:i]:
            if min(len(a), len(b)) >= 20 and abs(len(a) - len(b)) <= 2 and edit(a, b) <= 2:
                parent[find(a)] = find(b)
    size = {}
    for t in texts:
        size[find(t)] = size.get(find(t), 0) + 1
    first = {}
    for d, k, t in sorted(occ):
        first.setdefault(find(t), (d, k))
    for d, _ in docs:
        mine = [(k, t) for e, k, t in occ if e == d]
        assert got[d]["n_lines"] == len(mine)
        assert got[d]["kept_lines"] == sorted(k for k, t in mine if first[find(t)] == (d, k))
        assert got[d]["n_kept"] == len(got[d]["kept_lines"]) and got[d]["n_near"] == sum(size[find(t)] > 1 for _, t in mine)


def test_lines_that_share_a_beginning_match_brute_force(spark):
    """Buckets of one segment with many classes: pairs by rarest grams."""
    rng = random.Random(6)
    ends = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(8, 16))) for _ in range(120)]
    texts = []
    for e in ends:
        for _ in range(rng.randint(1, 3)):
            s = list(e)
            for _ in range(rng.choice((0, 1, 2, 3))):
                s[rng.randrange(len(s))] = rng.choice("xyz")
            texts.append("licensed under the same " + "".join(s))
    texts = sorted(set(texts))
    got = dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    parent = list(range(len(texts)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(texts):
        for j in range(i):
            if abs(len(a) - len(texts[j])) <= 2 and edit(a, texts[j]) <= 2:
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    assert {r["doc_id"] for r in got if r["n_kept"]} == {k for k in range(len(texts)) if find(k) == k}


def test_line_odd_rows(spark, odd_docs, no_docs):
    rows = dedup_lines(odd_docs).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted({str(r["doc_id"]) for r in odd_docs.collect()})
    assert dedup_lines(no_docs).count() == 0


# -- top k --------------------------------------------------------------------


def test_search_prunes_exactly():
    rng = np.random.default_rng(3)
    v = np.floor(256 * rng.normal(0, 0.2, (4000, 16))).astype(np.int64)
    v[:50] *= 4
    q = v[::400]
    ids = np.arange(4000)
    best = [[] for _ in q]
    for i in range(0, 4000, 500):
        search_shard(ids[i : i + 500], ids[i : i + 500], v[i : i + 500], q, ids[::400], best, 5)
    for k, found in enumerate(best):
        s = v @ q[k]
        want = sorted((-int(s[i]), i, i) for i in ids if i != ids[::400][k])[:5]
        assert found == want


def whole(x):
    return math.floor(Fraction(x) * 256)


def brute_top(rows, every=50, top=5):
    """Ranks by exact whole numbers; components that one side lacks are 0; scores end where longs do."""
    good = [(i, [whole(x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(good):
        if i % every == 0:
            s = sorted((-sum(a * b for a, b in zip(q, c)), j) for m, (j, c) in enumerate(good) if m != n)[:top]
            out += [(i, k + 1, j, max(-(1 << 63), min((1 << 63) - 1, -x))) for k, (x, j) in enumerate(s)]
    return sorted(out)


def test_top_products(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 4]) for i in range(120)]
    rows += [(None, rows[0][1]), (500, None), (550, []), (600, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (650, [float("nan")] + [0.0] * 5), (700, [float("inf")] + [0.0] * 5), (50, rows[50][1]), (7, rows[7][1]), (800, [1.0, 2.0]), (801, [0.5] * 300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as score", "2 as query_id", "3 as part", "4 as ask", "5 as blob")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in top_products(df).collect())
    assert got == brute_top(rows)
    assert top_products(df.limit(0)).count() == 0


def test_vectors_of_any_size_are_ranked_exactly(spark):
    big = [0.25, 1e10, -1e10, 2.0**54, -(2.0**54), 2.0**60 + 2.0**20, 1e200, -1e200, 1e305, 1.7e308, 5e-324, -5e-324, 3e15 + 0.5]
    rows = [(k, [x, y]) for k, (x, y) in enumerate((x, y) for x in big for y in (0.0, 1.0, -x))]
    rows += [(100, [2.0**54, 0.0]), (150, [2.0**54 + 4, 0.0]), (200, [1e10, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in top_products(df, every=1).collect())
    assert got == brute_top(rows, 1)


def test_small_blocks_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 8)]) for i in range(400)] + [(1000 + i, [1.0] * 8) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name, value in (("SHARD", 16), ("BLOCK", 4), ("GROUP", 2), ("ASKED", 2)):
        monkeypatch.setattr(topk, name, value)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in top_products(df).collect())
    assert got == brute_top(rows)


def test_records_are_packed_faster_than_by_zlib():
    import timeit

    rng = np.random.default_rng(2)
    records = [rng.zipf(1.3, T.LENGTH).clip(0, 50_000).astype("<u2").tobytes() for _ in range(200)]
    codec = T.record_codec()
    packed = [codec.compress(r, asbytes=True) for r in records]
    assert [codec.decompress(p, len(r), asbytes=True) for p, r in zip(packed, records, strict=True)] == records
    assert sum(map(len, packed)) < 1.1 * sum(len(zlib.compress(r, 1)) for r in records) < sum(map(len, records))
    took = lambda f: min(timeit.repeat(lambda: [f(r) for r in records], number=1, repeat=5))
    assert took(lambda r: codec.compress(r, asbytes=True)) < took(lambda r: zlib.compress(r, 1))
