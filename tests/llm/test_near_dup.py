import random
import re

import numpy as np
import pyarrow as pa

from sparkorbit.llm import textkernel as K
from sparkorbit.llm.near_dup import drop_duplicates, near_duplicates, signature

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows, percent=75):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        comp = min(ids, default=None) if sets[i] else d
        out.append((d, len(sets[i]), comp, d == comp))
    return sorted(out, key=str)


def test_kernel_values_tell_shingles_apart():
    texts = ["a b c d e f", "a b c d e", "A\tB  c d e f", "a b", "ab", "", "x", "éa b c d é"]
    data, offs = K.utf8(pa.array([*texts, None]))
    value, at = K.shingles(data, offs)
    per = [set(map(int, value[at[k] : at[k + 1]])) for k in range(len(offs) - 1)]
    assert [len(p) for p in per] == [2, 1, 2, 1, 1, 0, 1, 1, 0]
    assert per[0] == per[2] and per[1] < per[0] and per[3] != per[4]


def test_signature_estimates_jaccard():
    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (600, 200, 200))
    x, y = (signature(np.unique(np.concatenate((common, v)))) for v in (a, b))
    assert abs((x == y).mean() - 0.6) < 0.15


def test_groups_match_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"v{i}" for i in range(300)]
    rows = []
    for g in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randint(3, 80))]
        passage = [f"p{i}" for i in range(40)] if g % 3 == 0 else []
        for _ in range(rng.randint(1, 9)):
            w = [x if rng.random() > 0.02 * (g % 4) else rng.choice(vocab) for x in base] + passage
            rows.append((len(rows) * 7 % 101, " ".join(w)))
    rows += [(500, None), (501, ""), (rows[0][0], rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_family_without_one_centre(spark):
    """Copies of copies: open buckets are finished by rare shingles."""
    rng = random.Random(9)
    vocab = [f"v{i}" for i in range(5000)]
    base = [rng.choice(vocab) for _ in range(60)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(60)] = rng.choice(vocab)
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    got = near_duplicates(odd_docs).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert len(got) == len(rows)
    want = {(d, n): c for d, n, c, _ in brute(rows) if d is not None}
    for r in got:
        if r["doc_id"] is not None:
            assert r["component_id"] == want[r["doc_id"], r["n_shingles"]]
    kept = drop_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted(r["doc_id"] or 0 for r in kept.collect())
    assert ids.count(2) == 0 and ids.count(1) == 1 and ids.count(8) == 0 and {4, 5, 6, 7, 9} <= set(ids)
    assert near_duplicates(no_docs).count() == drop_duplicates(no_docs).count() == 0


def test_repeated_ids_leave_one(spark):
    rows = [(3, "a b c d e f g"), (3, "a b c d e f g"), (4, "a b c d e f g"), (5, "z"), (5, ""), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in drop_duplicates(df).collect()) == [(3, "a b c d e f g"), (5, ""), (5, ""), (5, "z")]
