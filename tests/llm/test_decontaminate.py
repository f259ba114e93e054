from pyspark.sql import functions as F

from sparkorbit.llm.decontaminate import contained_items, decontaminate, item_index, probes, size_partitions, word_array

ITEM = "what is the largest prime below one hundred that ends in seven and why does it matter to anyone"


def test_items_inside_long_texts(spark, no_docs):
    filler = " ".join(f"x{i}" for i in range(20_000))
    rows = [
        (1, filler + " " + ITEM.upper() + " " + filler),
        (2, "see: " + " ".join(ITEM.split()[:14]) + " end"),
        (3, " ".join(ITEM.split()[:9])),
        (4, "go home now"),
        (5, "they go home now please"),
        (6, None),
        (7, ""),
        (1, "clean words only in this one"),
        (None, ITEM),
    ]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int")
    items = spark.createDataFrame([(10, ITEM), (11, "Go home now"), (12, ""), (13, None), (10, ITEM)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["item_shingles"], r["hits"]) for r in contained_items(docs, items).collect()}
    n = len(ITEM.split()) - 4
    assert got == {(1, 10): (n, n), (None, 10): (n, n), (4, 11): (1, 1), (5, 11): (1, 1)}
    left = decontaminate(docs, items)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 2, 3, 6, 7]
    assert contained_items(no_docs, items).count() == 0
    assert decontaminate(docs, items.limit(0)).count() == len(rows)


def test_share_decides(spark):
    words = ITEM.split()
    docs = spark.createDataFrame([(k, " ".join(words[:k])) for k in range(5, len(words) + 1)], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    n = len(words) - 4
    got = {r["doc_id"]: r["hits"] for r in contained_items(docs, items).collect()}
    assert got == {k: k - 4 for k in range(5, len(words) + 1) if (k - 4) / n >= 0.75}


def test_odd_rows(odd_docs, spark):
    items = spark.createDataFrame([(1, "the quick brown fox jumps over a lazy dog while")], "item_id long, text string")
    assert {r["doc_id"] for r in contained_items(odd_docs, items).collect()} == {1, 2, 3, None}
    kept = decontaminate(odd_docs, items)
    assert kept.columns == odd_docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {4, 5, 6, 7, 8, 9, None}


def test_short_items_cost_the_other_partitions_nothing(spark):
    docs = spark.createDataFrame([(1, " ".join(f"v{i * i % 7919}" for i in range(9000)))], "doc_id long, text string")
    long = [(k, " ".join(f"q{k}w{i}" for i in range(60 + k))) for k in range(20)]
    short = [(100 + k, f"two{k} words{k}") for k in range(30)] + [(200 + k, f"a{k} b c{k} d e") for k in range(30)]

    def kept(items):
        parts = size_partitions(item_index(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text", 0.75))
        rows = docs.select(F.explode(probes(word_array(F.col("text")), parts)).alias("p")).groupBy("p.part").count()
        return {r["part"]: r["count"] for r in rows.collect()}, parts

    alone, _ = kept(long)
    both, parts = kept(long + short)
    assert {p["part"] for p in parts} == {-2, 0, 5, 6}
    assert all(both.get(p, 0) == alone.get(p, 0) for p in (5, 6))
    assert sum(both.values()) < 0.2 * 9000


def test_partitions_match_plain_containment(spark):
    import random

    rng = random.Random(1)
    words = [f"v{i}" for i in range(60)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice((1, 2, 3, 4, 5, 6, 9, 17, 40))))) for k in range(60)]
    docs = [(d, " ".join(rng.choice(words) if rng.random() < 0.3 else rng.choice(items)[1] for _ in range(rng.randint(0, 12)))) for d in range(60)]

    def shingles(t, k):
        w = t.split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    want = set()
    for i, t in items:
        own = shingles(t, min(5, len(t.split())))
        for d, text in docs:
            hits = len(own & shingles(text, min(5, len(t.split()))))
            if 4 * hits >= 3 * len(own):
                want.add((d, i, len(own), hits))
    found = contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"], r["item_shingles"], r["hits"]) for r in found.collect()} == want and len(want) > 100
