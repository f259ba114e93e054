import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkorbit.llm.license_texts import PHRASES, TEMPLATES
from sparkorbit.llm.licenses import automata, build, parse, scan_licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ALL = [(label, p) for p, label in PHRASES] + list(TEMPLATES)


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ends(items, w, i):
    """Every place after a stretch from i that the items accept, by plain recursion over the parsed template."""
    at = {i}
    for x in items:
        if isinstance(x, str):
            at = {j + 1 for j in at if j < len(w) and w[j] == x}
        elif isinstance(x, tuple):
            at = {j + k for j in at for k in range(x[0], x[1] + 1) if j + k <= len(w)}
        else:
            at |= {e for j in at for e in ends(x, w, j)}
    return at


def brute(text, templates=ALL):
    w = words(text)
    return len(w), sorted((label, i, max(e)) for label, p in templates for i in range(len(w)) if (e := ends(parse(p), w, i)))


def shown(markup, rng):
    """A text that the template accepts: optional regions in or out, replaceable words invented."""
    def say(items):
        for x in items:
            if isinstance(x, str):
                yield rng.choice([x, x.upper(), x.title()])
            elif isinstance(x, tuple):
                yield from (f"Wörd{rng.randrange(9)}" for _ in range(rng.randint(*x)))
            elif rng.random() < 0.5:
                yield from say(x)
    return rng.choice([" ", "\n", ", ", " - "]).join(say(parse(markup)))


def spans(row):
    return row["license_words"], sorted((s["label"], s["start"], s["end"]) for s in row["license_spans"])


def test_every_template_is_found_and_one_changed_word_is_not(spark):
    rng, rows = random.Random(1), []
    for label, p in ALL:
        for _ in range(4):
            text = shown(p, rng)
            rows.append((label, True, f"foo {text} bar"))
            w = text.split()
            must = [x for x in parse(p) if isinstance(x, str)]
            k = next(i for i, x in enumerate(w) if words(x) == [must[1]])
            rows.append((label, False, " ".join([*w[:k], "other", *w[k + 1 :]])))
    df = spark.createDataFrame(rows, "label string, holds boolean, text string")
    for r in scan_licenses(df).collect():
        got = spans(r)
        assert got == brute(r["text"])
        assert not r["holds"] or r["label"] in {s[0] for s in got[1]}


def test_odd_rows(spark, odd_docs, no_docs):
    rows = scan_licenses(odd_docs).collect()
    assert len(rows) == odd_docs.count() and scan_licenses(no_docs).count() == 0
    for r in rows:
        assert spans(r) == brute(r["text"])
        assert r["license_score"] == 0
    clash = scan_licenses(odd_docs.withColumnRenamed("nth", "license_words"))
    assert clash.columns[-3:] == ["_license_words", "license_spans", "license_score"] and clash.count() == len(rows)


def test_very_long_and_crowded_texts(spark):
    texts = ["mit license " * 60_000, "x " * 500_000 + "Apache License, Version 2.0", "gnu general public " * 20_000, "cc by\x00nc ccby cc éby mit_license mit license2"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    got = {r["doc_id"]: spans(r) for r in scan_licenses(df).collect()}
    assert len(got[0][1]) == 60_000 and got[0][0] == 120_000
    assert [s[0] for s in got[1][1]] == ["apache", "apache-2.0"] and got[1][1][0][1] == 500_000
    assert got[2][1] == [] and got[3] == brute(texts[3])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("a b c d".split()), max_size=12))
def test_automaton_equals_recursion(w):
    for p in ("a b [[c [[d]] a]] {{0-2}} b", "a b {{1-3}} c [[d]]", "a b [[a b]] [[c]] a", "a a [[{{0-1}} b]] c {{2-2}}"):
        m = build("x", p)
        for i in range(len(w)):
            states, found = m.close(1), []
            for j in range(i, len(w)):
                states = m.step(states, w[j].encode())
                if states & m.accept:
                    found.append(j + 1)
            assert set(found) == ends(parse(p), w, i)


def test_scores_and_markup():
    m = {a.label: a for a in automata()}
    assert m["mit"].mandatory == 2 and m["mit"].base and not m["mit-text"].base and m["mit-text"].mandatory > 100
    for bad in ("a [[b", "a b ]]", "a [[b]] c"):
        with pytest.raises(ValueError):
            build("x", bad)
