import pytest
from pyspark.sql import functions as F

KIND = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the quick brown fox jumps over a lazy dog while seven small boats drift along the quiet river at dawn and nobody sees them go".split()


#: Names that the operators use for columns of their own.
CLASHES = "key tx label size node h rank row rate bad_id bad_tx nd_id nd_tx nd_kept copy mx_copy part m k want want_tx held id rid own own_id cand_id mask g o sid shard slot number place nth seq".split()


@pytest.fixture
def odd_docs(spark):
    """Null and empty texts, ties, repeated rows, a long text, null ids, and columns with clashing names."""
    base = " ".join(WORDS)
    near = base.replace("seven", "eight")
    rows = [
        (1, base, "en", "a", 1),
        (2, base, "en", "a", 1),
        (2, base, "en", "a", 1),
        (3, near + " " + base, "en", "b", 1),
        (4, None, "en", "b", None),
        (5, "", None, None, 0),
        (6, " \n\t ", "de", "", 3),
        (7, "one two", "en", "a", 7),
        (8, "ONE\ttwo", "en", "a", 7),
        (None, "é" * 20 + " ünï 𝒳 " + base, "fr", "c", 9),
        (None, None, None, None, None),
        (9, " ".join(f"w{i % 977}" for i in range(60_000)), "en", "c", 1),
    ]
    df = spark.createDataFrame(rows, KIND)
    return df.withColumns({c: F.lit(1) for c in CLASHES})


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], KIND)


@pytest.fixture
def clashes():
    return CLASHES
