import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names are those of outputs or of an operator's own columns.
CLASHING = ["ids", "n_tokens", "decoded", "findings", "fingerprint", "component_id", "row", "root", "key", "score", "Row", "media", "payload", "w", "item"]

WORDS = "the and of to in was that with for from have been this which will their would there could about other after first water people".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", "s", "ed", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    rng = random.Random(5)
    long = prose(rng, 30_000)
    base = prose(rng, 120)
    texts = [None, "", " ", "word", "two words", "three words here", base, base, base.replace("the", "a", 1), long, "x" * 60_000, "\n\t\x0b é ü ß ñ 日本 \U0001f600", "a b", "TOP " * 50]
    rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    rows += [(6, base, "en", "s0", len(base)), (6, base, "en", "s0", len(base)), (None, base, None, None, None), (None, None, None, None, None), (2, " ", "en", "s2", 1)]
    rows += [(100 + k, prose(rng, 60), "en", "s1", 0) for k in range(25)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, odd):
    from pyspark.sql import functions as F

    names = [n for n in CLASHING if n != "Row"]
    return odd.select("*", *[F.lit(f"own {n}").alias(n) for n in names])
