import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, word string, length long, _norm string, label int"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text) pairs with columns whose names clash with the operators' own."""
    def make(pairs, lang="en"):
        rows = [(i, t, lang, "src0", len(t or ""), 7, "w", 5, "x", 1) for i, t in pairs]
        return spark.createDataFrame(rows, SCHEMA)
    return make


@pytest.fixture(scope="session")
def odd_pairs():
    """Nulls, empty and blank texts, repeated rows, ties, a null id and a very long text."""
    rnd = random.Random(5)
    syllables = ["an", "be", "co", "du", "el", "fi", "go", "ha"]
    def prose(n):
        return " ".join("".join(rnd.choices(syllables, k=rnd.randint(1, 3))) for _ in range(n))
    base = prose(60)
    long_text = prose(30_000)
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, base), (5, base), (5, base), (6, base + " more"), (None, base), (None, None),
        (7, prose(25)), (8, "ÀÉ straße ΑΣ 你好 😀 <|endoftext|> x"), (9, long_text), (10, "one"), (11, "a b c d"), (12, "A B  C D"),
        (13, prose(20) + "\n" + prose(20) + "\n\n" + prose(30)), (14, "x\x1cy\x85z w"),
    ]


@pytest.fixture(scope="session")
def small(spark):
    return lambda name, sf="0.001": spark.read.parquet(f"/root/testdata/sf{sf}/{name}.parquet")


def rows(df, *cols):
    return [tuple(r) for r in (df.select(*cols) if cols else df).collect()]


def key(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


@pytest.fixture(scope="session")
def got():
    return lambda df, *cols: sorted(rows(df, *cols), key=lambda r: repr(r))
