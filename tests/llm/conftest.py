import random

import pytest
from pyspark.sql import types as T

LONG = "word" + " ".join(f"tok{i % 997}" for i in range(60_000))
DOCS = [
    (1, None, None, "clash"), (2, "", "a", "clash"), (3, "Hello, world", "a", None), (4, LONG, "b", "x"),
    (5, "one two three four five six seven eight nine ten", "b", "x"), (5, "one two three four five six seven eight nine ten", "b", "x"),
    (6, "one two three four five six seven eight nine ten", "b", "y"), (None, "a row without id, call +1 (269) 555-3296 4524132264652876 now", "c", "z"),
    (7, "mail me@a.example.com or 10.0.0.300 then 10.0.0.255, Über-ß 😀 x@y", "c", "z"), (8, "a" * 700 + " " * 40, None, "z"),
    (9, "word", "a", "x"), (10, "word", "a", "x"),
]


@pytest.fixture(scope="session", autouse=True)
def ready(spark):
    from taintgrid.llm.queries import prepare

    prepare(spark)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, very long and repeated texts, repeated rows, a null id, and columns named as the operators' own."""
    names = ["fp", "row", "copy", "shuffle_key", "at_least", "_id", "_fp", "_row", "size", "key", "shard", "slot", "n", "word", "words", "ids", "own", "selected", "x"]
    kinds = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType())]
    return spark.createDataFrame([(i, t, s, *[c] * len(names)) for i, t, s, c in DOCS], T.StructType(kinds + [T.StructField(n, T.StringType()) for n in names]))


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def prose():
    """Invented texts with copies, near copies and shared passages: (doc_id, text)."""
    r = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    passage = [r.choice(words) for _ in range(30)]
    out = []
    for i in range(160):
        if out and r.random() < 0.45:
            text = r.choice(out)[1].split()
            for _ in range(r.choice([0, 1, 1, 2, 8])):
                text[r.randrange(len(text))] = r.choice(words)
        else:
            text = [r.choice(words) for _ in range(r.choice([3, 7, 60, 120]))] + (passage if r.random() < 0.5 else [])
        out.append((i, " ".join(text)))
    return out
