import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source)."""

    def rows(items):
        full = [(i[0], i[1], *(i[2:] if len(i) > 2 else ("en", "a")), None if i[1] is None else len(i[1])) for i in items]
        return spark.createDataFrame(full, SCHEMA)

    return rows


@pytest.fixture(scope="session")
def odd(make):
    """Nulls in every column, empty and blank texts, ties, repeated rows, a very long text; columns with clashing names."""
    from pyspark.sql import functions as F

    long = " ".join(random.Random(5).choices([f"w{i}" for i in range(500)], k=30_000))
    docs = make([
        (1, "", "en", "a"), (2, None, "en", "a"), (None, "no id here but some words", "en", "a"), (3, " \t\n\x0b ", None, None),
        (4, "one two three", "en", None), (4, "one two three", "en", None), (5, long, "de", "b"), (6, long, "de", "b"), (7, "ÄÖ ü ß\x85x", "de", "\U0001f600"), (None, None, None, None),
    ])
    clash = ("th", "h", "fp", "size", "key", "bucket", "label", "label_", "slot", "taken", "words", "spans", "known", "anchor", "text_hash", "times", "row", "own_id", "hits", "use", "good", "stratum", "n_words", "score")
    return docs.withColumns({c: F.lit("x") for c in clash})


@pytest.fixture(scope="session")
def vocabulary():
    r = random.Random(11)
    return ["".join(r.choices("abcdefghijklmnoprstuvw", k=r.randint(2, 9))) for _ in range(900)]
