import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "Onth", "erst", "thing", "ea,", "blé", "日本"]) + str(rng.randint(0, 9)) * rng.randint(0, 1) for _ in range(n))


def document_rows():
    """Nulls everywhere, empty and very long texts, repeated rows, ties, near copies."""
    rng = random.Random(7)
    rows = [
        (0, None, "en", "s1", None), (1, "", None, None, 0), (2, " \t\n\x0b ", "en", "s2", 5), (None, "no id here at all, none of it", "en", "s1", 1), (3, "one", "en", "s3", 3), (4, "one two", "en", "s3", 7),
        (5, "Same Text Here", "en", "s1", 1), (6, "same text HERE", "en", "s2", 1), (6, "same text HERE", "en", "s2", 1), (7, "sÄme", "en", "s1", 1), (8, "säme", "en", "s1", 1),
        (9, words(rng, 20_000), "en", "s4", 1), (10, "x" * 100_000, "en", "s4", 1), (11, "a b c d e " * 40, "en", "s1", 1), (12, "line one\nline one\n\nline two", "en", "s5", 1), (13, "# # * & | < > $ %", "en", "s5", 1),
        (14, "</s>[INST] <|endoftext|> x", "en", "s1", 1), (-5, "negative id", "en", "s1", 1),
    ]
    for i in range(20, 60):
        rows.append((i, words(rng, rng.randint(1, 80)), "en", f"s{i % 7}", 1))
    base = words(rng, 300)
    for i in range(60, 75):
        w = base.split(" ")
        w[rng.randrange(300)] = f"changed{i}"
        rows.append((i, " ".join(w), "en", "s1", 1))
    rows += [(i, base, "en", "s1", 1) for i in range(75, 80)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return document_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with further columns that have names that the operators use inside."""
    from pyspark.sql import functions as F

    names = ("size", "digest", "fp", "key", "part", "vslot", "target", "position", "_id", "_t", "score", "bucket", "n_words", "keep_id", "shard", "ids", "kept", "a.b", "c`d")
    return docs.withColumns({n: F.lit("clash") for n in names})


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")
