import random

import pytest

WORDS = "the of and to in is was for that with from this are by it as on be at or river stone winter house garden letter morning table window music paper silver summer market bridge".split()
MOTS = "le la les de des et un une du que en est pour dans par sur avec ce qui au rivière pierre hiver maison jardin lettre matin fenêtre musique papier été marché pont".split()


def prose(seed, n, words=WORDS):
    r = random.Random(seed)
    return " ".join(r.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Documents with nulls in every column, empty and very long texts, copies and repeated rows."""
    long_text = prose(1, 40_000) + "\n" + "x" * 5_000
    a = prose(2, 120)
    near = " ".join(w if k != 60 else "changed" for k, w in enumerate(a.split()))
    return [
        (1, a, "en", "s0", 1), (2, a, "en", "s1", 1), (3, near, "en", None, 1), (4, None, "en", "s0", None), (5, "", None, "s0", 0), (6, " \n\t ", "en", "s0", 3),
        (7, "word", None, None, 4), (8, long_text, "en", "s0", 1), (9, prose(9, 150, MOTS), "fr", "s1", 1), (9, prose(9, 150, MOTS), "fr", "s1", 1), (None, prose(10, 80), "en", "s2", 1),
        (11, "1234 5678 !!!", None, "s2", 1), (12, prose(12, 90) + "\n" + prose(12, 90) + "\n" + prose(12, 90), "en", "s2", 1), (13, prose(13, 200, MOTS), "fr", None, None), (14, "é" * 200 + " 　 日本語 テスト", "ja", "s1", 1),
    ]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 1, 0), (3, 0, 0), (9, 1, None), (12, 0, 1), (None, 1, 0), (13, None, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def clashing(odd):
    """The same rows with columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    names = ["id", "t", "held", "carry_0", "label", "part", "ids", "component", "set_key", "minima", "bands", "rep", "at", "rate", "copies", "replica", "value", "row", "html", "url", "key", "score", "kept", "n", "size", "band"]
    return odd.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
