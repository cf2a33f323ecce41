import pytest
from pyspark.sql import functions as F

from basketlake.session import ship_package

SMALL = "/root/testdata/sf0.001"

#: Names that operators use inside; inputs may bring them too.
CLASHING = ["size", "key", "row", "cls", "root", "target", "taken", "_chunk", "rid", "words", "n", "place", "file", "held_out"]


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents(doc_id, text, lang, source, n_chars) plus columns with clashing names."""
    def make(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
        return df.withColumns({"n_chars": F.length("text").cast("long"), **{c: F.lit("x") for c in CLASHING}})
    return make


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7 + i * (3 + seed % 5) + i * i) % len(WORDS)] + (str(seed % 10) if i % 3 else "") for i in range(n))


@pytest.fixture(scope="session")
def messy(make_docs):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows."""
    return make_docs([
        (1, prose(1, 60), "en", "a"), (1, prose(1, 60), "en", "a"), (2, None, "en", "b"), (3, "", None, None),
        (4, " \t\n ", "fr", ""), (None, prose(2, 40), "fr", "a"), (5, prose(3, 60), None, "c"), (6, prose(3, 60), "de", None),
        (7, "één 日本語 ñandú ß Straße", "de", "ü"), (8, "x" * 200_000 + " " + prose(4, 20_000), "en", "b"), (9, "!!! ??? 123", "en", "a"),
    ])


@pytest.fixture(scope="session")
def nothing(make_docs):
    return make_docs([])
