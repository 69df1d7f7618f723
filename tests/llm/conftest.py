import pytest


@pytest.fixture(scope="session")
def make(spark):
    """make(rows, schema) -> DataFrame, written once so that it reads like a table."""
    def build(rows, schema):
        return spark.createDataFrame(rows, schema)
    return build


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(make):
    """Documents with nulls, empty and long texts, ties, repeated rows and columns whose names clash with ours."""
    rows = [
        (1, "alpha beta gamma delta", "en", "b", 22, "x", 5),
        (2, None, None, None, None, None, None),
        (3, "", "en", "a", 0, "x", 1),
        (4, "  \t\n ", "de", "a", 5, "y", 2),
        (5, "alpha beta gamma delta", "en", "b", 22, "x", 5),
        (5, "alpha beta gamma delta", "en", "b", 22, "x", 5),
        (None, "no id here at all", "en", "c", 17, "z", 3),
        (7, "long " * 30_000, "en", None, 150_000, "z", 3),
        (8, "Ünï çödé token = 'abcdef123456' end", "fr", "é", 35, "z", 3),
    ]
    return make(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, size int")
