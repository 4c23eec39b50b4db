import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) pairs, with an extra column whose name operators use themselves."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "src", len(t or ""), 0.5) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score double")

    return make


ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one"), (5, "one"), (6, "x" * 70_000), (7, "word " * 30_000), (8, "naïve café 日本語 \U0001f600 x")]


@pytest.fixture(scope="session")
def odd_rows():
    return ODD
