import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Rows with a clashing extra column; make(rows) takes (doc_id, text)."""
    def make(rows):
        return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string")
    return make


ODD = [(0, None), (1, ""), (2, " \n\t "), (3, "One two three four five six."), (3, "One two three four five six."), (4, "x" * 300_000), (None, "null id text here now"), (5, "a b"), (6, "é▁\U0001f600 \x01 z")]


@pytest.fixture(scope="session")
def odd():
    return ODD
