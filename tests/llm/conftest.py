"""Small fixtures for the operators on documents."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) pairs, with extra columns whose names
    clash with those that operators add."""

    def make(rows, extra=True):
        data = [(i, t, "en", "s", 1, 7, "x") if extra else (i, t, "en", "s", 1) for i, t in rows]
        return spark.createDataFrame(data, SCHEMA + (", score long, Text string" if extra else ""))

    return make
