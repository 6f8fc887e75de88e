from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """A table of documents from (doc_id, text) pairs, with extra columns whose names clash with the operators' own."""

    def make(pairs):
        rows = [(i, t, "en", "s", len(t or "")) for i, t in pairs]
        return spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' AS score", "'x' AS component", "'x' AS fp", "'x' AS n", "'x' AS shard", "'x' AS ids")

    return make
