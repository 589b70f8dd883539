"""Fixtures of the training-data operators."""

import pytest

#: Columns whose names clash with what operators use inside.
EXTRA = "a long, b string, text2 string, score double, key long, digest string"


@pytest.fixture(scope="module")
def make(spark):
    """make(rows) -> documents of (doc_id, text) with clashing extra columns."""
    def rows(pairs):
        schema = f"doc_id long, text string, {EXTRA}"
        return spark.createDataFrame([(i, t, 1, "b", "t", 0.5, 7, "d") for i, t in pairs], schema)
    return rows


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
