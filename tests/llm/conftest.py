import pytest


@pytest.fixture
def make_docs(spark):
    """Documents from texts (ids count up) or (id, text) pairs, with clashing extra columns."""
    def make(*texts):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame(
            [(i, t, f"s{(i or 0) % 2}", 1, "x", 2) for i, t in rows],
            "doc_id bigint, text string, source string, fp bigint, band string, n bigint")
    return make
