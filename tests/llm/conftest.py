import pytest

ODD = "doc_id bigint, text string, source string, lang string, body string, key string, n bigint"


@pytest.fixture
def odd(spark):
    """Documents with nulls, empty and blank texts, repeated rows, and columns named like the operators' own."""

    def make(*texts, ids=None):
        ids = ids or range(len(texts))
        return spark.createDataFrame([(i, t, "s", "en", "b", "k", 7) for i, t in zip(ids, texts, strict=True)], ODD)

    return make


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], ODD)
