import pytest


@pytest.fixture
def docs(spark):
    """Makes a documents table of texts, with columns that clash with the operators' own names."""

    def make(texts, ids=None, **more):
        rows = [(i, t, "en", "src", None if t is None else len(t), "x") for i, t in zip(ids or range(len(texts)), texts, strict=True)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")

    return make
