import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from (doc_id, text, lang, source), with a column whose name clashes with results."""

    def make(rows):
        full = [(*r, *[None] * (4 - len(r)), len(r[1]) if r[1] is not None else None, -1.0) for r in rows]
        return spark.createDataFrame(full, DOCS + ", score double")

    return make
