import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Makes a documents table of texts, or of (doc_id, text)."""

    def make(rows):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")

    return make
