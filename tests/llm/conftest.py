import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def shipped(spark):
    from codestrata.llm.common import ship

    ship(spark)
    return spark


@pytest.fixture
def docs_of(shipped):
    """Documents from texts; ids from 0 unless given."""

    def make(texts, ids=None, sources=None):
        n = len(texts)
        rows = [((ids[i] if ids else i), t, "en", (sources[i] if sources else "s"), len(t or "")) for i, t in enumerate(texts)]
        return shipped.createDataFrame(rows, DOCS)

    return make


#: Null, empty, white-space-only and one-word texts, as every operator has to take.
ODD = [None, "", "   \n\t", "word", "Ünï cödé ✓ 😀"]
