import pytest

pytest.importorskip("conceptloom.llm")

NEW = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(frame):
    """Documents from texts (ids count up), with a null id, nulls, empties, repeats and a clashing extra column."""

    def make(texts, extra=()):
        rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
        return frame([*rows, *extra], NEW)

    return make


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def corpus(sf):
    import pyarrow.parquet as pq

    return pq.read_table(f"{sf}/documents.parquet").to_pandas()
