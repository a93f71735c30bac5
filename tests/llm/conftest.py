import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    def make(texts, sources=None, ids=None):
        rows = [(i if ids is None else ids[i], t, "en", sources[i] if sources else f"s{i % 3}", len(t) if t is not None else None) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOC).repartition(3)

    return make
