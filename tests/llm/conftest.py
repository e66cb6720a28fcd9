import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, bit string, key string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with extra columns whose names the operators use inside."""

    def make(rows, source="s"):
        full = [(i, t, "en", source if k % 3 else None, None if t is None else len(t), "x", "y", "z") for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(full, DOC_SCHEMA)

    return make


@pytest.fixture(scope="session")
def sample_docs(spark, sf_dir):
    """The documents table as a list of (doc_id, text)."""
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
