import pytest

pytest.importorskip("tidemark.llm")


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    """The documents in order, as (doc_id, text)."""
    return [(r.doc_id, r.text) for r in documents.select("doc_id", "text").orderBy("doc_id").collect()]
