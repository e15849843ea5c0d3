"""Every query of the engine against its SQL, on whole small tables."""

import pytest

import __spark_entry__ as entry
from siftwell.plans import catalog

from .conftest import SF


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_agrees_with_sql(agrees, name):
    agrees(name)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_without_sql_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "chunk_id" in df.columns


def test_category_filter_reaches_the_scan(spark, tmp_path):
    from siftwell.operators import ingest, vector

    d = spark.createDataFrame([("a.txt", "a.txt", "TXT", "some text"), ("r rule.txt", "r rule.txt", "TXT", "other")], "source string, name string, type string, text string")
    ingest.append_chunks(ingest.with_embeddings(ingest.chunk_documents(d)), str(tmp_path / "chunks"))
    chunks = spark.read.parquet(str(tmp_path / "chunks"))
    q = chunks.limit(1).selectExpr("1 as qid", "embedding")
    plan = vector.top_k(q, chunks, 2, categories=("rules",))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(category" in plan or "PartitionFilters: [(category" in plan or "category#" in plan.split("PartitionFilters:")[1][:80]


@pytest.mark.parametrize("name", ["vector_topk", "routed_topk"])
def test_more_questions_than_a_block_are_all_answered(spark, agrees, monkeypatch, name):
    from siftwell.operators import vector

    monkeypatch.setattr(vector, "BROADCAST_QUESTIONS", 6)
    agrees(name)
