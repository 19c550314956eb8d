import pytest
from pyspark.sql import functions as F

from textwarrant.llm import bm25

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


@pytest.fixture
def docs(spark):
    rows = [(i, " ".join(WORDS[(i * 7 + j * j) % 10] for j in range(1 + i % 13)) + f" own{i % 17}") for i in range(120)]
    return spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)


def test_a_reader_gets_one_shard_at_a_time(spark, docs, monkeypatch):
    monkeypatch.setattr(bm25, "SHARD_DOCUMENTS", 8)
    seen = []
    write = bm25.materialize
    monkeypatch.setattr(bm25, "materialize", lambda df, name, **more: seen.append((name, write(df, name, **more))) or seen[-1][1])
    bm25.search(docs, docs.limit(3).withColumnRenamed("doc_id", "query_id"))
    index = dict(seen)["bm25-index"]
    assert [r["n"] for r in index.groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect()] == [1] * 15


def test_few_postings_at_a_time_change_no_score(docs, monkeypatch):
    queries = docs.filter("doc_id % 5 = 0").withColumnRenamed("doc_id", "query_id")
    whole = sorted(bm25.search(docs, queries).collect())
    monkeypatch.setattr(bm25, "POSTINGS_AT_ONCE", 3)
    found = sorted(bm25.search(docs, queries).collect())
    assert found == whole and len(whole) == 240
