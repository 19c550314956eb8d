"""Quoted regions of whole documents: Python reads each text once for its tokens, and tells pieces of few texts at a time."""

import pyarrow as pa
from pyspark.sql import functions as F

from textwarrant.functions import text
from textwarrant.plans import registry


def test_texts_are_read_once(spark, tmp_path):
    rows = [(1, 'it was the "one two three four" and more'), (2, None), (3, "nothing")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = registry.QUERIES["quoted_regions"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # the marks, and the tokens
    assert plan.count("EvalPython") == 2
    assert [(r.doc_id, r.no, r.kind) for r in found.collect()] == [(1, 0, "straight")]


def test_pieces_come_out_for_few_texts_at_a_time(monkeypatch):
    made = []
    monkeypatch.setattr(F, "arrow_udf", lambda of, kind: lambda column: made.append(of))
    text.token_pieces(None)
    batches = list(made[0](iter([pa.array(["a b"] * 1000)])))
    assert sum(map(len, batches)) == 1000 and max(map(len, batches)) <= text.TEXTS_AT_ONCE
