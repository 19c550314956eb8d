"""The pipeline's near duplicates are those of SimHash."""

import corpus_pipeline
from textwarrant.llm import simhash


def test_the_stage_keeps_one_of_each_component_by_fingerprint(spark):
    often = "every shingle of these five " * 25
    texts = [often + "one tail of words", often + "another end that differs", "short text alone", "short text alone", "", None]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["simhash_dedup"](spark, docs, "").collect()}
    assert kept == {r.component_id for r in simhash.near_duplicates(docs).collect()} == {0, 2, 4}
