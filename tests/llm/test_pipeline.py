"""The pipeline's stages on odd rows: each works on what the one before it kept."""

import hashlib

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from textwarrant.llm import bpe
from textwarrant.tables import materialize

SF = "/root/testdata/sf0.001"


def test_stages_on_odd_rows(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"score": F.lit(1), "line_count": F.lit(777), "mix_size": F.lit("own"), "line_dropped": F.lit("own")})
    first = documents.filter("length(text) > 400 and lang = 'en'").orderBy("doc_id").first()
    odd = [(900_001, None, "en", "src0", 0, 1, 777, "own", "own"), (900_002, "", "en", None, 0, 1, 777, "own", "own"), (900_003, "!!! 123", None, "src1", 7, 1, 777, "own", "own")]
    odd += [(900_004, first.text, "en", first.source, len(first.text), 1, 777, "own", "own"), (None, first.text, None, None, len(first.text), 1, 777, "own", "own"), (first.doc_id, first.text, "en", first.source, len(first.text), 1, 777, "own", "own")]
    docs = documents.unionByName(spark.createDataFrame(odd, documents.schema))
    counts, kept = [docs.count()], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = materialize(stage(spark, kept, SF), f"test-{name}")
        assert kept.columns == docs.columns, name
        assert [tuple(r) for r in kept.select("score", "line_count", "mix_size", "line_dropped").distinct().collect()] == [(1, 777, "own", "own")], name
        counts.append(kept.count())
        if name == "language_id":
            rows = {r.doc_id for r in kept.collect()}
            assert not rows & {900_001, 900_002, 900_003} and {first.doc_id, 900_004} <= rows
            assert counts[0] - counts[1] <= 8  # clean documents stay
        if name == "line_dedup":
            assert counts[2] == counts[1]  # lines go, documents don't
        if name == "simhash_dedup":
            texts = [r.text for r in kept.collect()]
            assert len(texts) == len(set(texts))  # of copies and of a repeated row one stays
            assert 900_004 not in {r.doc_id for r in kept.collect()}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    wanted = sorted((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest(), len(own.encode_ordinary(r.text))) for r in kept.collect())
    coded = corpus_pipeline.STAGES[-1][1](spark, kept, SF).collect()
    assert sorted((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest(), r.n_tokens) for r in coded) == wanted
    assert all(len(r.tokens) == 4 * r.n_tokens for r in coded)


def test_an_empty_table_passes_all_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_copies_of_each_source_and_a_dropped_line(spark):
    """What line_dedup and mix decide, worked out by hand."""
    texts = [(i, f"menu line here\nown words of text number {i}", "en", "a", 0) for i in range(30)] + [(100 + i, "four words each here", "en", "b", 0) for i in range(30)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    clean = {r.doc_id: r for r in stages["line_dedup"](spark, docs, SF).collect()}
    assert all(clean[i].text == f"own words of text number {i}" and clean[i].n_chars == len(clean[i].text) for i in range(30))
    even = spark.createDataFrame([(i, "two words", "en", "abc"[i % 3], 9) for i in range(240)], docs.schema)
    taken = {r.source: r["count"] for r in stages["mix"](spark, even, SF).groupBy("source").count().collect()}
    # of 480 words the sources get 300, 120 and 60 by weight: 150, 60 and 30 documents of two words
    assert taken == {"a": 150, "b": 60, "c": 30}
