"""Composite queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarrant.functions.text import normalize, words
from textwarrant.operators import retrieve, review, sequence
from textwarrant.plans.registry import query
from textwarrant.plans.retrieval import _posted, bm25_of, bm25_topk, jaccard_of
from textwarrant.tables import load_spread as load, materialize


@query()
def review_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.verify(load(spark, sf_dir, "benchmark"), load(spark, sf_dir, "documents").select("doc_id", "text"), "item_id", "doc_id")


@query("""select doc_id, text from documents where source = 'src0' and text <> '' order by doc_id""")
def pruned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").filter("source = 'src0' and text <> ''").select("doc_id", "text").orderBy("doc_id")


@query("""with h as (select conv_id, turn, max(case when b is null or role <> b then turn end) over (partition by conv_id order by turn) head from
  (select *, lag(role) over (partition by conv_id order by turn) b from conversations)),
c as (select conv_id, head, max(turn) covers_to from h group by all),
r as (select conv_id, min(turn) f, max(turn) l from conversations group by conv_id),
x as (select h.conv_id, head, min(turn) shown_at from h join r using (conv_id) where turn between f and l group by all)
select x.conv_id as range_id, x.head, shown_at, covers_to, md5(text) as text_md5 from x join c on c.conv_id = x.conv_id and c.head = x.head join conversations t on t.conv_id = x.conv_id and t.turn = x.head""")
def head_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of each conversation, each by the turn its speaker began with."""
    turns = load(spark, sf_dir, "conversations").withColumnsRenamed({"conv_id": "group", "turn": "place"})
    heads = sequence.carried_head(turns, "group", "place", "role")
    ranges = turns.groupBy("group").agg(F.min("place").alias("first"), F.max("place").alias("most"))
    ranges = ranges.select(F.col("group").alias("range_id"), "group", "first", F.col("most").alias("last"))
    found = review.head_lookup(ranges, heads, turns, "range_id")
    return found.select("range_id", "head", "shown_at", "covers_to", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query()
def review_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each benchmark passage: fused evidence, direct where two rankings found it, sorted by source and score."""
    posted = _posted(spark, sf_dir)
    fused = retrieve.fuse([("keyword", 0.5, bm25_of(spark, sf_dir, posted)), ("overlap", 1.0, jaccard_of(spark, sf_dir, posted))], 10)
    fused = materialize(fused, "fused")
    docs = load(spark, sf_dir, "documents").select("doc_id", F.when(F.col("source") == "src0", 1).otherwise(2).alias("level"))
    items = fused.join(docs, "doc_id").select("query_id", F.col("doc_id").alias("item_id"), "level", F.col("found_by").contains("+").alias("direct"), "score")
    return review.evidence_card(items, "query_id").select("query_id", "item_id", "level", "direct", "score", "place")


@query()
def ruling_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 hits with those of the best hit's source raised where their first line is short."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", F.substring_index("text", "\n", 1).alias("head"))
    hits = materialize(bm25_topk(spark, sf_dir), "ruling-hits").drop("rank").join(docs, "doc_id")
    raised = review.boosted(hits, "query_id", "source", F.when(F.size(words(normalize(F.col("head")))) <= 6, 1.6).otherwise(1.0))
    return retrieve.top_per_group(raised, ["query_id"], "score", "doc_id", 5).select("query_id", "doc_id", "score", "rank")
