"""Queries that rank texts and vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarrant.functions.text import normalize, words
from textwarrant.operators import retrieve, review
from textwarrant.plans.registry import query
from textwarrant.plans.sql import BM25, JACCARD, TF, norm, word_list
from textwarrant.tables import load_spread as load, materialize


def _posted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts' terms, a row for each text, written once for all that a query asks of them."""
    return materialize(retrieve.postings(load(spark, sf_dir, "documents"), "doc_id", F.col("text")), "postings")


def _tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The term table."""
    return retrieve.each_term(_posted(spark, sf_dir))


def _query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.terms(load(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id"), "query_id", F.col("text")).select("query_id", "term")


@query(f"with {TF} select term, df, round(ln(1 + n / df), 6) as idf, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) as bm25_idf from df, n")
def term_df_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    tf = _tf(spark, sf_dir)
    n = F.broadcast(tf.select("doc_id").distinct().agg(F.count(F.lit(1)).alias("n")))
    df = retrieve.document_frequency(tf).join(n)
    return df.select("term", "df", F.round(retrieve.overlap_idf(F.col("n"), F.col("df")), 6).alias("idf"), F.round(retrieve.bm25_idf(F.col("n"), F.col("df")), 6).alias("bm25_idf"))


@query(f"with {TF} select doc_id, round(sum(ln(1 + n / df)), 6) as weight, count(*) as n_terms from tf join df using (term), n group by doc_id")
def entry_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    posted = _posted(spark, sf_dir)
    tf = posted.select("doc_id", F.explode("terms").alias("term"))
    n = F.broadcast(posted.agg(F.count(F.lit(1)).alias("n")))
    idf = retrieve.document_frequency(tf).join(n).select("term", retrieve.overlap_idf(F.col("n"), F.col("df")).alias("idf"))
    return tf.join(idf, "term").groupBy("doc_id").agg(F.round(F.sum("idf"), 6).alias("weight"), F.count(F.lit(1)).alias("n_terms"))


@query(f"""with {TF}, q as (select item_id, unnest({word_list('text')}) term from benchmark),
i as (select item_id, coalesce(ln(1 + n / df), ln(1 + n)) idf from q left join df using (term), n),
a as (select item_id, list_sort(list(idf), 'DESC') l, sum(idf) total from i group by item_id)
select item_id, round(l[2], 6) as second_idf, round(total, 6) as total_idf, l[2] >= 4.0 and total >= 12.0 as distinctive, l[2] >= 5.5 and total >= 18.0 as strictly from a where len(l) >= 2""")
def distinctive_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    tf = _tf(spark, sf_dir)
    n = F.broadcast(tf.select("doc_id").distinct().agg(F.count(F.lit(1)).alias("n")))
    items = retrieve.terms(load(spark, sf_dir, "benchmark"), "item_id", F.col("text"))
    idf = items.join(retrieve.document_frequency(tf), "term", "left").join(n)
    idf = idf.select("item_id", "tf", retrieve.overlap_idf(F.col("n"), F.col("df")).alias("idf"))
    # each occurrence counts
    idf = idf.select("item_id", F.explode(F.array_repeat("idf", F.col("tf"))).alias("idf"))
    held = idf.groupBy("item_id").agg(F.sort_array(F.collect_list("idf"), asc=False).alias("l"), F.sum("idf").alias("total")).filter(F.size("l") >= 2)
    second = F.col("l")[1]
    return held.select(
        "item_id", F.round(second, 6).alias("second_idf"), F.round("total", 6).alias("total_idf"),
        ((second >= 4.0) & (F.col("total") >= 12.0)).alias("distinctive"), ((second >= 5.5) & (F.col("total") >= 18.0)).alias("strictly"),
    )


@query(f"with {TF}, {JACCARD} select query_id, doc_id, score, rank::int as rank from ja")
def jaccard_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_of(spark, sf_dir, _posted(spark, sf_dir))


def jaccard_of(spark: SparkSession, sf_dir: str, posted: DataFrame) -> DataFrame:
    return retrieve.jaccard_best(_query_terms(spark, sf_dir), posted).select("query_id", "doc_id", "score", "rank")


@query(f"with {TF}, {BM25} select query_id, doc_id, score, n_terms, rank::int as rank from bm")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_of(spark, sf_dir, _posted(spark, sf_dir))


def bm25_of(spark: SparkSession, sf_dir: str, posted: DataFrame) -> DataFrame:
    asked = retrieve.weighted_query(_query_terms(spark, sf_dir))
    scored = retrieve.bm25_best(asked, posted, 10, 0.4).filter("score >= 4")
    return retrieve.top_per_group(scored, ["query_id"], "score", "doc_id", 10).select("query_id", "doc_id", "score", "n_terms", "rank")


@query(f"with {TF}, {BM25}, {JACCARD}, fu as (select query_id, doc_id, 0.5 / (60 + rank) part, 'keyword' by_ from bm union all select query_id, doc_id, 1.0 / (60 + rank), 'overlap' from ja),"
       " f as (select query_id, doc_id, round(sum(part), 9) score, array_to_string(list_sort(list(by_)), '+') found_by from fu group by all)"
       " select query_id, doc_id, score, found_by, rank::int as rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) rank from f) where rank <= 10")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    posted = _posted(spark, sf_dir)
    return retrieve.fuse([("keyword", 0.5, bm25_of(spark, sf_dir, posted)), ("overlap", 1.0, jaccard_of(spark, sf_dir, posted))], 10).select("query_id", "doc_id", "score", "found_by", "rank")


FIELDS = f"""h as (select doc_id, unnest({word_list("split_part(text, chr(10), 1)")}) term from documents), hf as (select doc_id, term, count(*) tf from h group by all),
t as (select doc_id, unnest({word_list("text")}) term from documents), tf as (select doc_id, term, count(*) tf from t group by all),
qt as (select distinct item_id query_id, unnest({word_list('text')}) term from benchmark),
q as (select query_id, count(*) held from qt group by query_id)"""


def _field(name: str, share: float) -> str:
    return f"""{name}l as (select doc_id, sum(tf) dl from {name} group by doc_id), {name}n as (select count(*) n, avg(dl) mean from {name}l), {name}d as (select term, count(*) df from {name} group by term),
{name}s as (select query_id, x.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) score, list(qt.term) held
  from qt join {name}d d using (term), {name}n, {name} x, {name}l l where x.term = qt.term and l.doc_id = x.doc_id and df <= n * {share} group by all)"""


TWO_FIELDS = f"""{FIELDS}, {_field('tf', 0.25)}, {_field('hf', 1.0)},
j as (select coalesce(a.query_id, b.query_id) query_id, coalesce(a.doc_id, b.doc_id) doc_id, coalesce(a.score, 0) + 2.0 * coalesce(b.score, 0) score,
      len(list_distinct(list_concat(coalesce(a.held, []), coalesce(b.held, [])))) n from tfs a full join hfs b on a.query_id = b.query_id and a.doc_id = b.doc_id),
s as (select query_id, doc_id, round(score * n / held, 9) score, n / held share from j join q using (query_id))"""


@query(f"""with {TWO_FIELDS}
select query_id, doc_id, score, rank::int as rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) rank from s) where rank <= 5""")
def two_field_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text and its heading, its first line here, which weighs double."""
    return retrieve.top_per_group(two_fields(spark, sf_dir, 5), ["query_id"], "score", "doc_id", 5).select("query_id", "doc_id", "score", "rank")


def two_fields(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """(query_id, doc_id, score, share): every hit that can be among a query's ``k`` best, and the share of the query's words that it holds."""
    docs = load(spark, sf_dir, "documents")
    asked = materialize(_query_terms(spark, sf_dir), "asked")
    held = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("held"))
    asked = retrieve.weighted_query(asked)
    bodies = materialize(retrieve.postings(docs, "doc_id", F.col("text")), "postings-body")
    heads = materialize(retrieve.postings(docs, "doc_id", F.substring_index("text", "\n", 1)), "postings-head")
    of_body, body_mean = retrieve.usable_terms(asked, bodies, 0.25)
    of_head, head_mean = retrieve.usable_terms(asked, heads, 1.0)
    pairs = of_body.select("query_id", "term", F.col("idf").alias("body")).join(of_head.select("query_id", "term", F.col("idf").alias("head")), ["query_id", "term"], "full")
    pairs = materialize(pairs.select("query_id", "term", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("body", "head")]), "two-field-terms")
    # a text without a heading's word has none of it
    named = heads.select(F.col("doc_id").alias("_id"), F.struct("terms", "tfs", "dl").alias("head"))
    rows = bodies.select("doc_id", F.struct("terms", "tfs", "dl").alias("body")).join(named, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    none = F.struct(F.array().cast("array<string>").alias("terms"), F.array().cast("array<int>").alias("tfs"), F.lit(0).cast("long").alias("dl"))
    rows = rows.select("doc_id", "body", F.coalesce("head", none).alias("head"))

    def score(asked, texts):
        total, keys, many = 0.0, [], len(texts)
        for name, mean, factor in (("body", body_mean, 1.0), ("head", head_mean, 2.0)):
            terms, tfs, dl = texts.column(texts.schema.get_field_index(name)).flatten()
            text, place, pair = asked.met(terms)
            weight = asked.weights[name][pair]
            # a weight of 0 is a term that the field doesn't use
            text, place, pair, weight = (x[weight > 0] for x in (text, place, pair, weight))
            part = weight * retrieve.bm25_part(tfs.flatten().to_numpy()[place], dl.to_numpy()[text], mean)
            total = total + factor * asked.summed(text, pair, part, many)
            keys.append(text * len(asked.query) + pair)
        key = np.unique(np.concatenate(keys))
        n = asked.summed(key // len(asked.query), key % len(asked.query), None, many)
        return total * n / asked.whole["held"], n

    found = retrieve.best_of_texts(rows, pairs, score, k, held)
    return found.join(held, "query_id").select("query_id", "doc_id", retrieve.rounded(F.col("score")).alias("score"), (F.col("n") / F.col("held")).alias("share"))


DENIAL = "(^|[^a-z])(not|no|nicht|pas)([^a-z]|$)"


@query(f"""with {TWO_FIELDS},
p as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) r from s) where r <= 24),
g as (select p.*, text, source, first_value(source) over (partition by query_id order by score desc, doc_id) best from p join documents d using (doc_id)),
b as (select query_id, doc_id, share, round(score * case when source is distinct from best then 1.0 else
      (case when len({word_list("split_part(text, chr(10), 1)")}) <= 6 then 1.6 else 1.0 end)::double * (case when regexp_matches(lower(left(text, 400)), '{DENIAL}') then 1.25 else 1.0 end)::double end, 9) score from g),
k as (select *, row_number() over (partition by query_id order by score desc, doc_id) rank from b qualify rank <= 3),
f as (select query_id, count(*) n_shown, arg_min(doc_id, rank) doc_id from k where share >= 0.6 and exists (select 1 from hf join qt using (term) where hf.doc_id = k.doc_id and qt.query_id = k.query_id) group by query_id),
l as (select doc_id, max(quality) quality from labels group by doc_id)
select q.query_id, coalesce(n_shown, 0)::bigint as n_shown, f.doc_id, case when f.doc_id is null then 'not_found' when quality = 1 then 'reported' when quality = 0 then 'disputed' else 'found_no_marker' end as status
from q left join f using (query_id) left join l on l.doc_id = f.doc_id""")
def keyword_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the passages of a source say of a benchmark text by keywords: hits with a short first line or a denial near their start come first."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "text")
    quality = load(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    head = F.substring_index("text", "\n", 1)
    found = materialize(two_fields(spark, sf_dir, 24), "two-fields")
    hits = retrieve.top_per_group(found, ["query_id"], "score", "doc_id", 24).drop("rank").join(docs, "doc_id").join(quality, "doc_id", "left")
    short = F.when(F.size(words(normalize(head))) <= 6, 1.6).otherwise(1.0)
    denies = F.when(F.lower(F.substring("text", 1, 400)).rlike(DENIAL), 1.25).otherwise(1.0)
    status = F.when(F.col("quality") == 1, "reported").when(F.col("quality") == 0, "disputed").otherwise("found_no_marker")
    return review.keyword_check(hits, _query_terms(spark, sf_dir), retrieve.terms(docs, "doc_id", head), "source", short * denies, status)


@query("""with q as (select vec_id query_id, embedding v from embeddings where vec_id % 100 = 0),
s as (select query_id, vec_id, label, round(list_sum(list_transform(list_zip(v, embedding), lambda x: x[1]::double * x[2]::double)), 9) score from q, embeddings)
select query_id, label, vec_id, round(score, 6) as score, rank::int as rank from (select *, row_number() over (partition by query_id, label order by score desc, vec_id) rank from s) where rank <= 5""")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings")
    asked = vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = retrieve.dense_topk(asked, vectors, 5, "label")
    return found.select("query_id", "label", "vec_id", F.round("score", 6).alias("score"), "rank")


@query("""with m as (select vec_id, embedding, list_max(list_transform(embedding, lambda x: abs(x::double))) most from embeddings),
q as (select vec_id, embedding, most, list_transform(embedding, lambda x: round_even(x::double / most * 127, 0)) q from m)
select vec_id, list_sum(q)::bigint as q_sum, round(list_max(list_transform(list_zip(embedding, q), lambda x: abs(x[1]::double - x[2] * most / 127))), 6) as worst from q""")
def quantize_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings").select("vec_id", "embedding", retrieve.quantize(F.col("embedding")).alias("q"))
    off = F.array_max(F.zip_with("embedding", retrieve.dequantize(F.col("q")), lambda a, b: F.abs(a.cast("double") - b)))
    return rows.select("vec_id", F.aggregate(F.col("q.q"), F.lit(0).cast("long"), lambda s, x: s + x).alias("q_sum"), F.round(off, 6).alias("worst"))
