"""Queries over spans, parsed texts, aligned texts, state and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarrant.functions import fuzzy, parse
from textwarrant.functions.text import normalize, sentence_spans, token_spans, words
from textwarrant.operators import match, retrieve, review, spans
from textwarrant.plans.matching import RUNS, verbatim_runs
from textwarrant.plans.registry import query
from textwarrant.plans.retrieval import _posted, _query_terms
from textwarrant.sources import resume
from textwarrant.streaming import stateful
from textwarrant.tables import delete_at_exit, fresh_path
from textwarrant.tables import load_spread as load


@query()
def sentences_without_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of the documents, less the stretches that quote a benchmark passage."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    sentences = docs.select("doc_id", F.posexplode(sentence_spans(F.col("text"))).alias("i", "s")).select("doc_id", "i", "s.start", "s.end")
    runs = match.greedy_runs(verbatim_runs(spark, sf_dir), "doc_id")
    tokens = docs.join(runs.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", token_spans(F.col("text")).alias("w"))
    quotes = runs.join(tokens, "doc_id").select("doc_id", F.col("w")[F.col("text_start")]["start"].alias("start"), F.col("w")[F.col("text_start") + F.col("n_words") - 1]["end"].alias("end"))
    return spans.subtract(sentences, quotes, ["doc_id"], ["i"]).select("doc_id", "i", "whole", "start", "end")


@query(f"""with {RUNS}, k as (select doc_id, i * 30 as start, least(i * 30 + 30, len(w)) as "end" from dw, unnest(range((len(w) + 29) // 30)) t(i))
select doc_id, start::int as start, "end"::int as "end" from k where not exists (select 1 from r where r.doc_id = k.doc_id
 and least("end", text_start + n_words) - greatest(start, text_start) > 0 and least("end", text_start + n_words) - greatest(start, text_start) >= ("end" - start) * 0.5)""")
def span_suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 30 words of each document that no quoted run covers by half."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.size(words(normalize(F.col("text")))).alias("n"))
    passages = docs.filter("n > 0").select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 30).cast("int"))).alias("k"))
    passages = passages.select("doc_id", (F.col("k") * 30).alias("start"), F.least(F.col("k") * 30 + 30, F.col("n")).alias("end"))
    runs = verbatim_runs(spark, sf_dir).select("doc_id", F.col("text_start").alias("start"), (F.col("text_start") + F.col("n_words")).alias("end"))
    return spans.suppress(passages, runs, ["doc_id"], 0.5)


@query(r"""select page_id, md5(trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&copy;', chr(169)), '&middot;', chr(183)), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) as text_md5 from pages""")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", F.md5(parse.html_text(F.col("html")).cast("binary")).alias("text_md5"))


@query("select doc_id, upper(substr(sha256(text), 1, 32)) as fingerprint from documents")
def text_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.hex(parse.fingerprint(F.col("text"))).alias("fingerprint"))


@query("select doc_id, upper(substr(sha256(text), 1, 32)) as fingerprint from documents")
def resumed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, written in batches over an earlier state that lacked a source."""
    path = fresh_path(spark, "resumed")
    delete_at_exit(spark, path)
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "source")
    make = lambda rows: rows.select("doc_id", "batch", F.hex(parse.fingerprint(F.col("text"))).alias("fingerprint"))
    resume.write_batches(docs.filter("source is null or source <> 'src0'"), path, "source", make, batches=16, at_once=8)
    resume.write_batches(docs, path, "source", make, batches=16, at_once=8)
    return resume.read_batches(spark, path).drop("batch")


@query()
def fuzzy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark passage's most similar document of its ten by overlap."""
    top = retrieve.jaccard_best(_query_terms(spark, sf_dir), _posted(spark, sf_dir), 10).select("query_id", "doc_id")
    items = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), normalize(F.col("text")).alias("a"))
    docs = load(spark, sf_dir, "documents").select("doc_id", normalize(F.col("text")).alias("b"))
    return review.most_similar(top, items, docs, "query_id", "doc_id").select("query_id", "doc_id", "score")


@query()
def ordered_wording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each passage's words, weighted by idf, that its best documents hold in order."""
    posted = _posted(spark, sf_dir)
    tf = retrieve.each_term(posted)
    n = F.broadcast(posted.agg(F.count(F.lit(1)).alias("n")))
    top = retrieve.jaccard_best(_query_terms(spark, sf_dir), posted, 25).select("query_id", "doc_id")
    items = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.posexplode(words(normalize(F.col("text")))).alias("i", "term"))
    idf = items.join(retrieve.document_frequency(tf), "term", "left").join(n).select("query_id", "i", "term", retrieve.overlap_idf(F.col("n"), F.col("df")).alias("w"))
    quotes = idf.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("i", "term", "w"))).alias("q"))
    quotes = quotes.select("query_id", F.transform("q", lambda x: x["term"]).alias("terms"), F.transform("q", lambda x: x["w"]).alias("weights"))
    docs = load(spark, sf_dir, "documents").select("doc_id", words(normalize(F.col("text"))).alias("d"))
    scored = top.join(quotes, "query_id").join(docs, "doc_id").select("query_id", "doc_id", F.round(fuzzy.ordered_share(F.col("terms"), F.col("d"), F.col("weights")), 6).alias("share"))
    return retrieve.top_per_group(scored, ["query_id"], "share", "doc_id", 1).drop("rank")


def _seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    return events.select("user_id", "event_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))


@query()
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.rate_limit(_seconds(spark, sf_dir), "user_id", "at", "event_id", limit=3, window=86400.0)


@query("""with e as (select user_id, event_id, epoch_us(ts) / 1e6 t, row_number() over (partition by user_id order by ts, event_id) - 1 i from events)
select user_id, event_id, round(i * (60.0 / 0.001) + max(t - i * (60.0 / 0.001)) over (partition by user_id order by t, event_id rows unbounded preceding), 6) as slot from e""")
def paced_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.paced_slots(_seconds(spark, sf_dir), "user_id", "at", "event_id", F.lit(0.001))


@query()
def ttl_memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.remembered(_seconds(spark, sf_dir), "user_id", "at", "event_id", "event_type", ttl=6 * 3600.0, most=3)


@query()
def anchored_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.anchored_refresh(_seconds(spark, sf_dir), "user_id", "at", "event_id", keep=86400.0)


@query("""with p as (select l.doc_id, quality, toxic, d.n_chars >= 200 as predicted, d.lang from labels l join documents d using (doc_id))
select lang, count(*) n, count(*) filter (predicted and quality = 1) tp, count(*) filter (predicted and quality = 0) fp, count(*) filter (not predicted and quality = 1) fn,
 round(count(*) filter (predicted = (quality = 1)) / count(*), 6) accuracy from p group by lang""")
def eval_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a rule of thumb (200 characters or more) agrees with the quality labels, per language."""
    joined = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    said, good = F.col("n_chars") >= 200, F.col("quality") == 1
    return joined.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(said & good).alias("tp"), F.count_if(said & ~good).alias("fp"), F.count_if(~said & good).alias("fn"),
        F.round(F.count_if(said == good) / F.count(F.lit(1)), 6).alias("accuracy"),
    )


@query("""select event_type, count(*) n, (count(*) filter (value > 100))::bigint n_large, round(sum(value), 4) total from events group by event_type""")
def status_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 100).alias("n_large"), F.round(F.sum("value"), 4).alias("total"))
