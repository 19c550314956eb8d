"""Queries over rows in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarrant.functions.text import chunks
from textwarrant.operators import retrieve, sequence
from textwarrant.plans.registry import query
from textwarrant.plans.retrieval import _posted, _query_terms, bm25_of
from textwarrant.plans.sql import BM25, TF, word_list
from textwarrant.tables import load_spread as load, materialize


@query("""with w as (select a.conv_id, a.turn as first, b.turn as last, count(*) n, string_agg(c.text, ' ' order by c.turn) as text
 from conversations a join conversations b on a.conv_id = b.conv_id and b.turn between a.turn + 1 and a.turn + 4 join conversations c on c.conv_id = a.conv_id and c.turn between a.turn and b.turn group by 1, 2, 3)
select conv_id, first, last, n::int as n, md5(text) as text_md5 from w where n = last - first + 1""")
def turn_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sequence.consecutive_windows(load(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    return found.select("conv_id", "first", "last", "n", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("select conv_id, turn, coalesce(sum(length(text) + 1) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0)::bigint as \"offset\" from conversations")
def running_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.running_offset(load(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query("""with a as (select conv_id, turn, role, lag(role) over (partition by conv_id order by turn) before from conversations)
select conv_id, turn, max(case when before is null or role <> before then turn end) over (partition by conv_id order by turn) as head from a""")
def locf_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.carried_head(load(spark, sf_dir, "conversations"), "conv_id", "turn", "role")


@query("""select l.user_id, l.event_id, r.event_id as last_click from (select * from events where event_type <> 'click') l
 asof left join (select user_id, ts, max(event_id) event_id from events where event_type = 'click' group by all) r on l.user_id = r.user_id and l.ts >= r.ts""")
def as_of_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    clicks = events.filter("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("last_click"))
    return sequence.as_of(events.filter("event_type <> 'click'"), clicks, "user_id", "ts", "event_id", "last_click").select("user_id", "event_id", "last_click")


@query("select doc_id, (i + 1)::int as chunk, length(c)::int as n_chars, md5(c) as chunk_md5 from (select doc_id, i, substr(text, (i * 2000 + 1)::bigint, 2000) c from documents, unnest(range((length(text) + 1999) // 2000)) t(i))")
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunks(F.col("text"), 2000)).alias("i", "c"))
    return rows.select("doc_id", (F.col("i") + 1).alias("chunk"), F.length("c").alias("n_chars"), F.md5(F.col("c").cast("binary")).alias("chunk_md5"))


@query("""with r as (select *, row_number() over (partition by source order by n_chars desc, doc_id) rn, count(*) over (partition by source) c from documents)
select source, doc_id, rn::int as rn, greatest(c - 8, 0) as skipped from r where rn <= 8""")
def first_of_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return sequence.first_n(rows, "source", [F.desc("n_chars"), "doc_id"], 8).select("source", "doc_id", "rn", "skipped")


@query(f"""with {TF}, {BM25}, top as (select query_id, doc_id from bm where rank <= 3),
ti as (select top.query_id, top.doc_id, qt.term, ln(1 + (n - df + 0.5) / (df + 0.5)) weight from top join qt using (query_id) join df using (term), n),
dw as (select doc_id, {word_list('text')} w from documents where doc_id in (select doc_id from top)),
p as (select doc_id, i - 1 as i, w[i] term, len(w) n from dw, unnest(range(1, len(w) + 1)) t(i)),
h as (select query_id, p.doc_id, i, weight from p join ti using (doc_id, term)),
st as (select top.query_id, top.doc_id, i as start, n from top join p using (doc_id) where i <= greatest(n - 45, 0)),
su as (select st.query_id, st.doc_id, start, n, round(sum(weight), 9) weight from st join h on h.query_id = st.query_id and h.doc_id = st.doc_id and h.i between start and start + 44 group by all),
be as (select *, row_number() over (partition by query_id, doc_id order by weight desc, start) rn from su)
select query_id, be.doc_id, start::int as start, round(weight, 6) as weight, md5(array_to_string(w[start + 1:start + 45], ' ')) as excerpt_md5, start > 0 as more_before, start + 45 < len(w) as more_after from be join dw using (doc_id) where rn = 1""")
def best_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    posted = _posted(spark, sf_dir)
    tf = retrieve.each_term(posted)
    asked = _query_terms(spark, sf_dir)
    top = materialize(bm25_of(spark, sf_dir, posted).filter("rank <= 3").select("query_id", "doc_id"), "excerpt-pairs")
    n = F.broadcast(posted.agg(F.count(F.lit(1)).alias("n")))
    idf = retrieve.document_frequency(tf).join(n).select("term", retrieve.bm25_idf(F.col("n"), F.col("df")).alias("weight"))
    hits = top.join(asked, "query_id").join(idf, "term")
    docs = load(spark, sf_dir, "documents").join(top.select("doc_id").distinct(), "doc_id", "left_semi")
    found = sequence.best_excerpt(docs, hits, "doc_id", "query_id")
    return found.select("query_id", "doc_id", "start", F.round("weight", 6).alias("weight"), F.md5(F.col("excerpt").cast("binary")).alias("excerpt_md5"), "more_before", "more_after")
