"""Queries of answer gates, lookups, numbering and counts, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textwarrant.functions.text import normalize, words
from textwarrant.operators import gates, identity, match, numbering, sequence
from textwarrant.plans.matching import CONTAINED, RUNS
from textwarrant.plans.registry import query
from textwarrant.plans.sql import norm, word_list
from textwarrant.tables import load_spread as load


@query("""with d as (select source, doc_id, row_number() over (partition by source order by doc_id) - 1 place from documents where source is not null),
v as (select d.source, (place // 20) chunk_no, (doc_id * 7) % 25 number, quality from labels l join d using (doc_id)),
n as (select source, count(*) n from d group by source)
select v.source, v.chunk_no * 20 + v.number as place, d.doc_id, v.quality from v join n using (source) join d on d.source = v.source and d.place = v.chunk_no * 20 + v.number where v.number < least(20, n - v.chunk_no * 20)""")
def verdict_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels as verdicts on chunks of 20 documents of a source, a fifth of them out of bounds."""
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    items = load(spark, sf_dir, "documents").filter("source is not null").select("source", "doc_id", place.cast("long").alias("place"))
    verdicts = load(spark, sf_dir, "labels").join(items, "doc_id")
    verdicts = verdicts.select("source", F.floor(F.col("place") / 20).alias("chunk_no"), (F.col("doc_id") * 7 % 25).alias("number"), "quality")
    return gates.align_verdicts(verdicts, items, "source", 20).select("source", "place", "doc_id", "quality")


@query("""with s as (select doc_id, case doc_id % 4 when 0 then 'supports' when 1 then 'contradicts' when 2 then 'related' else 'unrelated' end said, quality = 1 as "all", doc_id % 3 = 0 parts, doc_id % 5 < 3 settles, toxic = 0 names from labels),
f as (select *, case when said = 'supports' and not "all" then case when parts then 'partial' else 'related' end else said end f from s)
select doc_id, case when f in ('supports', 'partial') and not names then 'related' when f = 'contradicts' and not "all" then case when settles then 'contradicts' else 'related' end when f = 'contradicts' and not names then 'related' else f end as stance from f""")
def stance_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "labels")
    kinds = F.array(*[F.lit(x) for x in ("supports", "contradicts", "related", "unrelated")])
    said = F.get(kinds, (F.col("doc_id") % 4).cast("int"))
    return rows.select("doc_id", gates.stance(said, F.col("quality") == 1, F.col("doc_id") % 3 == 0, F.col("doc_id") % 5 < 3, F.col("toxic") == 0).alias("stance"))


@query(f"""with {CONTAINED}, w as (select item_id, b.text from benchmark b),
s as (select p.item_id, p.doc_id, w.text copied, unnest(string_split(regexp_replace(d.text, '([.!?؟؛:\\n])', '\\1' || chr(1), 'g'), chr(1))) part, generate_subscripts(string_split(regexp_replace(d.text, '([.!?؟؛:\\n])', '\\1' || chr(1), 'g'), chr(1)), 1) i
 from p join w using (item_id) join documents d using (doc_id)),
f as (select item_id, doc_id, copied, arg_min(part, i) filter (contains({norm('part')}, {norm('copied')})) first from s group by all)
select item_id, doc_id, md5(trim(coalesce(first, copied))) as said_md5, first is not null as in_sentence from f""")
def passage_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each passage as the documents that hold it have it."""
    items, docs = load(spark, sf_dir, "benchmark"), load(spark, sf_dir, "documents").select("doc_id", "text")
    pairs = match.containment(items, docs, "item_id", "doc_id").select("item_id", "doc_id")
    rows = pairs.join(items.select("item_id", F.col("text").alias("copied")), "item_id").join(docs, "doc_id")
    said = gates.sentence_as_written(F.col("copied"), F.col("text"))
    crossing = normalize(said) == normalize(F.col("copied"))
    one = F.exists(F.split(F.regexp_replace("text", r"([.!?؟؛:\n])", "$1\u0001"), "\u0001"), lambda p: normalize(p).contains(normalize(F.col("copied"))))
    return rows.select("item_id", "doc_id", F.md5(said.cast("binary")).alias("said_md5"), (one | ~crossing).alias("in_sentence"))


@query("""with c as (select conv_id, coalesce(list(turn order by turn) filter (role = 'user'), []) a, coalesce(list(turn order by turn) filter (role <> 'user'), []) b from conversations group by conv_id)
select conv_id, array_to_string((a || b)[1:16], ',') as turns from c""")
def suggestion_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations")
    kind = lambda yes: F.sort_array(F.collect_list(F.when(yes, F.col("turn"))))
    rows = rows.groupBy("conv_id").agg(kind(F.col("role") == "user").alias("a"), kind(F.col("role") != "user").alias("b"))
    return rows.select("conv_id", F.array_join(gates.merge_suggestions(F.col("a"), F.col("b")), ",").alias("turns"))


@query("""with n as (select *, count(*) over (partition by conv_id) n from conversations)
select conv_id, count(distinct case when turn >= 0 and turn < n then turn end) = max(n) and count(*) = max(n) and not bool_or(coalesce(trim(text), '') = '') as complete from n group by conv_id""")
def answer_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a conversation has each turn once, and a text for each."""
    rows = load(spark, sf_dir, "conversations").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("conv_id")))
    return gates.complete(rows, "conv_id", "turn", F.col("n"), F.coalesce(F.trim("text"), F.lit("")) == "")


@query(f"""with c as (select conv_id, turn, text, trim(array_to_string(({word_list('text')})[2:6], ' ')) claim, {word_list('text')} w from conversations where text is not null),
k as (select conv_id, turn, case when turn % 3 = 0 then 'Q ' || claim else claim end claim, case when turn % 2 = 0 then 'topic' else '' end subject, text from c where claim <> ''),
f as (select *, row_number() over (partition by conv_id, {norm('claim')} order by turn, claim, subject) rn from k where contains(' ' || {norm('text')} || ' ', ' ' || {norm('claim')} || ' '))
select conv_id, turn as sentence, md5(case when subject <> '' and not contains({norm('claim')}, {norm('subject')}) then subject || ': ' || claim else claim end) as text_md5 from f where rn = 1""")
def claims_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims copied from turns; every third turn's with a word that the turn lacks."""
    rows = load(spark, sf_dir, "conversations").filter("text is not null")
    claim = F.array_join(F.slice(words(normalize(F.col("text"))), 2, 5), " ")
    claims = rows.select("conv_id", F.col("turn").alias("sentence"), F.when(claim == "", "").when(F.col("turn") % 3 == 0, F.concat(F.lit("Q "), claim)).otherwise(claim).alias("text"), F.when(F.col("turn") % 2 == 0, "topic").otherwise("").alias("subject"))
    said = rows.select("conv_id", F.col("turn").alias("sentence"), F.col("text").alias("said"))
    return gates.triaged(claims, said, "conv_id").select("conv_id", "sentence", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def _local_and_claims(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    runs = match.verbatim_runs(load(spark, sf_dir, "benchmark"), load(spark, sf_dir, "documents"), "item_id", "doc_id")
    local = runs.select("doc_id", F.col("text_start").alias("start"), (F.col("text_start") + F.col("n_words")).cast("int").alias("end"), (F.col("n_words") >= 12).alias("verified")).distinct()
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "end"))
    claims = local.filter("not verified").select("doc_id", place.alias("place"), (F.col("start") + 2).alias("start"), (F.col("end") + 3).alias("end"))
    return local, claims


@query()
def claim_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs found in documents and claims near the shorter ones, each place once."""
    local, claims = _local_and_claims(spark, sf_dir)
    return gates.merge_claims(local, claims, "doc_id")


@query("""select l_partkey, l_suppkey, min_by(l_orderkey, l_orderkey * 10 + l_linenumber) as first_order, max_by(l_orderkey, l_orderkey * 10 + l_linenumber) as last_order from lineitem group by l_partkey, l_suppkey""")
def composite_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and the last order of each part and supplier."""
    rows = load(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    keys = ["l_partkey", "l_suppkey"]
    first = identity.one_per_key(rows, keys, "at", last=False).select(*keys, F.col("l_orderkey").alias("first_order"))
    return first.join(identity.one_per_key(rows, keys, "at", last=True).select(*keys, F.col("l_orderkey").alias("last_order")), keys)


@query("select doc_id, max(doc_id) over (partition by lang, source, n_chars, text) as last_id from documents")
def identity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").withColumn("h", F.sha2(F.col("text").cast("binary"), 256))
    last = identity.identity(docs, ["lang", "source", "n_chars", "h"], "doc_id").withColumnRenamed("doc_id", "last_id")
    same = [docs[c].eqNullSafe(last[c]) for c in ("lang", "source", "n_chars", "h")]
    return docs.join(last, same[0] & same[1] & same[2] & same[3]).select("doc_id", "last_id")


@query("""with a as (select distinct o_orderkey k from orders), b as (select distinct l_orderkey k from lineitem)
select count(*) filter (a.k is not null and b.k is not null) n_both, count(*) filter (b.k is null) only_a, count(*) filter (a.k is null) only_b,
 count(*) filter (b.k is null) = 0 and count(*) filter (a.k is null) = 0 as same_keys from a full join b using (k)""")
def key_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether orders and lineitem cover the same orders."""
    return identity.complete_join(load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")), ["k"])


LEVELS = ["view", "click", "signup", "purchase", "error"]


@query(f"""with e as (select user_id, event_type, list_position({LEVELS}, event_type) p from events)
select user_id, max_by(event_type, p) filter (p is not null) as level, count(*) n from e group by user_id""")
def worst_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").groupBy("user_id").agg(identity.most_severe(F.col("event_type"), LEVELS).alias("level"), F.count(F.lit(1)).alias("n"))


@query(f"""with {CONTAINED}, m as (select item_id, count(*) filter (match_type = 'full') full_, count(*) filter (match_type = 'partial') part from p group by item_id)
select count(*) filter (full_ > 0) as merged, count(*) filter (full_ = 0 and part > 0) as partial_only, count(*) filter (m.item_id is null) as unmatched, coalesce(sum(greatest(full_ + part - 1, 0)), 0)::bigint as surplus
from benchmark left join m using (item_id)""")
def merge_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the passages met the documents."""
    items = load(spark, sf_dir, "benchmark")
    pairs = match.containment(items, load(spark, sf_dir, "documents"), "item_id", "doc_id")
    per = pairs.groupBy("item_id").agg(F.count_if(F.col("match_type") == "full").alias("f"), F.count_if(F.col("match_type") == "partial").alias("p"))
    rows = items.select("item_id").join(per, "item_id", "left")
    return rows.agg(
        F.count_if(F.col("f") > 0).alias("merged"), F.count_if((F.col("f") == 0) & (F.col("p") > 0)).alias("partial_only"),
        F.count_if(F.col("f").isNull()).alias("unmatched"), F.coalesce(F.sum(F.greatest(F.col("f") + F.col("p") - 1, F.lit(0))), F.lit(0)).alias("surplus"),
    )


@query(f"""with t as (select list_distinct({word_list('text')}) w, {word_list('lag(text) over (partition by source order by doc_id)')} b from documents where text is not null),
g as (select unnest(list_filter(w, lambda x: not list_contains(b, x))) word from t where b is not null)
select word, count(*) n from g group by word order by n desc, word limit 20""")
def common_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty words that documents most often add to their predecessors in their sources."""
    docs = load(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "source", "text")
    rows = sequence.with_predecessor(docs, "source", "doc_id").select("text", "before")
    gaps = rows.select(F.explode(F.array_except(words(normalize(F.col("text"))), words(normalize(F.col("before"))))).alias("word"))
    return gaps.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(20)


@query("""with k as (select unnest(list_filter(['type_' || event_type, case when value > 100 then 'large' end, case when value > 100 then 'large_' || event_type end, case when hour(ts) < 6 then 'night' end], lambda x: x is not null)) k from events)
select k as status, count(*) n from k group by k""")
def status_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by status and by the keys derived from it; an event may count under several."""
    large, kind = F.col("value") > 100, F.col("event_type")
    keys = F.array(F.concat(F.lit("type_"), kind), F.when(large, "large"), F.when(large, F.concat(F.lit("large_"), kind)), F.when(F.hour("ts") < 6, "night"))
    return load(spark, sf_dir, "events").select(F.explode(F.array_compact(keys)).alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {RUNS} select item_id, doc_id, text_start, n_words, n_words <= 5 as fragment from r")
def run_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of five words at most are common speech."""
    runs = match.verbatim_runs(load(spark, sf_dir, "benchmark"), load(spark, sf_dir, "documents"), "item_id", "doc_id")
    return runs.select("item_id", "doc_id", "text_start", "n_words", (F.col("n_words") <= 5).alias("fragment"))


@query("""with e as (select user_id, list((event_id * 5) % 9 order by ts, event_id) n from events group by user_id),
f as (select user_id, list_reduce(list_prepend(0::bigint, n), lambda s, x: case when x > s % 1000 and x <= case when s % 1000 = 0 then 2 else s % 1000 + 3 end then (s // 1000 + 1) * 1000 + x else s end) s from e)
select user_id, (s // 1000)::int n_accepted, (s % 1000)::int as last from f""")
def monotone_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in order of time; those that continue the count."""
    rows = load(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id"))).alias("e"))
    rows = rows.select("user_id", numbering.accepted_numbers(F.transform("e", lambda e: e["event_id"] * 5 % 9)).alias("k"))
    return rows.select("user_id", F.size("k").alias("n_accepted"), F.coalesce(F.element_at("k", F.when(F.size("k") > 0, F.lit(-1))), F.lit(0)).alias("last"))


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 i from documents where text is not null),
n as (select doc_id, i, case when i % 4 = 3 then line else (i + 1) || ' - ' || line end line from l),
p as (select doc_id, i, (sum(length(line) + 1) over (partition by doc_id order by i) - length(line) - 1)::int as start, (sum(length(line) + 1) over (partition by doc_id) - 1)::int as size from n)
select doc_id, (i + 1)::int as number, start, coalesce(lead(start) over (partition by doc_id order by i), size) as "end", '' as heading from p where i % 4 <> 3""")
def numbered_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose lines are numbered, each fourth number lost, parted at the numbers."""
    line = lambda x, i: F.when(i % 4 == 3, x).otherwise(F.concat((i + 1).cast("string"), F.lit(" - "), x))
    docs = load(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))
    return numbering.numbered_parts(docs, r"(?<![^\n])(\d{1,9}) - ")


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 i from documents),
t as (select doc_id, i, trim(line) line, lead(i) over (partition by doc_id order by i) is not null followed from l where trim(line) <> ''),
k as (select *, case when length(line) <= 90 and followed then case when line like '%:' or len(regexp_split_to_array(line, ' +')) > 6 then 'section' else 'entry' end else 'body' end kind from t),
c as (select doc_id, i, line, kind, last_value(case when kind = 'entry' then regexp_replace(line, ':+$', '') end ignore nulls) over w entry, last_value(case when kind = 'section' then regexp_replace(line, ':+$', '') end ignore nulls) over w named,
 last_value(case when kind = 'entry' then i end ignore nulls) over w ei, last_value(case when kind = 'section' then i end ignore nulls) over w si from k window w as (partition by doc_id order by i rows unbounded preceding))
select doc_id, i::int as i, md5(line) as line_md5, entry, case when si > ei then named else '' end as section from c where kind = 'body' and entry is not null""")
def headed_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    found = numbering.under_headings(lines, "doc_id")
    return found.select("doc_id", "i", F.md5(F.col("line").cast("binary")).alias("line_md5"), "entry", "section")


@query("""with r as (select source, list(distinct lang) filter (lang is not null) langs from documents join labels using (doc_id) where quality = 1 group by source)
select doc_id, case when lang is null then null when langs is null or len(langs) = 0 then 'not_reported' when list_contains(langs, lang) then 'matches' else 'differs' end as attribution from documents left join r using (source)""")
def attribution_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the good documents of a document's source are of its language."""
    docs = load(spark, sf_dir, "documents")
    good = docs.join(load(spark, sf_dir, "labels").filter("quality = 1"), "doc_id").groupBy("source").agg(F.collect_set("lang").alias("langs"))
    return docs.join(good, "source", "left").select("doc_id", gates.attribution(F.col("lang"), F.col("langs")).alias("attribution"))


@query("""select source, string_agg(doc_id || ' ' || coalesce(lang, '-') || ' ' || coalesce(n_chars, 0), chr(10) order by doc_id) as report from documents where source is not null group by source""")
def plain_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line a document, one text a source."""
    line = F.concat_ws(" ", F.col("doc_id"), F.coalesce("lang", F.lit("-")), F.coalesce("n_chars", F.lit(0)))
    rows = load(spark, sf_dir, "documents").filter("source is not null").select("source", F.struct("doc_id", line.alias("line")).alias("x"))
    rows = rows.groupBy("source").agg(F.sort_array(F.collect_list("x")).alias("all"))
    return rows.select("source", F.array_join(F.transform("all", lambda x: x["line"]), "\n").alias("report"))
