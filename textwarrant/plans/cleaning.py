"""Queries of cleaning, trimming and scoring, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textwarrant.functions import clean
from textwarrant.functions.text import normalize, words
from textwarrant.operators import sequence
from textwarrant.plans.registry import query
from textwarrant.plans.sql import word_list
from textwarrant.tables import load_spread as load

SPACE = r"[ \t\r\n\f\v]+"


def _texts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return load(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "text", *columns)


@query(rf"""select doc_id, md5(regexp_replace(text, '{clean.SECRETS}', '[redacted]', 'g')) as text_md5, len(regexp_extract_all(text, '{clean.SECRETS}'))::int as n_secrets from documents where text is not null""")
def secret_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _texts(spark, sf_dir)
    return rows.select("doc_id", F.md5(clean.redact(F.col("text")).cast("binary")).alias("text_md5"), F.regexp_count("text", F.lit(clean.SECRETS)).alias("n_secrets"))


@query(rf"""select doc_id, md5(trim(regexp_replace(regexp_replace(text, '{clean.DIRECTION}', '', 'g'), '{SPACE}', ' ', 'g'))) as text_md5 from documents where text is not null""")
def one_line_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", F.md5(clean.one_line(F.col("text")).cast("binary")).alias("text_md5"))


@query(rf"""select doc_id, md5(left(array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(text, '{clean.MARKS}', '', 'g'), '{SPACE}', ' ', 'g')), ' '), lambda w: w <> '')[1:200], ' '), 1500)) as text_md5
from documents where text is not null""")
def embedded_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", F.md5(clean.as_embedded(F.col("text")).cast("binary")).alias("text_md5"))


@query("""with v as (select vec_id, list_transform(embedding[1:16], lambda x: x::double) v from embeddings), n as (select vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) n from v)
select vec_id, len(v)::int n_dims, round(v[1] / n, 6) as first, round(list_sum(list_transform(v, lambda x: x / n)), 6) as total from n""")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings").select("vec_id", clean.unit(F.col("embedding"), 16).alias("v"))
    return rows.select("vec_id", F.size("v").alias("n_dims"), F.round(F.col("v")[0], 6).alias("first"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("""select event_id, md5('{"event_type":"' || event_type || '","user_id":' || user_id || '}') as key_md5 from events""")
def call_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    key = clean.argument_key({"user_id": F.col("user_id"), "event_type": F.col("event_type"), "api_key": F.col("ts").cast("string")})
    return events.select("event_id", F.md5(key.cast("binary")).alias("key_md5"))


@query(rf"""with t as (select doc_id, text, list_filter(regexp_split_to_array(text, '{SPACE}'), lambda w: w <> '') w from documents where text is not null),
s as (select doc_id, len(list_filter(w, lambda x: length(x) = 1)) / greatest(len(w), 1) single,
 len(regexp_extract_all(text, '[\x{{0100}}-\x{{024F}}\x{{1E00}}-\x{{1EFF}}\x{{E000}}-\x{{F8FF}}\x{{FFFD}}]')) / greatest(length(text), 1) stray,
 len(regexp_extract_all(text, '[\x{{0600}}-\x{{06FF}}]')) >= 80 or len(regexp_extract_all(text, '[A-Za-z]')) >= 40 enough from t)
select doc_id, round(single, 6) as single, round(stray, 6) as stray, enough and single < 0.35 and stray < 0.01 as trusted from s""")
def layer_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _texts(spark, sf_dir).select("doc_id", clean.layer_quality(F.col("text")).alias("q"))
    return rows.select("doc_id", F.round("q.single", 6).alias("single"), F.round("q.stray", 6).alias("stray"), "q.trusted")


FOLD = rf"regexp_replace(translate(regexp_replace(lower(%s), '{clean.MARKS}', '', 'g'), '{clean.LIGHT[0]}', '{clean.LIGHT[1]}'), '[^\p{{L}}]', ' ', 'g')"


@query(f"""with t as (select doc_id, text, lag(text) over (partition by source order by doc_id) before from documents where text is not null),
w as (select doc_id, list_filter(string_split({FOLD % 'before'}, ' '), lambda x: length(x) > 1) q, list_distinct(list_filter(string_split({FOLD % 'text'}, ' '), lambda x: x <> '')) t from t where before is not null)
select doc_id, round(case when len(q) = 0 then 0.0 else len(list_filter(q, lambda x: list_contains(t, x) or list_contains(t, regexp_replace(x, '^(و|ف|ب|ل|ال)', '')) or list_contains(t, 'ال' || x)))::double / len(q) end, 6) as score from w""")
def wording_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each document's predecessor in its source that it holds."""
    folded = _texts(spark, sf_dir, "source").withColumn("text", clean.light_fold(F.col("text")))
    rows = sequence.with_predecessor(folded, "source", "doc_id")
    return rows.select("doc_id", F.round(clean.folded_score(F.col("before"), F.col("text")), 6).alias("score"))


@query(f"""with w as (select doc_id, {word_list('text')} h from documents where text is not null), q as (select doc_id, h, list_transform(h[5:12], lambda x, i: case when i % 3 = 0 then '?' else x end) q from w),
s as (select doc_id, len(q) n, place, list_sum(list_transform(q, lambda x, j: (h[place + j] = x)::int))::int hits from q, unnest(range(len(h) - len(q) + 1)) r(place) where len(q) > 0 and len(h) > len(q) + 2),
b as (select *, row_number() over (partition by doc_id order by hits desc, place) rn from s)
select doc_id, place::int as place, hits from b where rn = 1 and hits * 2 >= n""")
def best_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a document's fifth to twelfth word, a third of them altered, agree with it best."""
    rows = _texts(spark, sf_dir).select("doc_id", words(normalize(F.col("text"))).alias("h"))
    quote = F.transform(F.slice("h", 5, 8), lambda w, i: F.when((i + 1) % 3 == 0, "?").otherwise(w))
    rows = rows.select("doc_id", clean.best_slice(F.col("h"), quote).alias("b")).filter("b is not null")
    return rows.select("doc_id", F.col("b.at").alias("place"), "b.hits")


@query(f"""with w as (select conv_id, turn, role, text, list_filter(string_split(text, ' '), lambda x: x <> '') w, turn = min(turn) over (partition by conv_id) and conv_id not in (1, 9) opens from conversations where text is not null)
select conv_id, turn, md5(case when opens and len(w) > 4 then array_to_string(w[5:], ' ') else text end) as text_md5, opens and len(w) <= 4 as short from w""")
def stripped_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first turn of each conversation but two without its first four words."""
    rows = load(spark, sf_dir, "conversations").filter("text is not null")
    opens = (F.col("turn") == F.min("turn").over(Window.partitionBy("conv_id"))) & ~F.col("conv_id").isin(1, 9)
    rows = rows.withColumn("opens", opens).withColumn("cut", clean.without_opening(F.col("text"), F.col("opens"), 4))
    return rows.select("conv_id", "turn", F.md5(F.col("cut.text").cast("binary")).alias("text_md5"), "cut.short")


@query(r"""select doc_id, md5(trim(regexp_replace(text, '(\s*[\[(][^\[\]()]*[\])])+\s*$', ''))) as text_md5, concat_ws(', ', nullif(trim(source), ''), nullif(trim(lang), ''), doc_id::varchar) as cite from documents where text is not null""")
def remark_trims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _texts(spark, sf_dir, "source", "lang")
    return rows.select("doc_id", F.md5(clean.without_remarks(F.col("text")).cast("binary")).alias("text_md5"), clean.citation(F.col("source"), F.col("lang"), F.col("doc_id")).alias("cite"))


@query(f"""with t as (select doc_id, {word_list('text')} w, {word_list('lag(text) over (partition by source order by doc_id)')} b from documents where text is not null)
select doc_id, len(list_distinct(list_filter(w, lambda x: list_contains(b, x))))::int n_shared, len(list_distinct(list_filter(w, lambda x: not list_contains(b, x))))::int n_novel,
 len(list_distinct(list_filter(b, lambda x: not list_contains(w, x))))::int n_missing,
 len(list_filter(w, lambda x: not list_contains(b, x))) = 0 and len(list_filter(b, lambda x: not list_contains(w, x))) = 0 as same_set from t where b is not null""")
def word_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a document shares with its predecessor in its source, those it adds and those it lacks, and whether the sets are equal."""
    rows = sequence.with_predecessor(_texts(spark, sf_dir, "source"), "source", "doc_id")
    rows = rows.select("doc_id", words(normalize(F.col("text"))).alias("w"), words(normalize(F.col("before"))).alias("b"))
    novel, missing = F.size(F.array_except("w", "b")), F.size(F.array_except("b", "w"))
    return rows.select("doc_id", F.size(F.array_intersect("w", "b")).alias("n_shared"), novel.alias("n_novel"), missing.alias("n_missing"), ((novel == 0) & (missing == 0)).alias("same_set"))
