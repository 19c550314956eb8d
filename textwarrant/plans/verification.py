"""Queries of whole reviews: every sentence of every document against the passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarrant.operators import decision, entries, regions, verify
from textwarrant.plans.registry import query
from textwarrant.plans.sql import norm, word_list
from textwarrant.tables import load_spread as load

#: Accented letters and what a second spelling writes for them.
ACCENTS = ("áàâäéèêëíîïóôöúùûüñç", "aaaaeeeeiiiooouuuunc")
#: Of eight passages the last two are narrations. The tables' corpora are small, so that a word that one narration has weighs far less than in a large one.
RULES = decision.Rules(
    gate=(1.5, 6.0),
    strict_gate=(1.8, 8.0),
    lexicon=regions.Lexicon(
        said=["was", "are", "est", "ist", "se"], speaker=["the", "le", "la", "der", "el"], names=["it"], others=["on", "with", "pour", "mit", "con"],
        between=["and", "et", "und", "y"], honorific=["of", "the", "in"], joined=("to", "be"), context=["that", "que", "dass"],
    ),
)

SENTENCES = rf"""sp as (select doc_id, string_split(regexp_replace(replace(text, chr(10), chr(10) || chr(1)), '([.!?؟])(\s)', '\1' || chr(1) || '\2', 'g'), chr(1)) t from documents),
su as (select doc_id, unnest(t) t, generate_subscripts(t, 1) i from sp), sf as (select doc_id, t, row_number() over (partition by doc_id order by i) - 1 no from su where regexp_replace(t, '^\s+|\s+$', '', 'g') <> ''),
sg as (select doc_id, no, form, w, len(w) n from (select doc_id, no, {norm('t')} form, {word_list('t')} w from sf) where len(w) > 0),
one as (select item_id, item_id % 8 >= 6 narrated, {norm('text')} f0, {norm(f"translate(text, '{ACCENTS[0]}', '{ACCENTS[1]}')")} f1 from benchmark),
win as (select a.item_id, count(*)::int members, string_agg(b.f0, ' ' order by b.item_id) f0, string_agg(b.f1, ' ' order by b.item_id) f1
 from one a join range(2, 6) r(m) on true join one b on b.item_id >= a.item_id and b.item_id < a.item_id + m where not a.narrated and not b.narrated group by a.item_id, m having count(*) = m),
co as (select case when narrated then 3 else 1 end rank, item_id, 1 members, f0, f1 from one where f0 <> '' union all select 2, item_id, members, f0, f1 from win),
cn as (select count(*) n from co where rank = 3), cw as (select distinct item_id, unnest(string_split(f0 || ' ' || f1, ' ')) term from co where rank = 3),
ci as (select term, ln(1 + n / count(*)) idf from cw, cn group by term, n),
sw as (select doc_id, no, coalesce(idf, ln(1 + n)) idf from (select doc_id, no, unnest(w) term from sg) left join ci using (term), cn),
ga as (select doc_id, no from sw group by all having sum(idf) >= 6.0 and list_sort(list(idf), 'DESC')[2] >= 1.5),
pr as (select doc_id, no, rank, item_id, members, rank * 2 - (sg.form in (f0, f1))::int stage from sg join co on sg.form in (f0, f1) or (n >= 3 and (contains(' ' || f0 || ' ', ' ' || sg.form || ' ') or contains(' ' || f1 || ' ', ' ' || sg.form || ' ')))),
st as (select doc_id, no, item_id, members, stage, others from (select *, row_number() over (partition by doc_id, no order by stage, tight, rank, item_id, members) rn, count(*) over (partition by doc_id, no, stage, tight) - 1 others
 from (select *, case when stage = 4 then members else 0 end tight from pr where rank < 3 or (doc_id, no) in (select (doc_id, no) from ga))) where rn = 1)"""


def corpus(spark: SparkSession, sf_dir: str) -> decision.Corpus:
    """The passages, each as written and without its accents; verses also as windows of two to five that follow each other."""
    items = load(spark, sf_dir, "benchmark").select("item_id", "text", (F.col("item_id") % 8 >= 6).alias("narrated"))
    one = entries.spelled(items, F.array("text", F.translate("text", *ACCENTS)), F.when(F.col("narrated"), "hadith").otherwise("verse"))
    places = items.filter("not narrated").select("item_id", F.lit(0).alias("group"), F.col("item_id").cast("int").alias("place"))
    # places that are one group would meet in few tasks: windows need only their own neighbourhood
    return decision.corpus(one.unionByName(entries.windows(one, places.withColumn("group", F.floor(F.col("item_id") / 8)))))


@query(f"with {SENTENCES} select doc_id, no::int as no, item_id, members, stage, others as other_matches from st")
def sentence_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passage that each sentence of a document is found in, by the six stages of the cascade."""
    segs = verify.sentences(load(spark, sf_dir, "documents"))
    found = verify.first_source(segs, corpus(spark, sf_dir), RULES)
    return found.select(F.col("seg.id").alias("doc_id"), F.col("seg.no").alias("no"), "entry.item_id", "entry.members", "stage", "other_matches")


@query()
def sentence_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of every document: quoted whole, in part, altered or not found. Tests hold the rules against a plain program."""
    found = verify.verify_texts(load(spark, sf_dir, "documents"), corpus(spark, sf_dir), RULES)
    return found.select(F.col("id").alias("doc_id"), "no", "start", "stop", "found", "status", "how", "entry.item_id", "entry.members", "others", "confidence", "differences")


@query()
def quoted_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked and attributed quotations in every whole document, in order."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = regions.quoted_regions(docs, RULES.lexicon, RULES.normal)
    # a plain posexplode would work all regions out once more, to ask for their number
    found = found.select("doc_id", F.posexplode_outer("regions").alias("no", "r")).filter("r is not null")
    return found.select("doc_id", "no", "r.start", "r.end", "r.kind", "r.attributed", F.md5(F.col("r.text").cast("binary")).alias("text_md5"))
