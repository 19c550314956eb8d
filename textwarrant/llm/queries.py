"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarrant.llm import ann, bm25, bpe, fim, langid, linededup, mixing, negatives, pii, sharding, simhash, tokencount, warc
from textwarrant.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix_sources(docs)
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"))


QUERIES["op1_mix_sources"] = op1_mix_sources
ORACLES["op1_mix_sources"] = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size from documents),
s as (select source, count(*) n, sum(size)::bigint source_size from d group by source),
w as (select *, (case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0 when 1 then 2.0 else 1.0 end)::double weight, 3.0::double * source_size most, sum(source_size) over () total from s),
o as (select *, row_number() over f pos, coalesce(sum(most) over (f rows between unbounded preceding and 1 preceding), 0) before,
      sum(weight) over (f rows between current row and unbounded following) remaining from w window f as (order by most / weight, source nulls last)),
l as (select *, (total - before) / remaining level from o),
v as (select arg_min(level, pos) level from l where level <= most / weight),
t as (select source, n, source_size, least(most, (select level from v) * weight) target from l),
r as (select d.doc_id, d.size, t.source, t.n, t.source_size, t.target, coalesce(floor(target / nullif(source_size, 0)), 0)::bigint copies from d join t on d.source is not distinct from t.source),
p as (select *, coalesce(target / nullif(source_size, 0) - copies, 0) part, target - copies * source_size rest,
      (('0x' || substr(md5('20:' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint + 0.5) / 4503599627370496.0::double u from r),
x as (select *, case when part > 0 and size > 0 then (u / (1.0 - u)) / ((part * size * n) / ((1.0 - part) * source_size)) else 1e308 end xi from p),
c as (select *, sum(size) over (partition by source order by xi, doc_id, size rows between unbounded preceding and current row) - size / 2 as middle from x)
select doc_id, size, source_size, target, (size * (copies + case when part > 0 and middle <= rest then 1 else 0 end))::bigint taken from c
"""


def op2_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(load(spark, sf_dir, "embeddings"))


QUERIES["op2_hilbert_ann"] = op2_hilbert_ann


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs).select("doc_id", "held_out", "lang_pred", "score")


QUERIES["op3_language_id"] = op3_language_id


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(load(spark, sf_dir, "pages"))
    return found.select(warc.page_id(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_id(F.col("refers_to")).alias("refers_to"))


QUERIES["op4_warc"] = op4_warc
ORACLES["op4_warc"] = r"""
with p as (select page_id, coalesce(html, '') html from pages),
m as (select page_id, strlen(html)::bigint payload_bytes, sha1(html) h, max(page_id) over (partition by html) newest from p)
select page_id, payload_bytes,
 list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (i * 5 // 4 + 1)::int, 2))::int) >> (3 - i * 5 % 4)::int) & 31) + 1, 1)), lambda a, b: a || b) as payload_digest,
 case when page_id = newest then 'response' else 'revisit' end as record_type,
 case when page_id = newest then null else newest end as refers_to from m
"""


def op5_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return bm25.search(docs, docs.filter("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id"))


QUERIES["op5_bm25"] = op5_bm25
ORACLES["op5_bm25"] = r"""
with w as (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) term from documents),
t as (select doc_id, term, count(*) tf from w group by all),
d as (select doc_id, sum(tf) dl from t group by all),
n as (select count(*) n, (select sum(dl) from d) / count(*) mean from documents),
f as (select term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) idf from t, n group by term, n),
s as (select q.doc_id query_id, t.doc_id, round(sum(idf * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * dl / mean))), 9) score
      from t q join f using (term) join t on t.term = q.term join d on d.doc_id = t.doc_id, n where q.doc_id % 100 = 0 group by all)
select query_id, rank::int as rank, doc_id, score from (select *, row_number() over (partition by query_id order by score desc, doc_id) rank from s) where rank <= 10
"""


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard_by_bytes(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")}).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


QUERIES["op6_shards"] = op6_shards


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES["op7_simhash"] = op7_simhash


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.size("tokens").cast("long").alias("n_tokens"),
        F.sha2("packed", 256).alias("ids_sha256"),
        F.sha2(bpe.decode(F.col("tokens"), ranks), 256).alias("decoded_sha256"),
    )


QUERIES["op8_bpe"] = op8_bpe


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return linededup.drop_boilerplate(docs).select("doc_id", "text", "line_count", "line_dropped")


QUERIES["op9_line_dedup"] = op9_line_dedup
ORACLES["op9_line_dedup"] = r"""
with d as (select doc_id, source, text, string_split(text, chr(10)) ls from documents),
u as (select row_number() over () r, * from d),
k as (select distinct r, source, trim(x, ' ') line from (select r, source, unnest(ls) x from u) where trim(x, ' ') <> ''),
c as (select source, line, count(*) pages from k group by all having count(*) >= 5),
n as (select source, count(*) total from documents group by source),
b as (select c.source, list(line) bad from c join n on c.source is not distinct from n.source where pages > total * 0.05 group by c.source),
f as (select doc_id, text, ls, list_filter(ls, lambda x: trim(x, ' ') = '' or bad is null or not list_contains(bad, trim(x, ' '))) kept from u left join b on u.source is not distinct from b.source)
select doc_id, array_to_string(kept, chr(10)) as text, coalesce(len(ls), 0)::int line_count, coalesce(len(ls) - len(kept), 0)::int line_dropped from f
"""


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", tokencount.token_count(F.col("text"), public_tokenizers.path("piece_bpe_32k.model")).alias("n_tokens"))


QUERIES["op10_token_counts"] = op10_token_counts


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    output, form = F.col("fim_output"), F.col("fim_form")
    return fim.transform(docs).select(
        "doc_id",
        F.col("fim_n").alias("n"),
        form.alias("form"),
        F.col("fim_prefix_chars").alias("prefix_chars"),
        F.col("fim_middle_chars").alias("middle_chars"),
        F.sha2(output, 256).alias("output_sha256"),
        F.sha2(fim.restore(output, form), 256).alias("restored_sha256"),
    )


QUERIES["op11_fim"] = op11_fim
ORACLES["op11_fim"] = r"""
with d as (select doc_id, coalesce(text, '') x, sha256('1:' || coalesce(doc_id::varchar, '')) s from documents),
t as (select doc_id, x, regexp_extract_all(x, '[A-Za-z]+|[^A-Za-z]') u, ('0x' || substr(s, 1, 8))::bigint h1, ('0x' || substr(s, 9, 8))::bigint h2, ('0x' || substr(s, 17, 8))::bigint h3, ('0x' || substr(s, 25, 8))::bigint h4 from d),
f as (select doc_id, x, u, len(u) n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) b,
      case when x = '' or contains(x, '<P>') or contains(x, '<S>') or contains(x, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end form from t),
c as (select doc_id, x, n, form, array_to_string(u[1:a], '') p, array_to_string(u[a + 1:b], '') m, array_to_string(u[b + 1:n], '') s from f)
select doc_id, n::bigint n, form, case when form <> 'plain' then length(p) end::bigint prefix_chars, case when form <> 'plain' then length(m) end::bigint middle_chars,
 sha256(case form when 'plain' then x when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) output_sha256, sha256(p || m || s) restored_sha256 from c
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", relabelled))


QUERIES["op12_hard_negatives"] = op12_hard_negatives
ORACLES["op12_hard_negatives"] = r"""
with r as (select distinct vec_id id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end) label, embedding from embeddings
 where vec_id is not null and label is not null and embedding is not null and list_count(embedding) = len(embedding) and coalesce(list_bool_and(list_transform(embedding, lambda x: isfinite(x))), true)),
v as (select id, label, list_transform(embedding, lambda x: floor(256 * x::double)) v from r),
s as (select a.id anchor_id, b.id other, a.label = b.label same, list_inner_product(a.v, b.v)::bigint score from v a join v b on a.id <> b.id and len(a.v) = len(b.v) where a.id % 100 = 0),
p as (select anchor_id, other positive_id, score positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, other) <= 5)
select p.anchor_id, positive_id, row_number() over w::int as rank, other negative_id, positive_score, score negative_score
from p join s on p.anchor_id = s.anchor_id and not same and 80 * positive_score <= 100 * score and score <= positive_score
window w as (partition by p.anchor_id, positive_id order by score desc, other) qualify row_number() over w <= 5
"""


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(load(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii_spans", lambda s: s["base"])
    of_kind = lambda kind: F.filter("pii_spans", lambda s: s["base"] & (s["kind"] == kind))
    counts = [F.size(of_kind(kind)).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    added = (F.size("pii_spans") - F.size(base)).cast("long").alias("n_added")
    return found.select("doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("pii_spans")).alias("spans"), added)


QUERIES["op13_pii"] = op13_pii
