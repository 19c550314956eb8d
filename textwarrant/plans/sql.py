"""Pieces of SQL that several oracles share."""


def norm(column: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({column}), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g'))"


def word_list(column: str) -> str:
    return f"list_filter(string_split({norm(column)}, ' '), lambda w: w <> '')"


TF = f"""w as (select doc_id, unnest({word_list('text')}) term from documents),
tf as (select doc_id, term, least(count(*), 65535)::int tf from w group by all),
df as (select term, count(*) df from tf group by term),
n as (select count(distinct doc_id) n from tf),
dl as (select doc_id, sum(tf)::bigint dl from tf group by doc_id),
qt as (select distinct item_id query_id, unnest({word_list('text')}) term from benchmark)"""

BM25 = """u as (select query_id, term, 1.0 weight, ln(1 + (n - df + 0.5) / (df + 0.5)) idf, (select avg(dl) from dl) mean
      from qt join df using (term), n where df <= n * 0.4),
whole as (select query_id, sum(idf * weight) whole from u group by query_id),
b as (select u.query_id, tf.doc_id, sum(idf * weight * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) score, sum(idf * weight) matched, count(*) n_terms
      from u join tf using (term) join dl on dl.doc_id = tf.doc_id group by all),
s as (select query_id, doc_id, round(score * matched / whole, 9) score, n_terms from b join whole using (query_id)),
bm as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) rank from s where score >= 4) where rank <= 10)"""

JACCARD = """ji as (select term, ln(1 + n / df) idf from df, n),
je as (select doc_id, sum(idf) ew from tf join ji using (term) group by doc_id),
jq as (select query_id, term, coalesce(idf, ln(1 + n)) idf from qt left join ji using (term), n),
jw as (select query_id, sum(idf) qw from jq group by query_id),
jo as (select query_id, doc_id, sum(idf) overlap from jq join tf using (term) group by all),
jr as (select query_id, doc_id, round(overlap / (qw + ew - overlap), 9) score from jo join jw using (query_id) join je using (doc_id)),
ja as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) rank from jr) where rank <= 20)"""
