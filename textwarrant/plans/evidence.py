"""Queries of wider searches, gates, clauses and rewritten claims, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textwarrant.functions import clauses
from textwarrant.functions.text import normalize, words
from textwarrant.operators import evidence, match, retrieve
from textwarrant.plans.matching import CONTAINED, RUNS
from textwarrant.plans.registry import query
from textwarrant.plans.retrieval import _posted, _query_terms, _tf, bm25_of, jaccard_of
from textwarrant.plans.sql import BM25, JACCARD, TF, norm, word_list
from textwarrant.tables import load_spread as load, materialize

DROPPED = ["the", "and", "of"]
SYNONYMS = {"that": ["which", "this"], "in": ["inside"], "is": ["was", "that"], "for": ["of"]}
SYNONYM_SQL = "case w " + " ".join(f"when '{k}' then {v}" for k, v in SYNONYMS.items()) + " else [] end"


def _first(column: str) -> str:
    return f"list_filter({column}, lambda x, i: list_position({column}, x) = i)"


@query(f"""with w as (select item_id, list_filter({word_list('text')} || ['extra', 'that'], lambda x: not list_contains({DROPPED}, x)) w from benchmark),
d as (select item_id, {_first('w')} w from w), s as (select item_id, w || flatten(list_transform(w, lambda w: {SYNONYM_SQL})) w from d)
select item_id, md5(array_to_string({_first('w')}, ' ')) as terms_md5, len({_first('w')})::int as n_terms from s""")
def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = words(normalize(F.col("text")))
    rows = load(spark, sf_dir, "benchmark").select("item_id", evidence.expanded(own, F.array(F.lit("extra"), F.lit("that")), DROPPED, SYNONYMS).alias("w"))
    return rows.select("item_id", F.md5(F.array_join("w", " ").cast("binary")).alias("terms_md5"), F.size("w").alias("n_terms"))


@query(f"""with {TF}, i as (select term, ln(1 + (n - df + 0.5) / (df + 0.5)) idf from df, n), m as (select doc_id, count(*) n_terms, round(avg(idf), 6) mean_idf from tf join i using (term) group by doc_id)
select doc_id, n_terms, mean_idf, n_terms >= 3 and mean_idf >= 3.8 as specific from m""")
def specific_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.specific_texts(_tf(spark, sf_dir))


@query(f"""with {TF}, r as (select query_id, arg_min(term, (coalesce(df, 0), term)) rarest from qt left join df using (term) group by query_id),
t as (select doc_id, term, case when length(term) >= 3 then left(term, 3) else '=' || term end k from tf),
m as (select query_id, doc_id, bool_or(term = rarest) mentions from r join t on t.k = case when length(rarest) >= 3 then left(rarest, 3) else '=' || rarest end group by all)
select query_id, rarest, count(doc_id) n_settle, count(*) filter (mentions) n_mention from r left join m using (query_id) group by all""")
def subject_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    tf = _tf(spark, sf_dir)
    rarest = evidence.rarest_words(_query_terms(spark, sf_dir), tf)
    settled = evidence.texts_that_settle(rarest, tf).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_settle"), F.count_if("mentions").alias("n_mention"))
    return rarest.join(settled, "query_id", "left").select("query_id", "rarest", F.coalesce("n_settle", F.lit(0)).alias("n_settle"), F.coalesce("n_mention", F.lit(0)).alias("n_mention"))


@query("""with e as (select user_id, event_type, value, hour(ts) query_no, 'w' || (event_id % 4) word from events)
select user_id, event_type, max(value) as similarity, count(distinct query_no) n_queries, array_to_string(list_sort(list(distinct word)), ' ') as words from e group by user_id, event_type""")
def gathered_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as hits: of a user's queries (hours) for items (types)."""
    rows = load(spark, sf_dir, "events").select("user_id", "event_type", F.col("value").alias("score"), F.hour("ts").alias("query_no"), F.array(F.concat(F.lit("w"), F.col("event_id") % 4)).alias("words"))
    return evidence.gathered(rows, "user_id", "event_type").withColumn("words", F.array_join("words", " "))


@query(f"""with {TF}, {BM25}, {JACCARD}, c as (select query_id, doc_id from bm union select query_id, doc_id from ja),
qf as (select item_id query_id, unnest({word_list('text')}) term from benchmark), q as (select query_id, term, count(*) qtf from qf group by all),
qn as (select query_id, sum(qtf * qtf) qq, count(*) n_terms from q group by query_id), dn as (select doc_id, sum(tf::bigint * tf) dd from tf group by doc_id),
x as (select c.query_id, c.doc_id, count(*) matched, sum(qtf * tf) dot from c join q using (query_id) join tf on tf.doc_id = c.doc_id and tf.term = q.term group by all),
sc as (select query_id, doc_id, matched, n_terms, round(dot / sqrt(qq * dd), 6) cosine, case when source = 'src0' then 1 else 2 end level from x join qn using (query_id) join dn using (doc_id) join documents using (doc_id)),
ac as (select *, matched / n_terms share from sc where ((matched / n_terms >= 0.5 and matched >= 4 and cosine >= 0.7) or (matched / n_terms >= 0.75 and matched >= 3 and cosine >= 0.8)) and not (n_terms >= 14 and matched / n_terms < 0.65)),
best as (select *, row_number() over (partition by query_id order by round(share, 2) desc, level, cosine desc, doc_id) rn from ac)
select query_id, doc_id, round(share, 2) as share, matched, cosine from best where rn = 1""")
def nearest_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest document of each passage among its best by keywords and by overlap; the cosine is that of word counts."""
    posted = _posted(spark, sf_dir)
    tf = retrieve.each_term(posted)
    pairs = bm25_of(spark, sf_dir, posted).select("query_id", "doc_id").unionByName(jaccard_of(spark, sf_dir, posted).select("query_id", "doc_id")).distinct()
    pairs = materialize(pairs, "near-pairs")
    q = retrieve.terms(load(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id"), "query_id", F.col("text")).withColumnRenamed("tf", "qtf")
    norms = q.groupBy("query_id").agg(F.sum(F.col("qtf") * F.col("qtf")).alias("qq"), F.count(F.lit(1)).alias("n_terms"))
    lengths = tf.groupBy("doc_id").agg(F.sum(F.col("tf").cast("long") * F.col("tf")).alias("dd"))
    met = pairs.join(q, "query_id").join(tf, ["doc_id", "term"]).groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("matched"), F.sum(F.col("qtf") * F.col("tf")).alias("dot"))
    level = load(spark, sf_dir, "documents").select("doc_id", F.when(F.col("source") == "src0", 1).otherwise(2).alias("level"))
    scored = met.join(norms, "query_id").join(lengths, "doc_id").join(level, "doc_id")
    return evidence.nearest_text(scored.withColumn("cosine", F.round(F.col("dot") / F.sqrt(F.col("qq") * F.col("dd")), 6)), "query_id")


TOPICS = {"contracts": ["hein", "loan"], "medicine": ["erly", "thand"]}
PERSONAL = ["ou", "moi"]


@query(f"""with w as (select conv_id, turn, {word_list('text')} w from conversations where text is not null)
select conv_id, turn, case {' '.join(f"when list_has_any(w, {v}) then '{k}'" for k, v in TOPICS.items())} when list_has_any(w, {PERSONAL}) then 'personal' when turn % 4 = 0 then 'nothing found' end as refer from w""")
def referral(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").filter("text is not null")
    return rows.select("conv_id", "turn", evidence.referral(words(normalize(F.col("text"))), TOPICS, PERSONAL, F.col("turn") % 4).alias("refer"))


@query(f"""with {TF}, {CONTAINED}, {RUNS}, e as (select item_id, min(doc_id) doc_id from p group by item_id),
l as (select r.item_id, r.doc_id, max(r.n_words) longest from r group by all), z as (select item_id, len(w) n from bw),
c as (select item_id, arg_min(doc_id, (-longest, doc_id)) doc_id from l join z using (item_id) where longest / n >= 0.75 group by item_id),
i as (select term, ln(1 + (n - df + 0.5) / (df + 0.5)) idf from df, n), ra as (select query_id item_id, term from qt join i using (term) where idf >= 3.0),
rn as (select item_id, count(*) n from ra group by item_id having count(*) >= 2), rd as (select item_id, doc_id, count(*) m from ra join tf using (term) group by all),
f as (select rd.item_id, min(doc_id) doc_id from rd join rn on rn.item_id = rd.item_id and rn.n = rd.m group by rd.item_id)
select b.item_id, coalesce(e.doc_id, c.doc_id, f.doc_id) as doc_id, case when e.doc_id is not null then 'exact' when c.doc_id is not null then 'close' when f.doc_id is not null then 'rare words' else 'rejected' end as how
from benchmark b left join e using (item_id) left join c using (item_id) left join f using (item_id)""")
def recited_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document of each passage: that holds it, else three quarters of it in one run, else all its rare words."""
    items, docs = load(spark, sf_dir, "benchmark"), load(spark, sf_dir, "documents")
    exact = match.containment(items, docs, "item_id", "doc_id").select("item_id", "doc_id")
    size = items.select("item_id", F.size(words(normalize(F.col("text")))).alias("n"))
    runs = match.verbatim_runs(items, docs, "item_id", "doc_id").groupBy("item_id", "doc_id").agg(F.max("n_words").alias("longest"))
    close = runs.join(size, "item_id").filter(F.col("longest") / F.col("n") >= 0.75)
    close = close.groupBy("item_id").agg(F.min_by("doc_id", F.struct(-F.col("longest"), F.col("doc_id"))).alias("doc_id"))
    tf = _tf(spark, sf_dir)
    rare = _query_terms(spark, sf_dir).withColumnRenamed("query_id", "item_id").join(evidence.term_idf(tf).filter("idf >= 3.0").select("term"), "term")
    sizes = rare.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    whole = rare.join(tf.select("doc_id", "term"), "term").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("m")).join(sizes, "item_id").filter("m = n").select("item_id", "doc_id")
    best = match.cascade([exact, close, whole], "item_id").groupBy("item_id", "stage").agg(F.min("doc_id").alias("doc_id"))
    how = F.coalesce(F.get(F.array(F.lit("exact"), F.lit("close"), F.lit("rare words")), F.col("stage") - 1), F.lit("rejected"))
    return items.select("item_id").join(best, "item_id", "left").select("item_id", "doc_id", how.alias("how"))


@query(f"""with s as (select doc_id, unnest(string_split(text, chr(10))) line from documents where text is not null), p as (select doc_id, regexp_split_to_array(line, '{clauses.CLAUSE_END}') p from s),
c as (select doc_id, list_filter(list_transform(p, lambda x: trim(x)), lambda x: len({word_list('x')}) >= 3) c from p where len(p) > 1)
select doc_id, sum(len(c))::bigint n_pieces, sum(len(array_to_string(c, '')))::bigint n_chars from c group by doc_id""")
def clause_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clauses of each document's lines that have several."""
    lines = load(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    rows = lines.filter(F.col("line").rlike(clauses.CLAUSE_END)).select("doc_id", clauses.clause_pieces(F.col("line")).alias("c"))
    return rows.groupBy("doc_id").agg(F.sum(F.size("c")).alias("n_pieces"), F.sum(F.length(F.array_join("c", ""))).alias("n_chars"))


INTRODUCING = ["the", "and", "that", "of", "in", "is", "for", "it"]


@query(f"""with s as (select doc_id, unnest(regexp_split_to_array(text, '[.!?,\\n]')) s from documents where text is not null), w as (select doc_id, {word_list('s')} w from s where {norm('s')} <> '')
select doc_id, count(*) n, count(*) filter (len(list_filter(w, lambda x: not list_contains({INTRODUCING}, x))) <= 1) n_introducing, count(*) filter (len(list_filter(w, lambda x: not list_contains({INTRODUCING[:3]}, x))) > 0) n_with_subject from w group by doc_id""")
def claim_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many stretches of a document only introduce something, and how many name a subject."""
    rows = load(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.explode(F.split("text", r"[.!?,\n]")).alias("s"))
    rows = rows.select("doc_id", words(normalize(F.col("s"))).alias("w")).filter(F.size("w") > 0)
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(clauses.only_of(F.col("w"), INTRODUCING)).alias("n_introducing"), F.count_if(clauses.has_subject(F.col("w"), INTRODUCING[:3])).alias("n_with_subject"))


@query(f"""with c as (select conv_id, turn, {word_list('text')} w from conversations where text is not null),
k as (select conv_id, turn, w || case when turn % 4 = 1 then ['not'] else [] end w, list_filter(w, lambda x, i: i % 3 <> 0) q from c),
q as (select conv_id, turn, w, case when turn % 3 = 2 then list_reverse(q) else q end q from k)
select conv_id, turn, len(q) > 0 and not (list_has_any(w, {list(clauses.NEGATIONS)}) and not list_has_any(q, {list(clauses.NEGATIONS)})) and regexp_matches(' ' || array_to_string(w, ' ') || ' ', ' ' || array_to_string(q, ' (.* )?') || ' ') as accepted from q""")
def rewrite_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with every third word left out: taken back unless the order is turned or a negation was dropped."""
    rows = load(spark, sf_dir, "conversations").filter("text is not null").select("conv_id", "turn", words(normalize(F.col("text"))).alias("w"))
    claim = F.filter("w", lambda x, i: (i + 1) % 3 != 0)
    claim = F.when(F.col("turn") % 3 == 2, F.reverse(claim)).otherwise(claim)
    held = F.concat("w", F.when(F.col("turn") % 4 == 1, F.array(F.lit("not"))).otherwise(F.array().cast("array<string>")))
    return rows.select("conv_id", "turn", clauses.rewrite_span(held, claim).isNotNull().alias("accepted"))


@query(r"""with q as (select page_id, unnest(regexp_extract_all(html, '["“”«»]([^"“”«»]{12,})["“”«»]', 1)) q from pages)
select page_id, count(*) n_quotes, min(len(regexp_extract_all(lower(q), '\p{L}+')))::int as least_words from q where len(regexp_extract_all(lower(q), '\p{L}+')) >= 4 group by page_id""")
def quoted_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages in quotation marks that have twelve characters and four words or more."""
    quotes = F.regexp_extract_all("html", F.lit('["“”«»]([^"“”«»]{12,})["“”«»]'), F.lit(1))
    rows = load(spark, sf_dir, "pages").select("page_id", F.explode(quotes).alias("q"))
    n = F.size(F.regexp_extract_all(F.lower("q"), F.lit(r"\p{L}+"), F.lit(0)))
    return rows.select("page_id", n.alias("n")).filter("n >= 4").groupBy("page_id").agg(F.count(F.lit(1)).alias("n_quotes"), F.min("n").alias("least_words"))


@query(rf"""with w as (select doc_id, list_filter(list_transform({word_list('text')}, lambda x: regexp_replace(x, '[^\p{{L}}]', '', 'g')), lambda x: x <> '') w from documents where text is not null)
select doc_id, len(w) > 0 and doc_id % 3 = 0 as conflict from w""")
def marked_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with a mark on their first letter against the same with another mark (every third document), none or the same."""
    letters = F.filter(F.transform(words(normalize(F.col("text"))), lambda x: F.regexp_replace(x, r"[^\p{L}]", "")), lambda x: x != "")
    rows = load(spark, sf_dir, "documents").filter("text is not null").select("doc_id", letters.alias("w"))
    mark = lambda sign: F.transform("w", lambda x: F.concat(F.substring(x, 1, 1), sign, F.substring(x, 2, 1000)))
    other = F.when(F.col("doc_id") % 3 == 0, "ِ").when(F.col("doc_id") % 3 == 1, "").otherwise("َ")
    return rows.select("doc_id", clauses.marks_conflict(mark(F.lit("َ")), mark(other)).alias("conflict"))
