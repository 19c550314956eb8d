"""Queries of rules over the tables' own texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarrant.functions import parse
from textwarrant.operators import lexicons, rules
from textwarrant.plans.registry import query
from textwarrant.tables import load_spread as load

_HITS = ", ".join(f"len(list_filter(w, lambda x: list_contains({words.split()}, x)))" for words in lexicons.LANGUAGE_WORDS.values())


@query(f"""with t as (select doc_id, text, regexp_extract_all(lower(text), '\\p{{L}}+') w from documents where text is not null), h as (select *, [{_HITS}] h from t)
select doc_id, case when len(regexp_extract_all(text, '[\\x{{0600}}-\\x{{06FF}}]')) >= len(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{024F}}]'))
 then case when len(regexp_extract_all(text, '[{lexicons.URDU_LETTERS}]')) >= 3 then 'ur' else 'ar' end
 when list_max(h) < 2 then 'other' else ({list(lexicons.LANGUAGE_WORDS)})[list_position(h, list_max(h))] end as language from h""")
def text_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole document, by script and common words."""
    return load(spark, sf_dir, "documents").filter("text is not null").select("doc_id", rules.language(F.col("text")).alias("language"))


@query("""with t as (select conv_id, turn, list_filter([trim(text), trim(role)], lambda x: x <> '') c from conversations where text is not null and role is not null)
select conv_id, turn, len(c)::int as n_claims, md5(array_to_string(c, chr(30))) as claims_md5 from t""")
def strict_json_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn written as a strict JSON answer, with an empty claim besides, and read again."""
    turns = load(spark, sf_dir, "conversations").filter("text is not null and role is not null")
    answer = F.to_json(F.struct(F.array("text", F.lit(" "), "role").alias("claims")))
    claims = parse.strict_claims(answer)
    return turns.select("conv_id", "turn", F.size(claims).alias("n_claims"), F.md5(F.array_join(claims, "\x1e").cast("binary")).alias("claims_md5"))


@query("""select l_orderkey, l_linenumber, case when l_quantity = floor(l_quantity) then floor(l_quantity)::bigint::varchar else l_quantity::double::varchar end as quantity,
 case when l_extendedprice = floor(l_extendedprice) then floor(l_extendedprice)::bigint::varchar else l_extendedprice::double::varchar end as price from lineitem""")
def plain_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities and prices as people write them."""
    rows = load(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", parse.plain_number(F.col("l_quantity").cast("double")).alias("quantity"), parse.plain_number(F.col("l_extendedprice").cast("double")).alias("price"))
