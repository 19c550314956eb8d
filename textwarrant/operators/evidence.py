"""Queries made wider, candidates gated and gathered, the nearest text, and when to ask a scholar."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textwarrant.functions.text import let
from textwarrant.operators.retrieve import bm25_idf, document_frequency
from textwarrant.operators.review import accepts_similar

NEAR = 3


def expanded(terms: Column, extra: Column, dropped: Sequence[str], synonyms: Mapping[str, Sequence[str]]) -> Column:
    """A query's terms and extra ones without ``dropped`` ones, then their synonyms; each once, in order."""
    stop = F.array(*[F.lit(w) for w in dropped]).cast("array<string>")
    table = F.create_map(*[x for k, v in synonyms.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v]))])
    kept = F.filter(F.concat(terms, extra), lambda w: ~F.array_contains(stop, w))
    none = F.array().cast("array<string>")
    return let(F.array_distinct(kept), lambda own: F.array_distinct(F.concat(own, F.flatten(F.transform(own, lambda w: F.coalesce(F.try_element_at(table, w), none))))))


def term_idf(tf: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(term, df, idf): one pass for the frequencies, one for the number of texts."""
    n = tf.select(id_col).distinct().agg(F.count(F.lit(1)).alias("n"))
    return document_frequency(tf).join(F.broadcast(n)).select("term", "df", bm25_idf(F.col("n"), F.col("df")).alias("idf"))


def specific_texts(tf: DataFrame, least_mean: float = 3.8, least_terms: int = 3, id_col: str = "doc_id") -> DataFrame:
    """Each text's number of distinct terms and mean idf, and whether it says enough of its own to be searched by."""
    found = tf.join(term_idf(tf, id_col).select("term", "idf"), "term").groupBy(id_col).agg(F.count(F.lit(1)).alias("n_terms"), F.round(F.avg("idf"), 6).alias("mean_idf"))
    return found.withColumn("specific", (F.col("n_terms") >= least_terms) & (F.col("mean_idf") >= least_mean))


def rarest_words(query_terms: DataFrame, tf: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Each query's most distinctive word: the one in the fewest texts, a word in none before all."""
    df = document_frequency(tf.join(query_terms.select("term").distinct(), "term", "left_semi"))
    rows = query_terms.join(df, "term", "left")
    return rows.groupBy(query_id).agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), "term")).alias("rarest"))


def texts_that_settle(rarest: DataFrame, tf: DataFrame, query_id: str = "query_id", id_col: str = "doc_id") -> DataFrame:
    """(query, text, mentions): texts that hold a query's rarest word or one that begins like it.

    Words of NEAR letters or more are near where their first NEAR agree: an
    equi-join on these; shorter ones must be equal.
    """
    key = lambda w: F.when(F.length(w) >= NEAR, F.substring(w, 1, NEAR)).otherwise(F.concat(F.lit("="), w))
    words = tf.select(id_col, "term", key(F.col("term")).alias("k"))
    met = words.join(rarest.select(query_id, "rarest", key(F.col("rarest")).alias("k")), "k")
    return met.groupBy(query_id, id_col).agg(F.bool_or(F.col("term") == F.col("rarest")).alias("mentions"))


def gathered(rankings: DataFrame, by: str, item: str) -> DataFrame:
    """Rankings of several queries put together: an item's best score, how many queries found it, and by which words.

    ``rankings`` has ``by``, query_no, ``item``, score and words (an array).
    """
    return rankings.groupBy(by, item).agg(
        F.max("score").alias("similarity"), F.count_distinct("query_no").alias("n_queries"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("words")))).alias("words")
    )


def nearest_text(candidates: DataFrame, by: str) -> DataFrame:
    """The nearest of the candidates that are near enough: most words shared, then the best level, then the cosine.

    ``candidates`` has ``by``, doc_id, matched, n_terms, cosine and level, each pair once.
    """
    share = F.col("matched") / F.col("n_terms")
    fine = candidates.filter(accepts_similar(share, F.col("matched"), F.col("cosine"), F.col("n_terms")))
    order = Window.partitionBy(by).orderBy(F.desc(F.round(share, 2)), "level", F.desc("cosine"), "doc_id")
    best = fine.withColumn("rn", F.row_number().over(order)).filter("rn = 1")
    return best.select(by, "doc_id", F.round(share, 2).alias("share"), "matched", "cosine")


def referral(words: Column, topics: Mapping[str, Sequence[str]], personal: Sequence[str], found: Column) -> Column:
    """Why to ask a scholar: the first sensitive topic that a question touches, a personal case, nothing found; else null."""
    holds = lambda forms: F.arrays_overlap(words, F.array(*[F.lit(w) for w in forms]))
    said = F.lit(None).cast("string")
    said = F.when(found == 0, "nothing found").otherwise(said)
    said = F.when(holds(personal), "personal").otherwise(said)
    for topic, forms in reversed(topics.items()):
        said = F.when(holds(forms), F.lit(topic)).otherwise(said)
    return said
