"""Queries over quotations and their accepted wordings, by language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarrant.functions.text import sentence_spans
from textwarrant.operators import foreign
from textwarrant.plans.registry import query
from textwarrant.tables import load, load_spread

FLOORS = {"verse": 0.60, "narration": 0.62}


@query()
def foreign_wordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of benchmark passages, in each language, against the sentences of documents; src0 stands for verses."""
    docs = load_spread(spark, sf_dir, "documents").filter("text is not null and lang is not null")
    kind = F.when(F.col("source") == "src0", "verse").otherwise("narration")
    found = docs.select("doc_id", "lang", kind.alias("kind"), F.posexplode(sentence_spans(F.col("text"))).alias("i", "s"))
    name = F.concat_ws(":", "doc_id", "i")
    wordings = found.select(name.alias("text_id"), "kind", "lang", name.alias("reference"), F.col("s.text").alias("text"))
    items = load(spark, sf_dir, "benchmark").select("item_id", F.posexplode(sentence_spans(F.col("text"))).alias("place", "s"))
    asked = items.select("item_id", "place", F.col("s.text").alias("text")).join(F.broadcast(docs.agg(F.collect_set("lang").alias("langs"))))  # one row
    quotes = asked.withColumn("lang", F.explode("langs")).select("item_id", "place", "lang", "text", F.lit(None).cast("string").alias("hint"), F.lit(None).cast("string").alias("given"))
    return foreign.match_quotations(quotes, wordings, FLOORS, by=("item_id", "place", "lang")).withColumn("missing", F.array_join("missing", " "))


@query()
def found_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotations in documents: between marks, or what follows a word of saying in the tables' languages."""
    said = {"voiced": r"\b(?:says|said|sagt|sagte|dit|dice|dijo)\b"}
    return foreign.find_quotations(load_spread(spark, sf_dir, "documents"), {"voiced": said["voiced"]}, said)
