"""Sentences held against a corpus: what is quoted whole, what in part, and what is not found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarrant.functions.text import normalize, sentence_spans, words
from textwarrant.operators import decision

def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(seg, id, no, text, n): the sentences of each text that have words."""
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(sentence_spans(F.col(text_col))).alias("no", "s"))
    # a letter, digit or underscore is a word, which is told sooner than by the normal form
    rows = rows.filter(F.col("s.text").rlike(r"[\p{L}\p{N}_]"))
    rows = rows.select("id", "no", F.col("s.text").alias("text"), F.size(words(normalize(F.col("s.text")))).alias("n"))
    return rows.select(F.struct("id", "no").alias("seg"), "id", "no", "text", "n")


def first_source(sentences_: DataFrame, over: decision.Corpus, rules: decision.Rules = decision.Rules()) -> DataFrame:
    """The entry that each sentence is found in word for word, by one cascade: (seg, entry, stage, other_matches).

    Stages, from 1: a verse's whole form, part of one, a window's whole form,
    part of one - the tightest - then a narration's whole form and part of one
    if the sentence is distinctive (``entries.distinctive``). Ties go to entries in their order.
    """
    rows = sentences_.select("seg", "text", rules.normal(F.col("text")).alias("form"))
    found = decision.verbatim(rows, over, rules)
    stage = F.col("entry.rank") * 2 - F.when(F.col("how") == "full", 1).otherwise(0)
    return found.select("seg", "entry", stage.alias("stage"), F.col("others").alias("other_matches"))


def verify_texts(docs: DataFrame, over: decision.Corpus, rules: decision.Rules = decision.Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The findings in each sentence of each text: id, no, and the columns of ``decision.review``, by the same decisions as everywhere."""
    found = decision.review(sentences(docs, id_col, text_col), over, rules)
    return found.select(F.col("seg.id").alias("id"), F.col("seg.no").alias("no"), *[c for c in found.columns if c != "seg"])
