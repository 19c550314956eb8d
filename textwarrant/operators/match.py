"""Joins that find one text in another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textwarrant.functions.text import normalize, runs, words
from textwarrant.operators.meeting import estimated, runs_met

SEED_WORDS = 3


def exact_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's first row of the same normalised form, and the number of others.

    Forms are grouped by a hash pair before the ids are joined back, so that a
    form of very many rows is one row of the joined side. Null texts are a form of
    their own, of length -1.
    """
    form = normalize(F.col(text_col))
    crc = F.coalesce(F.crc32(form.cast("binary")), F.lit(0))
    keyed = docs.select(id_col, F.xxhash64(form).alias("h"), crc.alias("c"), F.coalesce(F.length(form), F.lit(-1)).alias("n"))
    groups = keyed.groupBy("h", "c", "n").agg(F.min(id_col).alias("first_id"), (F.count(F.lit(1)) - 1).alias("other_matches"))
    return keyed.join(groups, ["h", "c", "n"]).select(id_col, "first_id", "other_matches")


def containment(needles: DataFrame, texts: DataFrame, needle_id: str, text_id: str, min_words: int = SEED_WORDS) -> DataFrame:
    """Pairs where a needle occurs as consecutive whole words of a text.

    Both sides have a ``text`` column. The first ``min_words`` words of a needle
    are the key of an equi-join with the runs of as many words of the texts;
    the pairs that meet are then compared in full. Needles of fewer words match
    nothing.
    """
    left = needles.select(needle_id, normalize(F.col("text")).alias("needle"))
    left = left.withColumn("w", words(F.col("needle"))).filter(F.size("w") >= min_words)
    left = left.select(needle_id, "needle", F.array_join(F.slice("w", 1, min_words), " ").alias("seed"))
    right = texts.select(text_id, normalize(F.col("text")).alias("form"))
    seeds = right.select(text_id, F.explode(F.array_distinct(runs(words(F.col("form")), min_words))).alias("seed"))
    pairs = seeds.join(left, "seed").select(needle_id, text_id, "needle")
    hits = pairs.join(right, text_id)
    whole = F.concat(F.lit(" "), "form", F.lit(" ")).contains(F.concat(F.lit(" "), F.col("needle"), F.lit(" ")))
    return hits.filter(whole).select(needle_id, text_id, F.when(F.col("form") == F.col("needle"), "full").otherwise("partial").alias("match_type"))


def first_source(pairs: DataFrame, needle_id: str, text_id: str) -> DataFrame:
    """Each needle's first text and the number of its other texts."""
    least = pairs.groupBy(needle_id).agg(F.min(F.struct(text_id, "match_type")).alias("first"), (F.count(F.lit(1)) - 1).alias("other_matches"))
    return least.select(needle_id, "first.*", "other_matches")


def locate(needles: DataFrame, texts: DataFrame, needle_id: str, text_id: str, min_words: int = SEED_WORDS) -> DataFrame:
    """Where a contained needle first occurs: its first word's place, from 0, and its number of words."""
    pairs = containment(needles, texts, needle_id, text_id, min_words).select(needle_id, text_id)
    left = needles.select(needle_id, normalize(F.col("text")).alias("needle"))
    right = texts.select(text_id, normalize(F.col("text")).alias("form"))
    joined = pairs.join(left, needle_id).join(right, text_id)
    ahead = F.call_function("substring_index", F.concat(F.lit(" "), "form", F.lit(" ")), F.concat(F.lit(" "), F.col("needle"), F.lit(" ")), F.lit(1))
    return joined.select(needle_id, text_id, F.size(words(ahead)).alias("word_start"), F.size(words(F.col("needle"))).alias("n_words"))


def cascade(stages: list[DataFrame], by: str) -> DataFrame:
    """Rows of the first stage that has any for a key; adds ``stage``, from 1."""
    rows = [s.withColumn("stage", F.lit(i)) for i, s in enumerate(stages, 1)]
    union = rows[0]
    for r in rows[1:]:
        union = union.unionByName(r)
    first = union.groupBy(by).agg(F.min("stage").alias("first_stage"))
    return union.join(first, by).filter("stage = first_stage").drop("first_stage")


def verbatim_runs(refs: DataFrame, texts: DataFrame, ref_id: str, text_id: str, min_words: int = 4) -> DataFrame:
    """Maximal runs of at least ``min_words`` words that a text shares with a reference.

    Runs of ``min_words`` words meet in an equi-join; of the larger side only runs
    are rows that the smaller has. Meetings next to each other
    on one diagonal (place in the text less place in the reference) are islands.
    Returns ref_id, text_id, text_start, ref_start and n_words, places from 0.
    """

    def grams(df: DataFrame, key: str, place: str, wanted: DataFrame | None = None) -> DataFrame:
        rows = df.select(key, normalize(F.col("text")).alias("form"))
        if wanted is not None:
            return runs_met(rows, wanted, min_words).withColumnRenamed("i", place)
        return rows.select(key, F.posexplode(runs(words(F.col("form")), min_words)).alias(place, "gram"))

    if estimated(texts) > estimated(refs):
        ref_runs = grams(refs, ref_id, "j")
        text_runs = grams(texts, text_id, "i", ref_runs)
    else:
        text_runs = grams(texts, text_id, "i")
        ref_runs = grams(refs, ref_id, "j", text_runs)
    met = text_runs.join(ref_runs, "gram")
    line = Window.partitionBy(text_id, ref_id, F.col("i") - F.col("j")).orderBy("i")
    met = met.withColumn("island", F.col("i") - F.row_number().over(line))
    islands = met.groupBy(text_id, ref_id, (F.col("i") - F.col("j")).alias("d"), "island").agg(F.min("i").alias("text_start"), F.min("j").alias("ref_start"), F.count(F.lit(1)).alias("n"))
    return islands.select(ref_id, text_id, "text_start", "ref_start", (F.col("n") + min_words - 1).alias("n_words"))


def greedy_runs(maximal: DataFrame, text_id: str, min_words: int = 4) -> DataFrame:
    """Left to right, the longest run at each first open place; kept runs don't overlap.

    Runs are clipped to the words after the last kept one; of those that begin
    first the longest stays if ``min_words`` words are left.
    """
    spans = maximal.groupBy(text_id).agg(F.sort_array(F.collect_set(F.struct(F.col("text_start").alias("s"), (F.col("text_start") + F.col("n_words")).cast("int").alias("e")))).alias("spans"))
    kind = "array<struct<s:int,e:int>>"
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("kept"))

    def step(state: Column, _: Column) -> Column:
        open_ = F.filter(F.transform("spans", lambda x: F.struct(F.greatest(x["s"], state["at"]).alias("s"), (-x["e"]).alias("e"))), lambda x: -x["e"] - x["s"] >= min_words)
        best = F.array_min(open_)
        kept = F.concat(state["kept"], F.array(F.struct(best["s"].alias("s"), (-best["e"]).alias("e"))))
        return F.when(F.size(open_) == 0, state).otherwise(F.struct((-best["e"]).alias("at"), kept.alias("kept")))

    kept = F.aggregate("spans", begin, step, lambda s: s["kept"])
    return spans.select(text_id, F.explode(kept).alias("k")).select(text_id, F.col("k.s").alias("text_start"), (F.col("k.e") - F.col("k.s")).alias("n_words"))
