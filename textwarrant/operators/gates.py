"""What is kept of a model's answers: nothing it writes is trusted before it is found in the texts that it was shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textwarrant.functions.text import normalize, words


def align_verdicts(verdicts: DataFrame, items: DataFrame, by: str, chunk: int) -> DataFrame:
    """Verdicts of chunks of items, by the items' places; those that name a place outside their chunk go.

    ``verdicts`` has ``by``, chunk_no, number and more; ``items`` ``by``, place (from
    0) and more. An equi-join on the place, chunk_no x chunk + number.
    """
    sizes = items.groupBy(by).agg(F.count(F.lit(1)).alias("_size"))
    kept = verdicts.join(sizes, by).filter((F.col("number") >= 0) & (F.col("number") < F.least(F.lit(chunk), F.col("_size") - F.col("chunk_no") * chunk)))
    return kept.withColumn("place", F.col("chunk_no") * chunk + F.col("number")).drop("chunk_no", "number", "_size").join(items, [by, "place"])


def stance(said: Column, covers_all: Column, has_parts: Column, settles: Column, names_subject: Column) -> Column:
    """A text's stance to a claim: it supports or contradicts only where it covers all of it.

    Support of a part is partial where the parts are named, else related; a
    contradiction of a part counts where the text settles the subject. A text
    that doesn't name a subject without other words is related at most.
    """
    part = ~F.coalesce(covers_all, F.lit(False))
    first = F.when((said == "supports") & part, F.when(has_parts, "partial").otherwise("related")).otherwise(said)
    return (
        F.when(first.isin("supports", "partial") & ~names_subject, "related")
        .when((first == "contradicts") & part, F.when(settles, "contradicts").otherwise("related"))
        .when((first == "contradicts") & ~names_subject, "related")
        .otherwise(first)
    )


def merge_claims(local: DataFrame, claims: DataFrame, by: str) -> DataFrame:
    """Local findings and the claims that were found in the text, each place once.

    Both have ``by``, start and end, half open; ``local`` has verified. Claims that
    touch a verified finding go; of claims that overlap the one that comes first
    in ``claims.place`` stays, and stands for the unverified findings it touches. Claims of a text
    are few: they meet on ``by`` alone, and are compared by their spans there.
    """
    c = claims.select(by, F.col("place").alias("claim"), F.col("start").alias("cs"), F.col("end").alias("ce"))
    touches = (F.col("start") < F.col("ce")) & (F.col("cs") < F.col("end"))
    fixed = c.join(local.filter("verified"), by).filter(touches).select(by, "claim").distinct()
    open_ = c.join(fixed, [by, "claim"], "left_anti")
    spans = open_.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("claim", "cs", "ce"))).alias("all"))
    free = lambda kept, x: ~F.exists(kept, lambda k: (k["cs"] < x["ce"]) & (x["cs"] < k["ce"]))
    none = F.array().cast(spans.schema["all"].dataType)
    kept = F.aggregate("all", none, lambda k, x: F.when(free(k, x), F.concat(k, F.array(x))).otherwise(k))
    accepted = spans.select(by, F.explode(kept).alias("k")).select(by, "k.*")
    replaced = accepted.join(local.filter("not verified"), by).filter(touches).select(by, "start", "end").distinct()
    rest = local.join(replaced, [by, "start", "end"], "left_anti").select(by, "start", "end", F.when(F.col("verified"), "verified").otherwise("local").alias("kind"))
    return rest.unionByName(accepted.select(by, F.col("cs").alias("start"), F.col("ce").alias("end"), F.lit("claim").alias("kind")))


def sentence_as_written(copied: Column, text: Column, least: int = 3) -> Column:
    """A copied sentence as the passage has it; as copied where it crosses sentences; null if the passage lacks it."""
    wanted = normalize(copied)
    parts = F.filter(F.split(F.regexp_replace(text, r"([.!?؟؛:\n])", "$1\u0001"), "\u0001"), lambda p: normalize(p).contains(wanted))
    found = F.coalesce(F.trim(F.get(parts, F.lit(0))), F.when(normalize(text).contains(wanted), F.trim(copied)))
    return F.when(F.size(words(wanted)) >= least, found)


def merge_suggestions(first: Column, second: Column, most: int = 16) -> Column:
    """The suggestions of two kinds, the first kind's before, ``most`` at most."""
    return F.slice(F.concat(first, second), 1, most)


def triaged(claims: DataFrame, sentences: DataFrame, by: str) -> DataFrame:
    """Claims with a text that name a sentence there is and occur in it; each text of a document once, the first.

    ``claims`` has ``by``, sentence (a number), text and subject; ``sentences`` ``by``,
    sentence and said. A claim without its subject's words gets it in front.
    """
    own = claims.withColumn("text", F.trim("text")).filter("text <> ''").join(sentences, [by, "sentence"])
    own = own.filter(F.concat(F.lit(" "), normalize(F.col("said")), F.lit(" ")).contains(F.concat(F.lit(" "), normalize(F.col("text")), F.lit(" "))))
    first = F.row_number().over(Window.partitionBy(by, normalize(F.col("text"))).orderBy("sentence", "text", "subject"))
    own = own.withColumn("rn", first).filter("rn = 1")
    missing = (F.trim("subject") != "") & ~normalize(F.col("text")).contains(normalize(F.col("subject")))
    return own.select(by, "sentence", F.when(missing, F.concat(F.trim("subject"), F.lit(": "), F.col("text"))).otherwise(F.col("text")).alias("text"))


def complete(answers: DataFrame, by: str, index: str, total: Column, needs_text: Column) -> DataFrame:
    """Whether an answer has each index below ``total`` once and a text wherever one is due: (by, complete)."""
    good = F.col(index).isNotNull() & (F.col(index) >= 0) & (F.col(index) < total)
    return answers.groupBy(by).agg(
        ((F.count_distinct(F.when(good, F.col(index))) == F.max(total)) & (F.count(F.lit(1)) == F.max(total)) & ~F.bool_or(needs_text)).alias("complete")
    )


def attribution(claimed: Column, reported: Column) -> Column:
    """Whether a school holds what is claimed of it, by the rulings reported of it (an array)."""
    return F.when(claimed.isNull(), None).when(F.size(F.coalesce(reported, F.array().cast("array<string>"))) == 0, "not_reported").when(F.array_contains(reported, claimed), "matches").otherwise("differs")
