"""Rows in order: windows of consecutive rows, offsets, carried values, as-of lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textwarrant.functions.text import normalize, words


def consecutive_windows(rows: DataFrame, group: str, place: str, text: str, most: int = 5) -> DataFrame:
    """All runs of 2 to ``most`` rows of a group whose places follow one another, with their texts joined.

    Returns group, first, last, n and text. A gap ends a run.
    """
    ahead = Window.partitionBy(group).orderBy(place)
    found = rows.select(group, place, text, *[F.lead(place, i).over(ahead).alias(f"p{i}") for i in range(1, most)], *[F.lead(text, i).over(ahead).alias(f"t{i}") for i in range(1, most)])
    options = [
        F.when(
            F.col(f"p{n - 1}") == F.col(place) + (n - 1),
            F.struct(F.lit(n).alias("n"), F.concat_ws(" ", text, *[f"t{i}" for i in range(1, n)]).alias("text")),
        )
        for n in range(2, most + 1)
    ]
    runs = found.select(group, F.col(place).alias("first"), F.explode(F.filter(F.array(*options), lambda x: x.isNotNull())).alias("run"))
    return runs.select(group, "first", (F.col("first") + F.col("run.n") - 1).alias("last"), F.col("run.n").alias("n"), F.col("run.text").alias("text"))


def running_offset(rows: DataFrame, group: str, place: str, text: str) -> DataFrame:
    """Where each row's text begins when a group's texts are joined by one character."""
    ahead = Window.partitionBy(group).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(group, place, F.coalesce(F.sum(F.length(text) + 1).over(ahead), F.lit(0)).alias("offset"))


def with_predecessor(rows: DataFrame, by: str, id_col: str, text_col: str = "text") -> DataFrame:
    """Rows that have one before them in their group, in order of ids, with its text as ``before``; ids are unique.

    Only ids are sorted within a group, whatever its size; the texts meet in a join.
    """
    ahead = rows.select(by, id_col).withColumn("_before", F.lag(id_col).over(Window.partitionBy(by).orderBy(id_col)))
    pairs = ahead.filter(F.col("_before").isNotNull()).select(id_col, "_before")
    texts = rows.select(F.col(id_col).alias("_before"), F.col(text_col).alias("before"))
    return rows.join(pairs, id_col).join(texts, "_before").drop("_before")


def carried_head(rows: DataFrame, group: str, place: str, value: str) -> DataFrame:
    """The place where each row's value was first stated: an empty value, or the same again, goes on with the last."""
    order = Window.partitionBy(group).orderBy(place)
    stated = rows.withColumn("_v", F.nullif(F.coalesce(F.col(value), F.lit("")), F.lit("")))
    stated = stated.withColumn("_held", F.last("_v", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    new = F.col("_v").isNotNull() & ~F.col("_v").eqNullSafe(F.col("_held")) | (F.row_number().over(order) == 1)
    stated = stated.withColumn("_head", F.when(new, F.col(place)))
    return stated.select(group, place, F.last("_head", ignorenulls=True).over(order).alias("head"))


def as_of(left: DataFrame, right: DataFrame, group: str, at: str, left_id: str, value: str) -> DataFrame:
    """The last ``value`` of ``right`` at or before each row of ``left`` in its group; null where there is none.

    One pass over both, sorted together: nothing is paired.
    """
    rows = left.select(group, at, left_id, F.lit(None).alias("_v"), F.lit(1).alias("_side"))
    marks = right.select(group, at, F.lit(None).cast(left.schema[left_id].dataType).alias(left_id), F.struct(value).alias("_v"), F.lit(0).alias("_side"))
    both = rows.withColumn("_v", F.col("_v").cast(marks.schema["_v"].dataType)).unionByName(marks)
    order = Window.partitionBy(group).orderBy(at, "_side", value if value in both.columns else F.col("_v")[value])
    found = both.withColumn("_last", F.last("_v", ignorenulls=True).over(order))
    return found.filter("_side = 1").select(group, at, left_id, F.col("_last")[value].alias(value))


def best_excerpt(texts: DataFrame, query_words: DataFrame, id_col: str, query_id: str, width: int = 45) -> DataFrame:
    """The earliest window of ``width`` words with the greatest sum of query weights.

    ``query_words`` has (query, id, term, weight): the pairs to cut an excerpt
    for. Only words that the query holds are rows.
    """
    tokens = texts.select(id_col, words(normalize(F.col("text"))).alias("w"))
    placed = tokens.select(id_col, F.size("w").alias("n"), F.posexplode("w").alias("i", "term"))
    hits = placed.join(query_words, [id_col, "term"])
    # the earliest window with some hits ends with one of them, or begins the text
    ends = Window.partitionBy(query_id, id_col).orderBy("i").rangeBetween(-(width - 1), 0)
    hits = hits.select(query_id, id_col, "i", "weight", F.sum("weight").over(ends).alias("upto"))
    here = lambda weight, start: F.struct(F.round(weight, 9).alias("weight"), (-start).cast("int").alias("minus"))
    later = F.max(F.when(F.col("i") >= width - 1, here(F.col("upto"), F.col("i") - (width - 1))))
    first = F.sum(F.when(F.col("i") < width, F.col("weight")))
    best = hits.groupBy(query_id, id_col).agg(F.greatest(later, F.when(first.isNotNull(), here(first, F.lit(0)))).alias("b"))
    best = best.select(query_id, id_col, (-F.col("b.minus")).alias("start"), F.col("b.weight").alias("weight"))
    cut = best.join(tokens, id_col)
    return cut.select(query_id, id_col, "start", "weight", F.array_join(F.slice("w", F.col("start") + 1, width), " ").alias("excerpt"), (F.col("start") > 0).alias("more_before"), (F.col("start") + width < F.size("w")).alias("more_after"))


def first_n(rows: DataFrame, by: str, order: list[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows of each group and how many were skipped."""
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    counts = rows.groupBy(by).agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0)).alias("skipped"))
    return ranked.filter(F.col("rn") <= n).join(counts, by)
