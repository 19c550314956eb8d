"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textwarrant.tables import materialize

WORD = r"[^\x20\x09-\x0D]+"
LAST = 1e308


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """One row per source: n, source_size and target.

    ``sizes`` has (source, n, source_size). Sources in code-point order, null
    last, weigh ``weights``, repeating. The total is shared by weight; a target
    stops at ``cap`` times its source's size and the excess goes to the others
    by weight. That ends at min(cap x size, level x weight) for one level: with
    sources in order of cap x size / weight, it is the first level that the
    source itself can take. The windows are over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    held = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    held = held.withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    fill = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    everywhere = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    held = (
        held.withColumn("total", F.sum("source_size").over(everywhere))
        .withColumn("at", F.row_number().over(fill))
        .withColumn("before", F.coalesce(F.sum("most").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("before")) / F.col("left"))
    )
    fits = F.when(F.col("level") <= F.col("most") / F.col("weight"), F.struct("at", "level"))
    level = F.min(fits).over(everywhere)["level"]
    return held.select("source", "n", "source_size", F.least(F.col("most"), F.coalesce(level, F.lit(0.0)) * F.col("weight")).alias("target"))


def _random(doc_id: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the id and the seed only."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _ranked(rows: DataFrame, id_col: str, seed: int) -> DataFrame:
    """Adds copies, rest (words still to take) and xi, the Pareto rank.

    ``rows`` has size, n, source_size and target.
    """
    share = F.col("target") / F.nullif(F.col("source_size"), F.lit(0))
    rows = rows.withColumn("copies", F.coalesce(F.floor(share), F.lit(0)).cast("long"))
    rows = rows.withColumn("part", F.coalesce(share - F.col("copies"), F.lit(0.0)))
    rows = rows.withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
    u = _random(F.col(id_col), seed)
    odds = (F.col("part") * F.col("size") * F.col("n")) / ((F.lit(1.0) - F.col("part")) * F.col("source_size"))
    return rows.withColumn("xi", F.when((F.col("part") > 0) & (F.col("size") > 0), (u / (F.lit(1.0) - u)) / odds).otherwise(F.lit(LAST)))


def _bucket() -> Column:
    """Some sqrt(n) buckets of a source's ranks, in their order."""
    buckets = F.ceil(F.sqrt(F.col("n").cast("double")))
    return F.least(F.floor(F.col("xi") / (F.lit(1.0) + F.col("xi")) * buckets), buckets - 1)


def _cuts(ranked: DataFrame, id_col: str) -> DataFrame:
    """One row per source: last bucket and, inside it, the last document taken.

    Ranks are summed in sqrt(n) buckets before any window, so that a source of
    n documents puts about sqrt(n) rows into one task, twice.
    """
    ranked = ranked.filter("part > 0").withColumn("bucket", _bucket())
    sums = ranked.groupBy("source", "bucket").agg(F.sum("size").alias("size"), F.first("rest").alias("rest"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("size").over(ahead), F.lit(0)))
    last = sums.filter(F.col("ahead") <= F.col("rest")).groupBy("source").agg(F.max(F.struct("bucket", "ahead")).alias("last"))
    last = last.select("source", F.col("last.bucket").alias("last_bucket"), F.col("last.ahead").alias("ahead"))
    inside = ranked.join(last.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).filter("bucket = last_bucket")
    upto = Window.partitionBy("source").orderBy("xi", id_col, "size").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("middle", F.col("ahead") + F.sum("size").over(upto) - F.col("size") / 2)
    taken = F.when(F.col("middle") <= F.col("rest"), F.struct("xi", F.col(id_col).alias("id"), "size"))
    return inside.groupBy("source", "last_bucket").agg(F.max(taken).alias("last_taken"))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    cap: float = 3.0,
    seed: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Every document with the number of its copies in the mix.

    Returns the columns of ``docs`` and mix_size, mix_source_size, mix_target,
    mix_copies and mix_taken (the last: size x copies), which replace columns
    of these names.

    A document's size is its number of words. Sources share the total size by
    ``weights`` (see ``source_targets``). A source whose target is f times its
    size takes floor(f) certain copies of each document; the words that remain
    are a Pareto order sample: documents are ranked by the odds of a random
    number over the odds of their inclusion, which are in proportion to their
    size and those of f - floor(f) for one of mean size, and taken in that order
    up to the document whose middle word is the last one wanted. So a source
    misses its target by half of one document at most.

    The texts are never shuffled: per source only a cut through the ranks is
    found, from ids and sizes, and each document is then held against it.

    A null or empty text has size 0 and takes floor(f) copies of nothing; a null
    source is a source, the last one; texts of any length count whole; rows repeated with one id and size share a
    rank and are taken together. An empty table gives an empty table.
    """
    size = word_count(F.col(text_col))
    slim = materialize(docs.select(F.col(source_col).alias("source"), F.col(id_col).alias(id_col), size.alias("size")), "mix-sizes")
    sizes = slim.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    targets = materialize(source_targets(sizes, weights, cap), "mix-targets")
    same = F.col("source").eqNullSafe(F.col("s"))
    ranked = _ranked(slim.join(targets.withColumnRenamed("source", "s"), same).drop("s"), id_col, seed)
    cuts = materialize(_cuts(ranked, id_col).withColumnRenamed("source", "c"), "mix-cuts")
    plan = targets.join(cuts, F.col("source").eqNullSafe(F.col("c")), "left").drop("c")
    plan = materialize(plan, "mix-plan")
    plan = plan.select(*[F.col(c).alias(f"_mix_{c}") for c in plan.columns])

    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), size.alias("_mix_size"))
    rows = rows.join(plan, F.col("_source").eqNullSafe(F.col("_mix_source")))
    rows = rows.select("_row", "_id", *[F.col(c).alias(c[5:]) for c in rows.columns if c.startswith("_mix_")])
    rows = _ranked(rows, "_id", seed).withColumn("bucket", _bucket())
    here = F.struct("xi", F.col("_id").alias("id"), "size")
    extra = (F.col("part") > 0) & ((F.col("bucket") < F.col("last_bucket")) | ((F.col("bucket") == F.col("last_bucket")) & (here <= F.col("last_taken"))))
    copies = F.col("copies") + F.coalesce(extra, F.lit(False)).cast("long")
    return rows.select(
        *[F.col("_row")[c].alias(c) for c in docs.columns if not c.lower().startswith("mix_")],
        F.col("size").alias("mix_size"),
        F.col("source_size").alias("mix_source_size"),
        F.col("target").alias("mix_target"),
        copies.alias("mix_copies"),
        (F.col("size") * copies).alias("mix_taken"),
    )


def take_copies(mixed: DataFrame) -> DataFrame:
    """The mix itself: each document as many times as ``mix_copies`` says, without the mix's columns."""
    own = [c for c in mixed.columns if not c.startswith("mix_")]
    copies = F.when(F.col("mix_copies") > 0, F.sequence(F.lit(1).cast("long"), F.col("mix_copies")))
    return mixed.select(F.struct(*own).alias("_row"), F.explode(copies)).select("_row.*")
