"""Lookups by composite keys, complete joins and counts of merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_per_key(rows: DataFrame, keys: Sequence[str], order: str, last: bool) -> DataFrame:
    """The first or last row of each composite key, by ``order``; rows without a part of the key go."""
    fine = rows.dropna(subset=list(keys))
    others = [c for c in rows.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    return fine.groupBy(*keys).agg(pick(F.struct(*others), order).alias("_row")).select(*keys, "_row.*")


def identity(rows: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """The last id of each identity; parts of it may be null and compare as such."""
    return rows.groupBy(*keys).agg(F.max(id_col).alias(id_col))


def complete_join(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: how many keys both sides have, and how many one side alone; equal sets have none of the latter."""
    left, right = a.select(*keys).distinct().withColumn("_a", F.lit(True)), b.select(*keys).distinct().withColumn("_b", F.lit(True))
    both = left.join(right, list(keys), "full")
    counts = [F.count_if(F.col("_a") & F.col("_b")).alias("n_both"), F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b")]
    return both.agg(*counts).withColumn("same_keys", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def most_severe(level: Column, order: Sequence[str]) -> Column:
    """An aggregate: the level that comes last in ``order``; levels that it lacks don't count."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), level)
    return F.max_by(level, F.when(place > 0, place))
