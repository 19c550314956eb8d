"""Dropping lines that a site repeats over its pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarrant.tables import materialize

RATIO = 0.05
MIN_PAGES = 5


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate_lines(docs: DataFrame, host_col: str, text_col: str, ratio: float, min_pages: int) -> DataFrame:
    """(host, drop): the keys of each host's boilerplate lines, as an array.

    A host has at most (mean lines of a page) / ratio such lines, so the arrays
    are short whatever the host's size.
    """
    pages = docs.select(F.col(host_col).alias("host"), F.array_distinct(F.transform(F.filter(_lines(F.col(text_col)), lambda x: F.trim(x) != ""), _key)).alias("keys"))
    counts = pages.select("host", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count(F.lit(1)).alias("pages"))
    counts = counts.filter(F.col("pages") >= min_pages)
    totals = docs.groupBy(F.col(host_col).alias("h")).agg(F.count(F.lit(1)).alias("total"))
    often = counts.join(totals, F.col("host").eqNullSafe(F.col("h"))).filter(F.col("pages") > F.col("total") * F.lit(ratio))
    return often.groupBy("host").agg(F.collect_list("key").alias("drop"))


def drop_boilerplate(
    docs: DataFrame,
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    host_col: str | Column = "source",
    text_col: str = "text",
) -> DataFrame:
    """The documents without the lines that more than ``ratio`` of their host's pages hold.

    Returns the columns of ``docs``, the text now cleaned, and line_count and
    line_dropped, which replace columns of these names. Lines are parted by "\\n" and compared without the spaces at
    their ends; blank lines always stay. A line counts once per page. A line on
    fewer than ``min_pages`` pages stays, whatever its ratio.

    Lines are counted by a 64-bit hash: that another line shares a host's
    boilerplate hash has odds of (boilerplate lines x lines of the host) / 2^64.
    The texts themselves are not shuffled unless the table of drop lists is too
    large to broadcast, by the optimizer's threshold.

    A null text stays null, with 0 lines; an empty one stays empty; a null host
    is a host of its own. A text whose lines all go becomes empty. Repeated rows are
    pages each, and stay; an empty table gives an empty one. Lines of any length are compared whole, by hash.
    """
    host = F.col(host_col) if isinstance(host_col, str) else host_col
    held = docs.select(F.struct(*docs.columns).alias("_row"), host.alias("_host"), F.col(text_col).alias("_text"))
    drops = materialize(boilerplate_lines(held, "_host", "_text", ratio, min_pages).withColumnRenamed("host", "_drop_host"), "line-drops")
    joined = held.join(drops, F.col("_host").eqNullSafe(F.col("_drop_host")), "left")
    lines = _lines(F.col("_text"))
    kept = F.when(F.col("drop").isNull(), lines).otherwise(F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains("drop", _key(x))))
    joined = joined.select("_row", "_text", F.coalesce(F.size(lines), F.lit(0)).alias("line_count"), kept.alias("_kept"))
    text = F.when(F.size("_kept") == F.col("line_count"), F.col("_text")).otherwise(F.array_join("_kept", "\n"))
    columns = [text.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns if c.lower() not in ("line_count", "line_dropped")]
    counted = F.when(F.col("_text").isNull(), 0).otherwise(F.col("line_count"))
    dropped = F.when(F.col("_text").isNull(), 0).otherwise(F.col("line_count") - F.size("_kept"))
    return joined.select(*columns, counted.alias("line_count"), dropped.alias("line_dropped"))
