"""Stretches of text: overlap, subtraction, suppression, selection, edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRIM = r"^[ \t\r\n،؛:.!؟]+|[ \t\r\n،؛:.!؟]+$"
LEAD = r"^[ \t\r\n،؛:.!؟]+"


def overlap(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Characters that [a, b) and [c, d) share."""
    return F.greatest(F.lit(0), F.least(b, d) - F.greatest(a, c))


def subtract(spans: DataFrame, cuts: DataFrame, by: list[str], keep: list[str] | None = None) -> DataFrame:
    """What ``cuts`` leave of ``spans`` (start, end): one row per remaining stretch.

    Cuts meet spans by their document; each span then goes through its cuts in
    order, with the furthest end so far. A span that no cut touches stays whole
    (``whole``).
    """
    left = spans.select(*by, *(keep or []), "start", "end")
    right = cuts.select(*by, F.col("start").alias("c"), F.col("end").alias("d"))
    held = left.join(right, by, "left").withColumn("cut", F.when((F.col("c") < F.col("end")) & (F.col("d") > F.col("start")), F.struct(F.greatest("start", "c").alias("s"), F.least("end", "d").alias("e"))))
    held = held.groupBy(*by, *(keep or []), "start", "end").agg(F.sort_array(F.collect_list("cut")).alias("cuts"))
    kind = "array<struct<start:int,end:int>>"
    begin = F.struct(F.col("start").cast("int").alias("at"), F.array().cast(kind).alias("left"))
    last = F.struct(F.col("end").cast("int").alias("s"), F.col("end").cast("int").alias("e"))
    all_cuts = F.concat(F.transform("cuts", lambda c: F.struct(c["s"].cast("int").alias("s"), c["e"].cast("int").alias("e"))), F.array(last))

    def step(state: Column, cut: Column) -> Column:
        piece = F.struct(state["at"].alias("start"), cut["s"].alias("end"))
        return F.struct(F.greatest(state["at"], cut["e"]).alias("at"), F.when(cut["s"] > state["at"], F.concat(state["left"], F.array(piece))).otherwise(state["left"]).alias("left"))

    left_ = F.aggregate(all_cuts, begin, step, lambda s: s["left"])
    rows = held.select(*by, *(keep or []), (F.size("cuts") == 0).alias("whole"), F.explode(left_).alias("r"))
    return rows.select(*by, *(keep or []), "whole", F.col("r.start").alias("start"), F.col("r.end").alias("end"))


def trimmed(text: Column, start: Column, end: Column) -> Column:
    """struct<start, end> of a stretch without the spaces and stops at its ends."""
    piece = F.substr(text, start + 1, end - start)
    lead = F.length(piece) - F.length(F.regexp_replace(piece, LEAD, ""))
    return F.struct((start + lead).alias("start"), (start + lead + F.length(F.regexp_replace(piece, TRIM, ""))).alias("end"))


def suppress(rows: DataFrame, by_rows: DataFrame, by: list[str], share: float = 0.0) -> DataFrame:
    """Rows (start, end) that no other row of the same document covers by more than ``share`` of their length."""
    others = by_rows.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("start").alias("_s"), F.col("end").alias("_e"))
    same = [rows[c] == others[f"_{c}"] for c in by]
    shared = overlap(F.col("start"), F.col("end"), F.col("_s"), F.col("_e"))
    covered = (shared > 0) & (shared >= (F.col("end") - F.col("start")) * F.lit(share))
    condition = covered
    for s in same:
        condition = condition & s
    return rows.join(others, condition, "left_anti")


def greedy(rows: DataFrame, by: list[str], order: list[Column], payload: list[str]) -> DataFrame:
    """Rows (start, end) taken in ``order``, each unless it overlaps one taken before.

    A document's rows are one array and the choice is a fold over it.
    """
    item = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col("start"), F.col("end"), *payload)
    held = rows.groupBy(*by).agg(F.sort_array(F.collect_list(item)).alias("items"))
    kind = held.schema["items"].dataType.simpleString()

    def step(taken: Column, x: Column) -> Column:
        clash = F.exists(taken, lambda t: (t["start"] < x["end"]) & (t["end"] > x["start"]))
        return F.when(clash, taken).otherwise(F.concat(taken, F.array(x)))

    kept = F.aggregate("items", F.array().cast(kind), step)
    return held.select(*by, F.explode(kept).alias("x")).select(*by, "x.start", "x.end", *[F.col(f"x.{p}").alias(p) for p in payload])


def apply_edits(text: Column, edits: Column) -> Column:
    """The text with edits (array<struct<start, end, to>>) applied from its end backwards, then tidied.

    Of two edits that overlap the one nearer to the end is applied.
    """
    order = F.reverse(F.sort_array(edits))
    begin = F.struct(text.alias("t"), F.length(text).alias("edge"))

    def step(state: Column, e: Column) -> Column:
        cut = F.concat(F.substr(state["t"], F.lit(1), e["start"]), e["to"], F.substr(state["t"], e["end"] + 1, F.length(state["t"])))
        return F.when(e["end"] > state["edge"], state).otherwise(F.struct(cut.alias("t"), e["start"].alias("edge")))

    done = F.aggregate(order, begin, step, lambda s: s["t"])
    for pattern, to in ((r"[ \t]{2,}", " "), (r"\s+([.،])", "$1"), (r"،(?:\s*\.)+", "."), (r"([.!؟?])(?:\s*\.)+", "$1"), (r"^[\s.،]+", "")):
        done = F.regexp_replace(done, pattern, to)
    return F.trim(done)
