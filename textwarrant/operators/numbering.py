"""Numbers that run on through a text, and headings that hold for what follows."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textwarrant.functions.text import let, pieces

#: What a title in front of a number looks like: it begins the text or follows a sentence's end, and ends with a colon.
TITLE = r"(?:^|[.)\]»؛])\s*([^.:؛()]{3,90}:\s*)$"
#: Characters before a number in which its title is looked for, and a title's most words.
TITLE_NEAR, TITLE_WORDS = 120, 10


def accepted_numbers(numbers: Column, gap: int = 3, first_most: int = 2) -> Column:
    """The numbers of an array that continue the count: above the last accepted one, by ``gap`` at most.

    The first may be ``first_most`` at most. A fold that carries the last one.
    """
    begin = F.struct(F.lit(0).alias("last"), F.array().cast("array<int>").alias("kept"))

    def step(state: Column, n: Column) -> Column:
        most = F.when(state["last"] == 0, F.lit(first_most)).otherwise(state["last"] + gap)
        taken = F.struct(n.alias("last"), F.concat(state["kept"], F.array(n)).alias("kept"))
        return F.when((n > state["last"]) & (n <= most), taken).otherwise(state)

    return F.aggregate(F.transform(numbers, lambda n: n.cast("int")), begin, step, lambda s: s["kept"])


def numbered_parts(texts: DataFrame, number: str, id_col: str = "doc_id", text_col: str = "text", gap: int = 3, first_most: int = 2) -> DataFrame:
    """(id, number, start, end, heading): the numbered paragraphs of each text, which cover it without gaps.

    ``number`` is a pattern whose first group, and first digits, are a number of up to nine. Of its
    matches those count that continue the count, as in :func:`accepted_numbers`. A title right before a
    number is the paragraph's heading and its beginning; it is looked for behind the
    beginning of the paragraph before only. What stands before the first number
    belongs to the one below it, and a text without numbers is a single part of number 0, an empty
    text too. Null texts have none; repeated rows are told each.
    """
    pattern = re.compile(number)

    def find(value: str) -> Iterable[tuple[int, int]]:
        return (m.span() for m in pattern.finditer(value) if len(m[1]) < 10)

    text = F.col(text_col)
    begin = F.struct(F.lit(0).alias("last"), F.lit(0).alias("place"), F.array().cast("array<struct<number:int,start:int,heading:string>>").alias("kept"))

    def taken(state: Column, n: Column, start: Column) -> Column:
        near = F.greatest(state["place"], start - TITLE_NEAR)
        tail = F.regexp_extract(F.substr(text, near + 1, start - near), TITLE, 1)
        title = F.regexp_replace(tail, r":\s*$", "")

        def with_title(found: Column) -> Column:
            at = start - F.length(found["tail"])
            part = F.struct(n.alias("number"), at.alias("start"), found["title"].alias("heading"))
            return F.struct(n.alias("last"), at.alias("place"), F.concat(state["kept"], F.array(part)).alias("kept"))

        short = F.size(F.split(F.trim(title), r"\s+")) <= TITLE_WORDS
        return let(F.struct(F.when(short, tail).otherwise("").alias("tail"), F.when(short, title).otherwise("").alias("title")), with_title)

    def step(state: Column, hit: Column) -> Column:
        most = F.when((state["last"] == 0) & (F.size(state["kept"]) == 0), F.lit(first_most)).otherwise(state["last"] + gap)
        return F.when((hit["n"] > state["last"]) & (hit["n"] <= most), taken(state, hit["n"], hit["start"])).otherwise(state)

    hits = F.transform(pieces(text, find), lambda x: F.struct(F.regexp_extract(x["text"], r"(\d+)", 1).cast("int").alias("n"), x["start"].alias("start")))
    kept = texts.filter(text.isNotNull()).select(id_col, F.length(text).alias("size"), F.aggregate(hits, begin, step, lambda s: s["kept"]).alias("kept"))
    ends = F.transform("kept", lambda x, i: F.struct(x["number"].alias("number"), x["start"].alias("start"), F.coalesce(F.get("kept", i + 1)["start"], F.col("size")).alias("end"), x["heading"].alias("heading")))
    first = F.get("kept", F.lit(0))
    lead = F.struct(F.coalesce(first["number"] - 1, F.lit(0)).alias("number"), F.lit(0).alias("start"), F.coalesce(first["start"], F.col("size")).alias("end"), F.lit("").alias("heading"))
    parts = F.when(F.coalesce(first["start"] > 0, F.lit(True)), F.concat(F.array(lead), ends)).otherwise(ends)
    return kept.select(id_col, F.inline(parts))


def under_headings(lines: DataFrame, by: str, most_chars: int = 90, section_words: int = 6) -> DataFrame:
    """Body lines with the entry and section that hold for them.

    ``lines`` has ``by``, i and line. A short line that another one follows is a
    heading: of a section if it ends with a colon or has more than
    ``section_words`` words, else of an entry, which ends the section before it.
    Lines ahead of the first entry have none and go.
    """
    order = Window.partitionBy(by).orderBy("i")
    text = F.trim("line")
    rows = lines.filter(text != "").select(by, "i", text.alias("line"), F.lead("i").over(order).isNotNull().alias("followed"))
    heading = (F.length("line") <= most_chars) & F.col("followed")
    section = F.col("line").endswith(":") | (F.size(F.split("line", " +")) > section_words)
    kind = F.when(heading & section, "section").when(heading, "entry").otherwise("body")
    rows = rows.withColumn("kind", kind).withColumn("entry_i", F.when(kind == "entry", F.col("i"))).withColumn("section_i", F.when(kind == "section", F.col("i")))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    name = lambda k: F.last(F.when(F.col("kind") == k, F.regexp_replace("line", ":+$", "")), ignorenulls=True).over(upto)
    last = lambda c: F.last(c, ignorenulls=True).over(upto)
    rows = rows.select(by, "i", "line", "kind", name("entry").alias("entry"), name("section").alias("named"), last("entry_i").alias("ei"), last("section_i").alias("si"))
    return rows.filter("kind = 'body' and entry is not null").select(by, "i", "line", "entry", F.when(F.col("si") > F.col("ei"), F.col("named")).otherwise("").alias("section"))
