"""Parsing: HTML, labelled records, strict JSON, references, payloads, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Labels of a graded narration.
LABELS = {"الراوي": "narrator", "المحدث": "scholar", "المصدر": "source", "الصفحة أو الرقم": "page", "خلاصة حكم المحدث": "grade"}


def html_text(html: Column) -> Column:
    """Text between tags, entities resolved, white space made single spaces."""
    text = F.translate(unescape(F.regexp_replace(html, "<[^>]+>", " ")), "\u00a0", " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def unescape(text: Column) -> Column:
    """All entities of HTML 5, by Python's table; Spark has none."""

    def of(texts):
        import html

        return texts.map(lambda t: None if t is None else html.unescape(t))

    return F.pandas_udf(of, StringType())(text)


def labelled(text: Column) -> Column:
    """map<label, value>: each value goes on to the next label; spaces, bars and dashes at its ends go."""
    names = "|".join(sorted(LABELS, key=len, reverse=True))
    parts = F.regexp_extract_all(text, F.lit(rf"({names})\s*:(.*?)(?=(?:{names})\s*:|$)"), F.lit(0))
    table = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    pair = lambda p: F.struct(
        F.element_at(table, F.regexp_extract(p, rf"^({names})", 1)).alias("k"),
        F.regexp_replace(F.regexp_replace(p, rf"^(?:{names})\s*:", ""), r"^[ |\-]+|[ |\-]+$", "").alias("v"),
    )
    return F.map_from_entries(F.transform(parts, pair))


def strict_claims(answer: Column) -> Column:
    """The trimmed, non-empty strings of {"claims": [...]}; null where the answer has another shape."""
    parsed = F.from_json(answer, "claims array<string>, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    # possessive: Java's matcher calls itself for each turn of a loop that it may take back, and a long string ends its stack
    said = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"\s*+'
    shape = F.regexp_like(answer, F.lit(rf'^\s*\{{\s*"claims"\s*:\s*\[\s*(?:{said}(?:,\s*{said})*+)?\]\s*\}}\s*$'))
    return F.when(shape & parsed["_bad"].isNull() & parsed["claims"].isNotNull(), F.filter(F.transform(parsed["claims"], lambda c: F.trim(c)), lambda c: c != ""))


def reference(text: Column, most: int = 12) -> Column:
    """array<string> of the rows that "s:a" or "s:a-b" names; null where it names none, or more than ``most``."""
    part = lambda i: F.nullif(F.regexp_extract(text, r"^\s*(\d{1,3}):(\d{1,3})(?:-(\d{1,3}))?\s*$", i), F.lit("")).cast("int")
    chapter, first = part(1), part(2)
    last = F.coalesce(part(3), first)
    fine = chapter.between(1, 114) & (first >= 1) & (last >= first) & (last - first < most)
    return F.when(fine, F.transform(F.sequence(first, F.when(fine, last).otherwise(first)), lambda i: F.concat(chapter.cast("string"), F.lit(":"), i.cast("string"))))


def image_payload(url: Column, most: int = 3_000_000) -> Column:
    """struct<kind, bytes, error> of a data URL."""
    pattern = r"^data:image/(png|jpeg|webp);base64,([A-Za-z0-9+/=]+)$"
    body = F.regexp_extract(url, pattern, 2)
    size = F.floor(F.length(body) * 3 / 4)
    raw = F.try_to_binary(body, F.lit("base64"))
    error = F.when(~url.rlike(pattern), "not an image").when(size > most, "too large").when(raw.isNull(), "not base64")
    return F.struct(F.when(error.isNull(), F.regexp_extract(url, pattern, 1)).alias("kind"), F.when(error.isNull(), F.octet_length(raw)).alias("bytes"), error.alias("error"))


def pack_day(day: Column) -> Column:
    """Days since 2026-01-01, with the bit that says the review was a full one."""
    return F.datediff(day, F.lit("2026-01-01").cast("date")).bitwiseOR(F.lit(0x8000))


def unpack_day(packed: Column) -> Column:
    return F.date_add(F.lit("2026-01-01").cast("date"), packed.bitwiseAND(F.lit(0x7FFF)))


def fingerprint(text: Column) -> Column:
    """The first 16 bytes of the text's SHA-256."""
    return F.substr(F.unhex(F.sha2(text.cast("binary"), 256)), F.lit(1), F.lit(16))


def plain_number(value: Column) -> Column:
    """A whole number without its ".0"."""
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))
