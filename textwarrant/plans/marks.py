"""Queries of signed serials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarrant.functions import serial
from textwarrant.plans.registry import query
from textwarrant.tables import load_spread as load

#: A key for the queries below; a service has its own.
KEY = bytes(range(32))


@query("""select doc_id, true as valid, date '2026-01-01' + (doc_id % 100)::int as "day", true as text_matches, false as other_matches, 'not_issued' as forged, true as mended from documents where text is not null""")
def signed_serials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document signed, checked against its own and another text and another key, and mended after a misreading."""
    docs = load(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "text")
    day = F.date_add(F.lit("2026-01-01").cast("date"), (F.col("doc_id") % 100).cast("int"))
    signed = docs.select("doc_id", "text", serial.sign(F.col("text"), day, KEY).alias("serial"))
    # the first sign that can be misread, behind the prefix
    at = F.regexp_instr(F.substring("serial", 6, 100), F.lit("[S5Z2G6IL]"))
    sign = F.substr("serial", at + 5, F.lit(1))
    misread = F.when(at > 0, F.concat(F.substr("serial", F.lit(1), at + 4), F.translate(sign, "S5Z2G6IL", "5S2Z6GLI"), F.substr("serial", at + 6, F.lit(100)))).otherwise(F.col("serial"))
    own = serial.check(F.col("serial"), F.col("text"), KEY)
    other = serial.check(F.col("serial"), F.concat("text", F.lit("!")), KEY)
    forged = serial.check(F.col("serial"), F.col("text"), KEY[::-1])
    return signed.select(
        "doc_id", own["valid"].alias("valid"), own["day"].alias("day"), own["text_matches"].alias("text_matches"), other["text_matches"].alias("other_matches"),
        forged["reason"].alias("forged"), (serial.mend(misread, KEY) == F.col("serial")).alias("mended"),
    )
