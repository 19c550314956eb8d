"""The corpus pipeline: five stages over documents, each written and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarrant.llm import bpe, langid, linededup, mixing, simhash
from textwarrant.tables import load, materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; null texts and those without letters go, and those far from every learned language.

    Repeated rows stay or go together, texts of any length are looked at whole,
    other columns stay as they are, and an empty table gives an empty one.
    """
    return langid.keep_identified(docs, langid.LEAST)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their source's boilerplate lines; every document stays. n_chars follows the text.

    A null text stays null, an empty one empty, a null source is a source; repeated
    rows count as pages each and all stay. Other columns, whatever their names, stay as they are.
    """
    held = docs.select(F.struct("*").alias("_doc"), "source", "text")
    cleaned = linededup.drop_boilerplate(held)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)}
    return cleaned.select(*[new.get(c, F.col("_doc")[c]).alias(c) for c in docs.columns])


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates by SimHash, as ``op7`` links them: 4-word shingles, 4 bits; that with the smallest id.

    Of repeated rows one stays; a null id comes after all others; null and empty
    texts are one group, as are all texts without words. Texts are hashed
    whole, other columns stay as they are, and an empty table gives an empty one.
    """
    return simhash.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: sources weigh 5, 2, 1 in turn.

    Null and empty texts are taken as often as their source's certain copies; a null
    source is one; rows that repeat id and size are taken together. Other
    columns, whatever their names, stay as they are; an empty table gives an empty one.
    """
    held = docs.select(F.struct("*").alias("_doc"), "doc_id", "text", "source")
    return mixing.take_copies(mixing.mix_sources(held)).select("_doc.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's tokens, packed as 32-bit numbers, and the text that they decode to.

    A null or empty text has no tokens and decodes to the empty one; repeated rows
    and copies are encoded each, texts of any length whole; no rows, no rows.
    """
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.encode(docs, ranks, public_tokenizers.PATTERN, keep=("doc_id", "lang", "source"))
    decoded = bpe.decode(F.col("tokens"), ranks).cast("string")
    return coded.select("doc_id", "lang", "source", F.size("tokens").cast("long").alias("n_tokens"), F.col("packed").alias("tokens"), decoded.alias("text"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", dedup_documents),
    ("mix", mix),
    ("bpe", encode),
]

#: Language identification, SimHash and BPE have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
