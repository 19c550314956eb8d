"""Readers and writers of corpora: declared schemas, defaults, explicit order, asserted counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textwarrant.functions import arabic

ENTRY = "text string, match_text string, classification string, index long, source struct<book:string,chapter:string,number:string>, grades array<struct<name:string,grade:string>>"
PASSAGE = "id int, e string, s string, h string, n int, v int, p int, t string"


def classification_of(book: Column) -> Column:
    return F.when(F.concat(arabic.normalize(book), F.lit(" "), book).rlike("(?iu)quran|qur'an|قران|قرآن"), "quran").otherwise("hadith")


def numbered(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """Adds ``name``, the row's place from 0 in ``order``, by counts per range and a prefix sum over them."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    placed = dealt.join(counts, F.col("_part") == F.col("_p"))
    return placed.withColumn(name, F.col("_ahead") + F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1).drop("_part", "_p", "_ahead", "_n")


def read_corpus(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Entries of JSON array files, plain or gz, in the order of the files and then of each array.

    ``entry_id`` is that order: it decides which of equal matches is the first.
    A file is one array and so is read by one task; larger corpora come as JSON
    Lines or Parquet.
    """
    files = [spark.read.schema(ENTRY).json(p, multiLine=True).withColumn("file", F.lit(i)).withColumn("at", F.monotonically_increasing_id()) for i, p in enumerate(paths)]
    rows = numbered(reduce(DataFrame.unionByName, files), ["file", "at"], "entry_id")
    empty = F.lit("")
    book = F.coalesce("source.book", empty)
    return rows.select(
        "entry_id", F.coalesce("classification", classification_of(book)).alias("classification"), book.alias("book"), F.coalesce("source.chapter", empty).alias("chapter"),
        F.coalesce("source.number", empty).alias("number"), "text", F.array_distinct(F.array_compact(F.array(arabic.normalize(F.col("text")), arabic.normalize(F.col("match_text"))))).alias("forms"),
        F.coalesce("grades", F.array().cast("array<struct<name:string,grade:string>>")).alias("grades"),
    )


def read_passages(spark: SparkSession, path: str) -> DataFrame:
    """Passages of JSON Lines, with "" for a heading that is not there; none if the file is not there."""
    try:
        rows = spark.read.schema(PASSAGE).json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], PASSAGE)
    return rows.withColumn("h", F.coalesce("h", F.lit("")))


def read_pages(spark: SparkSession, path: str, book: str | int, book_col: str = "book_id", volume: str = "volume_number", page: str = "page_number") -> DataFrame:
    """A book's pages (v, p, text), in order; rows without numbers or text go. The filter and the columns reach the scan."""
    rows = spark.read.parquet(path).filter(F.col(book_col) == book).select(F.col(volume).cast("string").try_cast("int").alias("v"), F.col(page).cast("string").try_cast("double").try_cast("int").alias("p"), "text")
    return rows.filter(F.col("v").isNotNull() & F.col("p").isNotNull() & (F.col("text") != "")).orderBy("v", "p")


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """(chapter, verse, text) of lines "c|v|text"; blank lines and comments go, and of equal keys the last line stays."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at")).filter("trim(value) <> '' and not startswith(value, '#')")
    part = F.split("value", r"\|", 3)
    rows = lines.select(part[0].cast("int").alias("chapter"), part[1].cast("int").alias("verse"), part[2].alias("text"), "at")
    return rows.groupBy("chapter", "verse").agg(F.max_by("text", "at").alias("text"))


def read_translations(spark: SparkSession, pattern: str, language: str) -> DataFrame:
    """(key, version, ref, text) of the documents in one language; documents are ordered by meta.order, 99 if unset."""
    schema = "meta struct<key:string,language:string,title:string,version:string,order:int>, verses map<string,string>"
    docs = spark.read.schema(schema).json(pattern, multiLine=True).filter(F.col("meta.language") == language)
    return docs.select("meta.key", "meta.version", F.coalesce("meta.order", F.lit(99)).alias("order"), F.explode("verses").alias("ref", "text"))


def read_vectors(spark: SparkSession, path: str, corpus_fingerprint: str) -> DataFrame | None:
    """Vectors as floats, or None if they were made of another corpus."""
    rows = spark.read.parquet(path)
    made_of = rows.select("fingerprint").first()
    if made_of is None or made_of[0] != corpus_fingerprint:
        return None
    return rows.select("id", F.transform("q", lambda x: (x * F.col("scale") / 127).cast("float")).alias("vector"))


def corpus_fingerprint(rows: DataFrame, id_col: str, text_col: str) -> str:
    """A digest of all ids and texts that does not depend on their order in the table, nor gather them."""
    digest = F.conv(F.substring(F.sha2(F.concat_ws("|", F.col(id_col).cast("string"), text_col), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    found = rows.agg(F.sum(digest).alias("s"), F.count(F.lit(1)).alias("n")).first()
    return f"{found['n']}-{found['s'] or 0}"


def pinned(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """A file's content, if its SHA-256 is the one expected; reading fails otherwise."""
    rows = spark.read.format("binaryFile").load(path)
    fine = F.sha2("content", 256) == sha256
    return rows.select("path", F.when(fine, F.col("content")).otherwise(F.raise_error(F.lit(f"{path} is not the file expected"))).alias("content"))


def write_json(df: DataFrame, path: str, gzip: bool = False) -> None:
    df.write.option("compression", "gzip" if gzip else "none").json(path)


def write_passages(df: DataFrame, path: str, order: list[Column | str]) -> None:
    """JSON Lines, compressed, with an id in order from 0."""
    write_json(numbered(df, order, "id"), path, gzip=True)


def write_vectors(df: DataFrame, path: str, fingerprint: str) -> None:
    """Quantised vectors (id, q, scale), with the fingerprint of the corpus they were made of."""
    from textwarrant.operators.retrieve import quantize

    df.select("id", quantize(F.col("vector")).alias("z")).select("id", "z.q", "z.scale", F.lit(fingerprint).alias("fingerprint")).write.parquet(path)
