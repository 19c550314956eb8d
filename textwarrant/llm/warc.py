"""WARC archives: writing with revisits, reading by boundary chains."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textwarrant.tables import fresh_path, materialize

MAGIC = "WARC/1.1\r\n"
BREAK = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORD_ID = "urn:x-page:"
RECORDS_PER_FILE = 4000


def sha1_base32(payload: Column) -> Column:
    """The bare upper-case base32 SHA-1 of a binary column."""

    def letters(digest: Column) -> Column:
        def letter(i: Column) -> Column:
            pair = F.conv(F.substr(digest, F.floor(i * 5 / 4).cast("int") + 1, F.lit(2)), 16, 10).cast("int")
            return F.substr(F.lit(BASE32), F.call_function("shiftright", pair, 3 - i * 5 % 4).bitwiseAND(F.lit(31)) + 1, F.lit(1))

        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), letter), "")

    # as an array's element the digest is made once, not for every letter
    return F.get(F.transform(F.array(F.sha1(payload)), letters), F.lit(0))


def _line(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(name + ": "), value, F.lit("\r\n"))).otherwise(F.lit(""))


def write_warc(pages: DataFrame, path: str, least_revisit: int = 0, records_per_file: int = RECORDS_PER_FILE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """One record per page, as uncompressed WARC files under ``path``.

    Of records with equal payloads of at least ``least_revisit`` bytes that with
    the largest id is the response and the others revisit it: they hold the HTTP
    head and no payload. Payloads are compared by length and SHA-1. The table of
    repeated payloads is joined to the pages; it is broadcast only if it is small.

    The text writer ends each record with the blank line that the format asks
    for. A null payload is an empty one. A null id or url is left out of its
    record. Rows repeated with the largest id are all responses.
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.regexp_replace(F.col(url_col), r"[\r\n]", "").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", sha1_base32(F.col("payload").cast("binary"))).withColumn("bytes", F.octet_length("payload").cast("long"))
    again = rows.filter(F.col("bytes") >= least_revisit).groupBy("digest", "bytes").agg(F.max("id").alias("newest"), F.count(F.lit(1)).alias("n"))
    again = materialize(again.filter("n > 1").select(F.col("digest").alias("d"), F.col("bytes").alias("b"), "newest"), "warc-repeated")
    rows = rows.join(again, (F.col("digest") == F.col("d")) & (F.col("bytes") == F.col("b")), "left")
    revisit = F.col("newest").isNotNull() & ~F.col("id").eqNullSafe(F.col("newest"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), _line("Content-Length", F.col("bytes").cast("string")), F.lit("\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    rid = lambda c: F.concat(F.lit(f"<{RECORD_ID}"), c.cast("string"), F.lit(">"))
    record = F.concat(
        F.lit(MAGIC),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", rid(F.col("id"))),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _line("WARC-Refers-To", F.when(revisit, rid(F.col("newest")))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _line("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
        F.col("block"),
    )
    rows.withColumn("block", block).select(record.alias("value")).write.option("lineSep", BREAK).option("maxRecordsPerFile", records_per_file).text(path)


def _candidates(spark: SparkSession, path: str) -> DataFrame:
    """What lies between two magics, anywhere in a file: one row each, with the record it would be.

    The text source splits files among tasks and cuts them at the magic, inside
    payloads as well. ``mid`` tells rows apart and follows the order in a split.
    """
    rows = spark.read.option("lineSep", MAGIC).text(path)
    head = F.substring_index("value", BREAK, 1)
    return rows.select(
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("mid"),
        F.octet_length("value").cast("long").alias("size"),
        F.octet_length(head).cast("long").alias("head_size"),
        F.regexp_extract(head, r"(?im)^Content-Length:\s*(\d{1,18})\s*$", 1).try_cast("long").alias("content_size"),
        F.col("value").cast("binary").alias("bytes"),
    )


def _located(pieces: DataFrame) -> DataFrame:
    """Adds each piece's offset and the offset where the record would end.

    A split's pieces lie behind those of the file's earlier splits: prefix sums
    over one row per split, then a running sum inside each split.
    """
    slim = pieces.select("file", "split", "mid", (F.col("size") + len(MAGIC)).alias("size"), "head_size", "content_size")
    splits = slim.groupBy("file", "split").agg(F.sum("size").alias("total"))
    ahead = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(F.col("file").alias("f"), F.col("split").alias("s"), F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("ahead"))
    slim = slim.join(splits, (F.col("file") == F.col("f")) & (F.col("split") == F.col("s")))
    inside = Window.partitionBy("file", "split").orderBy("mid").rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("ahead") + F.sum("size").over(inside) - F.col("size") - len(MAGIC)
    end = F.col("start") + len(MAGIC) + F.col("head_size") + len(BREAK) + F.col("content_size") + len(BREAK)
    return slim.withColumn("start", start).select("file", "mid", "start", end.alias("end"))


def _reachable(located: DataFrame) -> DataFrame:
    """(file, start) of the records that a chain of ends reaches from the file's start, by pointer jumping.

    After k rounds a pointer spans 2^k records and the first 2^k are marked; a
    file of n candidates takes log2(n) rounds.
    """
    chain = located.filter("start >= 0").select("file", "start", F.col("end").alias("jump"), (F.col("start") == 0).alias("seen"))
    chain = materialize(chain, "warc-chain")
    most = chain.groupBy("file").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    for _ in range(math.ceil(math.log2(most)) if most > 1 else 0):
        ahead = chain.select(F.col("file").alias("f"), F.col("start").alias("s"), F.col("jump").alias("further"))
        met = chain.filter("seen and jump is not null").select(F.col("file").alias("mf"), F.col("jump").alias("ms"))
        chain = (
            chain.join(ahead, (F.col("file") == F.col("f")) & (F.col("jump") == F.col("s")), "left")
            .join(met, (F.col("file") == F.col("mf")) & (F.col("start") == F.col("ms")), "left")
            .select("file", "start", F.col("further").alias("jump"), (F.col("seen") | F.col("ms").isNotNull()).alias("seen"))
        )
        chain = materialize(chain, "warc-chain")
    return chain.filter("seen").select("file", "start")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives under ``path``.

    Returns record_id, record_type, target_uri, refers_to, payload (binary, null
    for revisits), payload_bytes and payload_digest. Tasks emit each magic as a
    candidate with the offset at which its record would end; of these only the
    chain from each file's start is kept, so that a magic inside a payload makes
    no record. Such payloads are put together again from their pieces. A chain
    that a damaged length breaks ends there.

    A revisit tells its payload's size by its HTTP head and its digest by the
    record's. Payloads of any length are read whole, empty ones too; no files, no records.
    """
    pieces = materialize(_candidates(spark, path), "warc-pieces")
    located = materialize(_located(pieces), "warc-located")
    seen = _reachable(located).withColumn("real", F.lit(True))
    order = Window.partitionBy("file").orderBy("start")
    owned = located.join(seen, ["file", "start"], "left").withColumn("record", F.last(F.when(F.col("real"), F.col("start")), ignorenulls=True).over(order))
    owned = owned.withColumn("pieces", F.when(F.col("record").isNotNull(), F.count(F.lit(1)).over(Window.partitionBy("file", "record"))))
    odd = owned.filter("record is null or pieces > 1").select(F.col("mid").alias("odd_mid"), "record", "start", F.col("file").alias("of_file"))
    odd = materialize(odd, "warc-pieced")
    single = pieces.join(odd, F.col("mid") == F.col("odd_mid"), "left_anti").select("bytes")
    several = pieces.join(odd.filter("record is not null"), F.col("mid") == F.col("odd_mid"))
    several = several.groupBy("of_file", "record").agg(F.sort_array(F.collect_list(F.struct("start", F.hex("bytes").alias("hex")))).alias("all"))
    several = several.select(F.unhex(F.array_join(F.transform("all", lambda p: p["hex"]), MAGIC.encode().hex())).alias("bytes"))
    return _parsed(single.unionByName(several))


def _parsed(records: DataFrame) -> DataFrame:
    text = F.col("bytes").cast("string")
    head = F.substring_index(text, BREAK, 1)
    field = lambda name: F.nullif(F.regexp_extract("head", rf"(?im)^{name}:[ \t]*(.*?)[ \t\r]*$", 1), F.lit(""))
    rows = records.withColumn("head", head)
    rows = rows.withColumn("block", F.substr("bytes", F.octet_length("head") + len(BREAK) + 1, field("Content-Length").cast("int")))
    http = F.substring_index(F.col("block").cast("string"), BREAK, 1)
    rows = rows.withColumn("http", http).withColumn("payload", F.substr("block", F.octet_length("http") + len(BREAK) + 1))
    kind = field("WARC-Type")
    revisit = kind == "revisit"
    told = F.regexp_extract("http", r"(?im)^Content-Length:[ \t]*(\d+)", 1).try_cast("long")
    return rows.select(
        F.regexp_extract(field("WARC-Record-ID"), "<(.*)>", 1).alias("record_id"),
        kind.alias("record_type"),
        field("WARC-Target-URI").alias("target_uri"),
        F.regexp_extract(field("WARC-Refers-To"), "<(.*)>", 1).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"),
        F.when(revisit, told).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.regexp_extract(field("WARC-Payload-Digest"), "sha1:(.*)", 1)).otherwise(sha1_base32(F.col("payload"))).alias("payload_digest"),
    )


def round_trip(pages: DataFrame, least_revisit: int = 0) -> DataFrame:
    """``read_warc`` of what ``write_warc`` writes in the shared folder."""
    path = fresh_path(pages.sparkSession, "warc")
    write_warc(pages, path, least_revisit)
    return read_warc(pages.sparkSession, path)


def page_id(record_id: Column) -> Column:
    return F.regexp_extract(record_id, f"^{RECORD_ID}(-?[0-9]+)$", 1).try_cast("long")
