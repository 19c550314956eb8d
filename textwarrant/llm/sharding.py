"""Contiguous shards of equal size by global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textwarrant.tables import materialize

OVERHEAD = 16


def shard_by_bytes(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = OVERHEAD) -> DataFrame:
    """Each document's shard and its slot there; shard sizes in bytes are near equal.

    Returns id_col, size, text_crc32, shard and slot. The order is that of the
    text's hash, then of id, so equal texts stand together and share a shard,
    and the shards hold a random order of the texts. Documents are dealt by
    range into partitions; each partition's total gives, by a prefix sum over
    one row per partition, the bytes that lie ahead of it; inside a partition a
    running sum follows. A group of equal texts goes to the shard in whose equal
    stretch of bytes the middle of its first document lies. A shard thus misses
    its target by half a document at either end, and by the group at its end; a
    group is never split, so one larger than a shard makes its shard larger.

    Only ids, hashes and sizes are shuffled. A group of copies may lie across
    partitions: where the first group of one goes on from the one before, the
    table of partitions says where it began.

    A null text has the size ``overhead`` and no checksum, and nulls are one
    group; so are empty texts. Repeated rows are a group. No row, no shard.
    Texts of any length count whole; other columns are not looked at, whatever their names.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    slim = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.struct(F.coalesce(F.xxhash64(text), F.lit(0)).alias("h"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("c"), text.isNull().alias("z")).alias("g"),
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = slim.repartitionByRange(parts, "g", "id").withColumn("pid", F.spark_partition_id())
    dealt = materialize(dealt, "shard-ranges")

    # one row per partition
    ends = dealt.groupBy("pid").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min("g").alias("first_g"), F.max("g").alias("last_g"))
    tails = dealt.join(ends.select("pid", F.col("last_g")), "pid").filter(F.col("g") == F.col("last_g"))
    tails = tails.groupBy("pid").agg(F.sum("size").alias("tail_bytes"), F.min(F.struct("id", "size"))["size"].alias("tail_first"))
    order = Window.orderBy("pid")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.join(tails, "pid")
    ends = ends.withColumn("bytes_ahead", F.coalesce(F.sum("bytes").over(before), F.lit(0))).withColumn("rows_ahead", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    ends = ends.withColumn("total", F.sum("bytes").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    # the middle of the first row of each partition's last group; a partition of one group may go on from the one before
    opens = ~((F.col("first_g") == F.col("last_g")) & F.coalesce(F.lag("last_g").over(order) == F.col("first_g"), F.lit(False)))
    ends = ends.withColumn("opened", F.when(opens, F.col("bytes_ahead") + F.col("bytes") - F.col("tail_bytes") + F.col("tail_first") / 2))
    ends = ends.withColumn("begun", F.last("opened", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ends = ends.withColumn("goes_on", F.lag("last_g").over(order) == F.col("first_g")).withColumn("came_from", F.lag("begun").over(order))
    ends = ends.select("pid", "bytes_ahead", "rows_ahead", "total", F.when(F.col("goes_on"), F.col("first_g")).alias("open_g"), "came_from")

    rows = dealt.join(materialize(ends, "shard-partitions"), "pid")
    inside = Window.partitionBy("pid").orderBy("g", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("at", F.col("bytes_ahead") + F.sum("size").over(inside) - F.col("size"))
    rows = rows.withColumn("row", F.col("rows_ahead") + F.row_number().over(Window.partitionBy("pid").orderBy("g", "id", "size")) - 1)
    in_group = Window.partitionBy("pid", "g").orderBy("id", "size").rowsBetween(Window.unboundedPreceding, 0)
    began = F.when(F.col("g") == F.col("open_g"), F.col("came_from")).otherwise(F.first(F.col("at") + F.col("size") / 2).over(in_group))
    rows = rows.withColumn("shard", F.floor(began * F.lit(shards) / F.col("total")).cast("int"))
    rows = materialize(rows.select("id", "size", "crc", "shard", "row"), "shard-rows")
    heads = materialize(rows.groupBy("shard").agg(F.min("row").alias("head")), "shard-heads")
    return rows.join(heads, "shard").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("row") - F.col("head")).alias("slot")
    )
