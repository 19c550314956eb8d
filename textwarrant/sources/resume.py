"""Writing in batches that a later run takes up where an earlier one ended, and writing with a count that has to be met."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

MANIFEST = "batch int, n long, digest long, run int"


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(batch, n, digest, run) of all batches that were ever done under ``path``."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition()):
            raise
        return spark.createDataFrame([], MANIFEST)


def _batch(key: str, batches: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(batches)).cast("int")


def write_batches(rows: DataFrame, path: str, key: str, make: Callable[[DataFrame], DataFrame], batches: int = 64, at_once: int = 8) -> int:
    """Writes ``make`` of the rows under ``path``, batch by batch, and returns how many batches were made.

    Rows are dealt to ``batches`` by a hash of ``key``. A batch whose count and
    digest - over all columns, in any order of rows - stand in the manifest is done
    and not made again; the others are made ``at_once`` at a time, each time
    followed by their lines of the manifest. A run that ends in between loses the batches it was
    at, whose files the next run overwrites; a changed row makes its own batch
    again. The rows are read once for the digests and once each time, so more ``at_once`` are fewer
    reads and more to lose. ``make`` keeps the column ``batch`` and looks at rows of one batch as if there were no others.

    Null keys are one batch's; repeated rows count each; no rows make no batch.
    """
    spark = rows.sparkSession
    dealt = rows.withColumn("batch", _batch(key, batches))
    # a sum and a xor: repeated rows cancel in the one but not in the other
    mark = F.xxhash64(*[F.col(c) for c in rows.columns])
    wanted = dealt.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.xxhash64(F.bit_xor(mark), F.sum((mark % (1 << 31)).cast("long"))).alias("digest"))
    # a line for each batch, of which there are ``batches`` at most
    wanted = {r.batch: (r.n, r.digest) for r in wanted.collect()}
    lines = manifest(spark, path).collect()
    run = 1 + max((r.run for r in lines), default=0)
    held = {r.batch: (r.n, r.digest) for r in sorted(lines, key=lambda r: r.run)}
    gone = [b for b in held if b not in wanted and held[b][0] > 0]
    todo = sorted(b for b, state in wanted.items() if held.get(b) != state)

    def note(done: list[tuple[int, int, int]]) -> None:
        spark.createDataFrame([(*d, run) for d in done], MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")

    for i in range(0, len(todo), at_once):
        some = todo[i : i + at_once]
        states = F.create_map(*[x for b in some for x in (F.lit(b), F.lit(wanted[b][1]))])
        made = make(dealt.filter(F.col("batch").isin(some))).withColumn("digest", F.element_at(states, F.col("batch")))
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "digest").parquet(f"{path}/data")
        note([(b, *wanted[b]) for b in some])
    if gone:
        note([(b, 0, 0) for b in gone])
    return len(todo)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_batches`` made of the rows as they were last, with ``batch``; files of earlier states are not read."""
    last = manifest(spark, path).groupBy("batch").agg(F.max_by(F.struct("n", "digest"), "run").alias("s")).select("batch", "s.*").filter("n > 0")
    data = spark.read.parquet(f"{path}/data")
    return data.join(last.select("batch", F.col("digest").alias("digest")), ["batch", "digest"], "left_semi").drop("digest")


def write_counted(rows: DataFrame, path: str, expected: int) -> None:
    """Writes rows as Parquet; if they are not ``expected`` in number, nothing stays and it is an error.

    They are counted as they are written, without a second look at them.
    """
    spark, seen = rows.sparkSession, Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("errorifexists").parquet(path)
    if (n := seen.get["n"]) != expected:
        place, system = _place(spark, path)
        system.delete(place, True)
        raise ValueError(f"{n} rows where {expected} were expected")
