"""Reading the input tables, and stages written in between."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table, dealt to all cores where it lies in fewer files than there are cores and has less than a split for each.

    A file of one row group is one task's work however long that takes. Tables
    of more bytes or files are read as they are: their rows are never shuffled for this.
    """
    rows = load(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    small = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < cores * split
    return rows.repartition(cores) if small and len(rows.inputFiles()) < cores else rows


#: The folders made for local masters, by application.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset a temporary folder is made, one for each application, which
    goes when the process ends; only a local master can read it, so another one is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="textwarrant-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        found = _own[app]
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """The application's end is the folder's end."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)


def materialize(df: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder, in files of up to ``rows_per_file`` rows where it is given, and read it back.

    Cuts the lineage in a way that survives lost executors, lets later readers
    prune columns, and gives the optimizer a true size, so that it broadcasts
    the table only if it is below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)
    delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)
