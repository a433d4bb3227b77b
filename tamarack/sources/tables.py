"""Reading tables, and tables that a query writes for itself in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of fewer files than cores and at most so many bytes is dealt over all cores; larger ones are split as they lie.
SPREAD_BYTES = 256 << 20
#: Narrow rows up to which a table is broadcast: tens of MB at most.
BROADCAST_ROWS = 1_000_000


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def spread(df: DataFrame, path: str) -> DataFrame:
    """df, read from `path`, over all cores if it is a small table of few files, which one task would read."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    return df.repartition(cores) if size <= SPREAD_BYTES else df


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as set in spark.checkpoint.dir; a temporary one only where it is unset in local mode."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tamarack-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tamarack-{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: computed once, and safe from lost executors. The table goes when the driver
    ends, or by drop_kept()."""
    spark = df.sparkSession
    path = new_path(spark, f"kept-{name}")
    df.write.parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def drop_kept(spark: SparkSession) -> int:
    """Delete all tables that keep() wrote to the shared folder, for sessions that run many queries and have used their results;
    how many there were. Frames that read them can't be used any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, "tamarack-kept-*")) or []
    for status in found:
        fs.delete(status.getPath(), True)
    return len(found)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it has at most so many rows (counted), to be joined by shuffles otherwise."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Rows of a block that is broadcast against a whole table.
BLOCK_ROWS = 1000


def in_blocks(rows: DataFrame, key: str, most: int = BLOCK_ROWS) -> list[DataFrame]:
    """The rows in blocks of about `most` by a hash of `key`, each to be broadcast."""
    n = rows.count()
    parts = 1 if n <= most else -(-5 * n // (4 * most))
    return [F.broadcast(rows.where(F.pmod(F.xxhash64(key), F.lit(parts)) == i) if parts > 1 else rows) for i in range(parts)]
