"""Tables whose upserts touch only the files of the keys that they change.

A keyed table is partitioned by a hash of its key. An upsert reads and rewrites the partitions of its rows' keys alone: the new
partitions are written to the shared folder first, then put in place by a dynamic partition overwrite, so an upsert that failed
can be run again. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import keep

#: Partitions of a new table; about 128 MB each is a good size, so large tables take more.
BUCKETS = 64
BUCKET = "key_bucket"


def _bucket(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def write_keyed(df: DataFrame, path: str, key: list[str], buckets: int = BUCKETS) -> None:
    df.withColumn(BUCKET, _bucket(key, buckets)).repartition(BUCKET).write.partitionBy(BUCKET).parquet(path)


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


def lookup(spark: SparkSession, path: str, keys: DataFrame, key: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The rows of these keys (a few): only their partitions are read."""
    wanted = keep(keys.select(*key).distinct().withColumn(BUCKET, _bucket(key, buckets)), "keyed-wanted")
    touched = [r[0] for r in wanted.select(BUCKET).distinct().collect()]  # at most `buckets`
    return spark.read.parquet(path).where(F.col(BUCKET).isin(touched)).join(wanted.drop(BUCKET), key, "left_semi").drop(BUCKET)


def upsert_keyed(
    new: DataFrame, path: str, key: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS,
) -> list[int]:
    """Put new rows into the table: merge(old, new) gets the rows of the touched partitions and gives what is to stand there. The
    touched partitions. Keys of merge's rows must lie in the partitions of new's keys."""
    spark = new.sparkSession
    new = keep(new, "keyed-new")
    touched = sorted(r[0] for r in new.select(_bucket(key, buckets).alias("b")).distinct().collect())  # at most `buckets`
    if not touched:
        return []
    old = spark.read.parquet(path).where(F.col(BUCKET).isin(touched)).drop(BUCKET)
    staged = keep(merge(old, new).withColumn(BUCKET, _bucket(key, buckets)), "keyed-staged")
    staged.repartition(BUCKET).write.partitionBy(BUCKET).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    return touched
