"""Shared plumbing of the training-data operators: tables, the shared work folder, Arrow maps."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import new_path, small, spread

__all__ = [
    "WORD_RE", "arrow_map", "bounded_sample", "documents", "materialize", "new_path", "offsets", "ordered", "release",
    "remove", "remove_path", "slices", "small", "table", "tune",
]

#: Words are maximal runs of characters other than these (space, \t \n \v \f \r).
WORD_RE = r"[^\x20\x09-\x0D]+"
#: Text bytes that one numpy step holds at once (a longer single text is one step).
STEP_BYTES = 1 << 20
#: Rows and bytes per Arrow batch (a row of more bytes is a batch of its own).
ARROW_ROWS, ARROW_BYTES = 512, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    df = spark.read.parquet(path)
    return spread(df, path) if name in ("documents", "pages") else df


def tune(spark: SparkSession) -> None:
    """Session settings that the Python stages rely on; they bound a worker's memory and stay set, since plans run later."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def materialize(df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    out = df if parts is None else df.coalesce(parts)
    out.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.tamarack_path = path
    return back


def remove(*frames: DataFrame) -> None:
    """Delete materialized tables that no later plan reads, and let Spark's cleaner drop shuffle files of plans that are gone."""
    for df in frames:
        path = getattr(df, "tamarack_path", None)
        if path:
            remove_path(df.sparkSession, path)
    release(frames[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner find the shuffle files of plans that are gone."""
    gc.collect()
    spark._jvm.System.gc()


def remove_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def slices(batch: pa.RecordBatch, column: str, step: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about `step` text bytes each."""
    import pyarrow.compute as pc

    i = batch.schema.get_field_index(column)
    size = pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False)
    lo = total = 0
    for hi, n in enumerate(size):
        if total and total + n > step:
            yield batch.slice(lo, hi - lo)
            lo, total = hi, 0
        total += int(n)
    if lo < batch.num_rows:
        yield batch.slice(lo)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str, text: str = "text") -> DataFrame:
    """mapInArrow over runs of rows; fn gives a dict of columns in the order of `schema`."""
    tune(df.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    struct = _parse_datatype_string(schema)
    target = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                cols = fn(part)
                arrays = [
                    pa.array(cols[f.name], type=f.type) if not isinstance(
                        cols[f.name], (pa.Array, pa.ChunkedArray),
                    ) else cols[f.name].cast(f.type) for f in target
                ]
                yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return df.mapInArrow(run, struct)


def documents(docs: DataFrame, *columns: str) -> DataFrame:
    """The needed columns only, whatever else the table carries."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *columns)


def bounded_sample(df: DataFrame, key: str, bound: int) -> DataFrame:
    """The `bound` rows of df of the smallest hashes of `key` (narrow rows with distinct keys): the same whatever the partitioning."""
    n = df.count()
    if n <= bound:
        return df
    some = F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int((1.5 * bound + 100) / n * (1 << 30))
    return df.where(some).orderBy(F.pmod(F.xxhash64(key), F.lit(1 << 30)), key).limit(bound)


#: A row's place within its sorted range is the lower part of Spark's increasing id, the range's number the upper part.
PLACE_BITS = 33


def ordered(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """df written in the order of `keys`, with part (the sorted range) and at (the place in it). Ranges are balanced however
    the first key is spread, if the keys together are."""
    r = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.monotonically_increasing_id())
    return materialize(
        r.withColumn("at", F.col("part").bitwiseAND((1 << PLACE_BITS) - 1)).withColumn("part", F.shiftright("part", PLACE_BITS)), name,
    )


def offsets(counts: DataFrame, part: str = "part", n: str = "n", by: tuple[str, ...] = ()) -> DataFrame:
    """counts with base: the sum of n over the parts before (of the same `by`). One row for each part (and `by`)."""
    before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("base", F.coalesce(F.sum(n).over(before), F.lit(0)))
