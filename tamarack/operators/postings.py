"""A maintained inverted index: postings by token on disk, appended segment by segment, searched without the texts.

Layout under a path. `postings`: one row for each token and range of documents: n (its documents in the range), most (its highest
frequency there), least (the shortest of them) and list (id, tf, dl of each), partitioned by segment and a hash of the token.
`documents`: the number and length of each segment's documents. A range has about RANGE_DOCS documents of one segment. Each
append adds a segment and touches no file of the others; compact() merges them and drops removed documents.

Search. Frequencies and bounds are read first, without the lists. A range's bound for a query is the sum over its tokens of the
highest BM25 part that `most` and `least` allow, whatever the mean length has become. The FIRST_RANGES ranges of the highest
bounds are opened; their k-th score is a floor, and only ranges whose bound reaches it are opened then. Nothing is lost by that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.text import terms
from ..sources.tables import keep, small
from . import overlap
from .retrieval import top_k

RANGE_DOCS, BUCKETS, FIRST_RANGES = 256, 64, 4


def _bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def _ranged(docs: DataFrame, segment: int) -> DataFrame:
    """docs: id, tokens (array). The lists of each range of RANGE_DOCS documents as they come, and for each range a row of null token
    with its number of documents and their length. A range is made within one task, so that nothing is shuffled."""
    most, kind = RANGE_DOCS, docs.schema["id"]
    posting = StructType([kind, StructField("tf", IntegerType()), StructField("dl", IntegerType())])
    schema = StructType([
        StructField("token", StringType()), StructField("range", LongType()), StructField("n", LongType()), StructField("most", IntegerType()),
        StructField("least", IntegerType()), StructField("list", ArrayType(posting)), StructField("length", LongType()),
    ])

    def lists(part: pa.Table, number: int) -> pa.RecordBatch:
        tokens = part.column("tokens").combine_chunks()
        found, tf, each = overlap.term_counts(tokens, None)
        dl = np.maximum(1, pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        row = np.repeat(np.arange(len(part)), each)
        names = found.unique()
        code = pc.index_in(found, value_set=names).to_numpy(zero_copy_only=False)
        ids = part.column("id").combine_chunks()
        at = np.lexsort((pc.rank(ids, sort_keys="ascending", tiebreaker="first").to_numpy()[row], code))
        n = np.bincount(code, minlength=len(names))
        first = (np.cumsum(n) - n).astype(np.int64)
        tf, long = tf[at], dl[row][at]
        values = pa.StructArray.from_arrays([ids.take(pa.array(row[at])), pa.array(tf, pa.int32()), pa.array(long, pa.int32())], names=posting.fieldNames())
        best = lambda f, x: f.reduceat(x, first) if len(first) else x
        ends = pa.array([*np.r_[0, np.cumsum(n)].tolist(), len(at)], pa.int32())
        columns = [
            pa.concat_arrays([names.cast(pa.string()), pa.array([None], pa.string())]), pa.array(np.full(len(n) + 1, number)), pa.array(np.r_[n, len(part)], pa.int64()),
            pa.array(np.r_[best(np.maximum, tf), 0], pa.int32()), pa.array(np.r_[best(np.minimum, long), 0], pa.int32()),
            pa.ListArray.from_arrays(ends, values), pa.array(np.r_[np.zeros(len(n), np.int64), dl.sum()], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = (segment << 44) + (TaskContext.get().partitionId() << 20), None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            whole = len(held) - len(held) % most
            for i in range(0, whole, most):
                yield lists(held.slice(i, most), number)
                number += 1
            held = held.slice(whole)
        if held is not None and len(held):
            yield lists(held, number)

    return docs.select("id", "tokens").mapInArrow(run, schema)


def append(docs: DataFrame, path: str, tokens: Callable[[Column], Column] = terms) -> int:
    """Add docs (id, text) as a new segment; its number. Ids of the index must not be repeated. Each text is cut into tokens once."""
    segment = len(_segments(docs.sparkSession, path))
    lists = keep(_ranged(docs.select("id", tokens(F.col("text")).alias("tokens")), segment), "segment-lists")
    sizes = lists.where("token is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length"))
    _write(lists.where("token is not null").drop("length"), sizes, path, segment)
    return segment


def _write(lists: DataFrame, sizes: DataFrame, path: str, segment: int) -> None:
    """A segment's lists, placed by token and range, then its sizes, which make it known. A list holds the documents of one range
    alone; a token's lists are spread over tasks by range."""
    placed = lists.withColumn("segment", F.lit(segment)).withColumn("bucket", _bucket(F.col("token")))
    placed = placed.repartitionByRange("bucket", "token", "range").sortWithinPartitions("bucket", "token", "range")
    placed.write.partitionBy("segment", "bucket").mode("append").parquet(f"{path}/postings")
    sizes.withColumn("segment", F.lit(segment)).coalesce(1).write.mode("append").parquet(f"{path}/documents")


def _segments(spark: SparkSession, path: str) -> list[int]:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/documents")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return []
    return sorted(r.segment for r in spark.read.parquet(f"{path}/documents").select("segment").collect())


def remove(ids: DataFrame, path: str) -> None:
    """Documents (id) that searches leave out from now on; until compact(), frequencies and mean length still count them."""
    ids.select("id").write.mode("append").parquet(f"{path}/removed")


def _removed(spark: SparkSession, path: str) -> DataFrame | None:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/removed")
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.parquet(f"{path}/removed").distinct() if there else None


def compact(spark: SparkSession, path: str, to: str) -> None:
    """Write the index anew under `to`, as one segment without the removed documents, from its postings alone. A document that has
    no token is counted no more."""
    held = spark.read.parquet(f"{path}/postings").select("token", F.explode("list").alias("x")).select("token", "x.*")
    gone = _removed(spark, path)
    held = keep(held if gone is None else held.join(small(gone), "id", "left_anti"), "compacted")
    sizes = held.select("id", "dl").distinct().agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length"))
    spot = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-sizes.first().n // RANGE_DOCS)))).cast("long")
    lists = held.withColumn("range", spot).groupBy("token", "range").agg(
        F.count("*").alias("n"), F.max("tf").alias("most"), F.min("dl").alias("least"), F.array_sort(F.collect_list(F.struct("id", "tf", "dl"))).alias("list"),
    )
    _write(lists, sizes, to, 0)


def _part(n: int, mean: float, tf: str, dl: str, k1: float, b: float) -> Column:
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return idf * F.col(tf) * (k1 + 1) / (F.col(tf) + k1 * (1 - b + b * F.col(dl) / F.lit(mean)))


def search(
    spark: SparkSession, path: str, queries: DataFrame, k: int, tokens: Callable[[Column], Column] = terms, k1: float = 1.2, b: float = 0.75,
    first_ranges: int = FIRST_RANGES,
) -> DataFrame:
    """query_id, id, score and rank: the k documents of the highest BM25 for each query (query_id, text)."""
    q = keep(queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token")), "postings-queries")
    wanted = small(q.select("token").distinct())
    total = spark.read.parquet(f"{path}/documents").agg(F.sum("n").alias("n"), F.sum("length").alias("length")).first()
    if not total.n:
        return queries.select("query_id", F.lit(None).cast("long").alias("id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    n, mean = total.n, total.length / total.n
    postings = spark.read.parquet(f"{path}/postings")
    buckets = [r.bucket for r in q.select(_bucket(F.col("token")).alias("bucket")).distinct().collect()]  # at most BUCKETS
    postings = postings.where(F.col("bucket").isin(buckets))
    heads = keep(postings.select("token", "range", "n", "most", "least").join(wanted, "token"), "postings-heads")
    df = small(keep(heads.groupBy("token").agg(F.sum("n").alias("df")), "postings-frequencies"))
    asked = small(q)
    bounds = heads.join(df, "token").join(asked, "token").groupBy("query_id", "range").agg(F.sum(_part(n, mean, "most", "least", k1, b)).alias("bound"))
    bounds = keep(bounds, "postings-bounds")
    gone = _removed(spark, path)

    def scored(open_: DataFrame) -> DataFrame:
        units = small(keep(open_.select("query_id", "range").join(asked, "query_id").join(heads.select("token", "range"), ["token", "range"]), "postings-open"))
        hits = postings.select("token", "range", "list").join(units, ["token", "range"]).select("query_id", "token", F.explode("list").alias("x"))
        hits = hits.select("query_id", "token", "x.*").join(df, "token")
        found = hits.groupBy("query_id", "id").agg(F.round(F.sum(_part(n, mean, "tf", "dl", k1, b)), 6).alias("score"))
        return found if gone is None else found.join(small(gone), "id", "left_anti")

    best = top_k(bounds, "query_id", "bound", "range", first_ranges).select("query_id", "range")
    floor = top_k(scored(best), "query_id", "score", "id", k).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    able = bounds.join(floor, "query_id", "left").where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - 1e-5))
    return top_k(scored(able), "query_id", "score", "id", k)

