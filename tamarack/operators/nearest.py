"""The vectors nearest to many queries, exactly, by matrix products over packs of vectors and packs of queries.

A pack pair's cosines are worked out in single precision; those that may be among a query's k best are worked out again in double
precision and rounded to six digits. A task keeps the k best of each query that it has met, so what it passes on does not grow
with the number of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, StructField, StructType

from ..functions.vectors import norm
from ..sources.tables import keep

#: Bytes of a pack of vectors, rows of a pack of queries, bytes of queries that are broadcast at once.
PACK_BYTES, QUERY_ROWS, QUERY_BYTES = 1 << 20, 2048, 64 << 20
#: Rows that a task keeps before it passes them on, and pairs that are worked out again at once.
HELD_ROWS, EXACT_ROWS = 2_000_000, 1 << 16


def _rows(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of one length as a matrix, their lengths, and the unit rows in single precision."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    n = np.sqrt((x * x).sum(1))
    return x, n, (x / n[:, None]).astype(np.float32)


class _Best:
    """The k best rows of each query of a pack, among the vectors met so far."""

    def __init__(self, queries: pa.StructArray, k: int):
        self.k, self.names = k, queries.field("name")
        self.x, self.n, self.unit = _rows(queries.field("embedding"))
        self.floor = queries.field("floor").to_numpy(zero_copy_only=False).astype(np.float64)
        self.floor = np.where(np.isnan(self.floor), -np.inf, self.floor)
        self.slack = 2e-6 + 1.2e-7 * self.x.shape[1]
        self.rows: pa.Table | None = None

    def meet(self, vectors: pa.StructArray) -> None:
        y, m, unit = _rows(vectors.field("embedding"))
        near = self.unit @ unit.T
        low, open_ = self.floor.copy(), np.isinf(self.floor)
        if open_.any() and near.shape[1] > self.k:
            low[open_] = np.partition(near[open_], -self.k, axis=1)[:, -self.k]
        at, col = np.nonzero(near >= (low - self.slack)[:, None].astype(np.float32))
        score = np.empty(len(at))
        for i in range(0, len(at), EXACT_ROWS):
            a, c = at[i : i + EXACT_ROWS], col[i : i + EXACT_ROWS]
            score[i : i + EXACT_ROWS] = np.round(np.einsum("ij,ij->i", self.x[a], y[c]) / (self.n[a] * m[c]), 6)
        some = score >= self.floor[at]
        at, col, score = at[some], col[some], score[some]
        if not len(at):
            return
        ids = vectors.field("ids").take(pa.array(col))
        each = ids.value_lengths().to_numpy(zero_copy_only=False)
        met = pa.table({"q": np.repeat(at, each), "score": np.repeat(score, each), "id": ids.flatten()})
        both = met if self.rows is None else pa.concat_tables([self.rows, met])
        both = both.sort_by([("q", "ascending"), ("score", "descending"), ("id", "ascending")]).combine_chunks()
        q = both.column("q").to_numpy()
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        last = np.flatnonzero(rank == self.k - 1)
        self.floor[q[last]] = np.maximum(self.floor[q[last]], both.column("score").to_numpy()[last])
        self.rows = both.filter(pa.array(rank < self.k))


def best_in_packs(pairs: DataFrame, k: int, query: DataType, id_: DataType) -> DataFrame:
    """pairs: pack (of the queries), q (array of name, embedding, floor: the least score of use, or null) and v (array of ids, in
    order, and embedding); vectors of one length, with a direction. query_id, id and score of the k best of each query in each task."""
    schema = StructType([StructField("query_id", query), StructField("id", id_), StructField("score", DoubleType())])

    def out(held: dict) -> Iterator[pa.RecordBatch]:
        for s in held.values():
            if s.rows is not None:
                t = pa.table({"query_id": s.names.take(s.rows.column("q").combine_chunks()), "id": s.rows.column("id"), "score": s.rows.column("score")})
                yield from t.combine_chunks().to_batches(max_chunksize=100_000)
        held.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            for i in range(b.num_rows):
                pack = b.column("pack")[i].as_py()
                if pack not in held:
                    held[pack] = _Best(b.column("q")[i].values, k)
                held[pack].meet(b.column("v")[i].values)
            if sum(s.x.size // 2 + (0 if s.rows is None else len(s.rows)) for s in held.values()) > HELD_ROWS:
                yield from out(held)
        yield from out(held)

    return pairs.select("pack", "q", "v").mapInArrow(run, schema)


def query_packs(queries: DataFrame, parts: int, *by: str) -> DataFrame:
    """queries (query_id, query_vec, floor) of equal `by` in packs: by, _pack and q."""
    part = F.pmod(F.xxhash64("query_id"), F.lit(parts)).alias("_pack")
    row = F.struct(F.col("query_id").alias("name"), F.col("query_vec").alias("embedding"), "floor")
    return queries.select(*by, part, row.alias("row")).groupBy(*by, "_pack").agg(F.collect_list("row").alias("q"))


def regular(vector: str, length: int):
    """Whether a vector has this length and a direction."""
    n = norm(F.col(vector))
    return F.coalesce((F.size(vector) == length) & (n > 0) & ~F.isnan(n) & (n < float("inf")), F.lit(False))


def classes(vectors: DataFrame, k: int, *by: str) -> DataFrame:
    """embedding and ids: the k smallest ids of each vector's copies (of equal `by`), which all have one score."""
    w = Window.partitionBy(*by, "embedding").orderBy("id")
    first = vectors.select(*by, "id", "embedding").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k)
    return first.groupBy(*by, "embedding").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def nearest_rows(vectors: DataFrame, queries: DataFrame, k: int, length: int) -> list[DataFrame]:
    """query_id, id, score: a superset of the k rows nearest to each query, of regular vectors (id, embedding) and queries (query_id,
    query_vec) of one length; one frame for each QUERY_BYTES of queries, which are broadcast to the packs of vectors."""
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    kinds = queries.schema["query_id"].dataType, vectors.schema["id"].dataType
    own = keep(classes(vectors, k), "vector-classes")
    n, m = own.count(), queries.count()
    parts = -(-n // max(32, min(PACK_BYTES // (4 * length), -(-n // (2 * cores))))) or 1
    row = F.struct("ids", "embedding").alias("row")
    packs = own.select(F.pmod(F.xxhash64("embedding"), F.lit(parts)).alias("_v"), row).repartition(min(parts, 16 * cores), "_v")
    packs = packs.groupBy("_v").agg(F.collect_list("row").alias("v"))
    blocks = -(-m * length * 4 // QUERY_BYTES) or 1
    q = query_packs(queries.select("query_id", "query_vec", F.lit(None).cast("double").alias("floor")), -(-m // QUERY_ROWS) or 1)
    q = q.withColumnRenamed("_pack", "pack")
    return [
        best_in_packs(packs.crossJoin(F.broadcast(q.where(F.col("pack") % blocks == i) if blocks > 1 else q)), k, *kinds) for i in range(blocks)
    ]
