"""Texts against many queries by the terms that they share, one text at a time: no row for each text and query is made or grouped.

A task adds up the scores of a chunk of texts for all queries, and keeps the k best texts of each query that it has met; only those
are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, IntegerType, StringType, StructField, StructType

from ..sources.tables import keep, small

#: Sums (of a text and a query, or of a shared term) that are held at once; rows (query, term) that are broadcast at once.
CELLS, ASKED_ROWS = 2_000_000, 1_000_000

Weight = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _each(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def term_counts(tokens: pa.Array, wanted: pa.Array | None) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Of lists of tokens: the distinct (wanted) ones of each list in a row, how often each is there, and how many each list has."""
    flat = tokens.flatten()
    if wanted is None:
        coded = flat.dictionary_encode()
        wanted, code = coded.dictionary, coded.indices
    else:
        code = pc.index_in(flat, value_set=wanted)
    code = pc.fill_null(code, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(tokens)), _each(tokens))
    held = code >= 0
    n = max(1, len(wanted))
    key, count = np.unique(row[held] * n + code[held], return_counts=True)
    return wanted.take(pa.array(key % n)), count, np.bincount(key // n, minlength=len(tokens))


def lists_of(values: pa.Array, each: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(each)], pa.int32()), values)


def counted(docs: DataFrame, wanted: list[str] | None) -> DataFrame:
    """docs: id, tokens (array). id, size (all its tokens), and terms and tfs, the distinct (wanted) tokens and their numbers."""
    kind = docs.schema["id"]
    schema = StructType([kind, StructField("size", IntegerType()), StructField("terms", ArrayType(StringType())), StructField("tfs", ArrayType(IntegerType()))])
    sent = None if wanted is None else docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = None if sent is None else pa.array(sent.value, pa.string())
        for b in batches:
            tokens = b.column("tokens")
            found, count, each = term_counts(tokens, some)
            columns = [b.column("id"), pa.array(_each(tokens), pa.int32()), lists_of(found, each), lists_of(pa.array(count, pa.int32()), each)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return docs.select("id", "tokens").mapInArrow(run, schema)


class _Best:
    """The k best texts of each query among those met so far."""

    def __init__(self, asked: pa.Table, k: int):
        self.k = k
        self.names = asked.column("query_id").combine_chunks().unique()
        self.terms = asked.column("term").combine_chunks().unique()
        number = lambda name, of: pc.index_in(asked.column(name).combine_chunks(), value_set=of).to_numpy(zero_copy_only=False)
        term = number("term", self.terms)
        order = np.argsort(term, kind="stable")
        self.queries = number("query_id", self.names)[order].astype(np.int64)
        self.factor = asked.column("factor").to_numpy()[order]
        self.count = np.bincount(term, minlength=len(self.terms)).astype(np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.floor = np.full(len(self.names), -np.inf)
        self.rows: pa.Table | None = None

    def meet(self, ids: pa.Array, terms: pa.Array, weights: np.ndarray | None) -> None:
        n, m = len(ids), len(self.names)
        code = pc.fill_null(pc.index_in(terms.flatten(), value_set=self.terms), -1).to_numpy(zero_copy_only=False)
        hit = np.flatnonzero(code >= 0)
        row, code = np.repeat(np.arange(n), _each(terms))[hit], code[hit]
        weights = np.ones(len(hit)) if weights is None else weights[hit]
        chunk = (np.cumsum(np.bincount(row, self.count[code], n) + m) // CELLS).astype(np.int64)
        ends = np.r_[np.flatnonzero(np.diff(chunk)) + 1, n]
        for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
            lo, hi = np.searchsorted(row, [a, b])
            if lo < hi:
                self._chunk(ids.slice(a, b - a), row[lo:hi] - a, code[lo:hi], weights[lo:hi])

    def _chunk(self, ids: pa.Array, row: np.ndarray, code: np.ndarray, weights: np.ndarray) -> None:
        n, m, k = len(ids), len(self.names), self.k
        each = self.count[code]
        at = np.arange(int(each.sum())) + np.repeat(self.first[code] - (np.cumsum(each) - each), each)
        total = np.bincount(np.repeat(row * m, each) + self.queries[at], np.repeat(weights, each) * self.factor[at], n * m).reshape(n, m)
        score = np.round(total, 6)
        low, open_ = self.floor.copy(), np.isinf(self.floor)
        if open_.any() and n > k:
            low[open_] = np.partition(score[:, open_], n - k, axis=0)[n - k]
        doc, query = np.nonzero((score >= low) & (total > 0))
        met = pa.table({"q": query, "score": score[doc, query], "id": ids.take(pa.array(doc))})
        both = met if self.rows is None else pa.concat_tables([self.rows, met])
        both = both.sort_by([("q", "ascending"), ("score", "descending"), ("id", "ascending")]).combine_chunks()
        q = both.column("q").to_numpy()
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        last = np.flatnonzero(rank == k - 1)
        self.floor[q[last]] = both.column("score").to_numpy()[last]
        self.rows = both.filter(pa.array(rank < k))


def repeated(rows: DataFrame) -> DataFrame | None:
    """The ids of rows that are null or there more than once; None if there are none."""
    again = keep(rows.groupBy("id").count().where("count > 1 or id is null").select("id"), "repeated-ids")
    return small(again) if again.limit(1).count() else None


def best_by_terms(rows: DataFrame, asked: DataFrame, k: int, query: DataType, weight: Weight | None = None) -> list[DataFrame]:
    """rows: id (each once, not null), terms (array), and with `weight` tfs (array) and size; asked (kept): query_id, term, factor.
    query_id, id and score of the k best texts of each query in each task: the sum of weight(tf, size) (else 1) times factor over
    the shared terms, rounded. One frame for each ASKED_ROWS of asked, which are broadcast."""
    context = rows.sparkSession.sparkContext
    schema = StructType([StructField("query_id", query), rows.schema["id"], StructField("score", DoubleType())])
    parts = -(-asked.count() // ASKED_ROWS) or 1
    columns = ["id", "terms", *(["tfs", "size"] if weight else [])]

    def block(i: int) -> DataFrame:
        some = asked if parts == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i)
        sent = context.broadcast(some.select("query_id", "term", F.col("factor").cast("double").alias("factor")).toArrow())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = _Best(sent.value, k)
            for b in batches:
                w = None
                if weight:
                    each = _each(b.column("terms"))
                    w = weight(b.column("tfs").flatten().to_numpy().astype(np.float64), np.repeat(b.column("size").to_numpy(), each))
                best.meet(b.column("id"), b.column("terms"), w)
            if best.rows is not None:
                t = best.rows
                t = pa.table({"query_id": best.names.take(t.column("q").combine_chunks()), "id": t.column("id"), "score": t.column("score")})
                yield from t.combine_chunks().to_batches(max_chunksize=100_000)

        return rows.select(*columns).mapInArrow(run, schema)

    return [block(i) for i in range(parts)]
