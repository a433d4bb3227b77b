"""Sequence packing by non-negative least squares (operator 3).

Documents are tokenized once and written with their ids. A document of n ids gives floor(n / size) full sequences and a
tail of n mod size ids. The tails' histogram (size - 1 counts, whatever the input) goes to the driver. There, all shallow
combinations (two or three lengths) that exactly fill a sequence are enumerated and their repeat counts are solved against
the histogram by non-negative least squares (cyclic coordinate descent until the optimality conditions hold to TOLERANCE).
Of each length the EACH most repeated combinations are kept, solved again without the others, and rounded. The residual is
packed greedily: the longest tail, then whatever fits best, up to GREEDY_TAILS tails. Lengths that fill no sequence so go
to a stream of tails, which is cut at every sequence's end: a tail's place in it is a formula of its rank, so the plan has
O(lengths) records whatever the counts. Only the last sequence can have padding.

The plan assigns ranges of ranks among the tails of one length. Ranks are counted within each written part and offset
by prefix sums over the parts' counts, so that no length, however frequent, meets in one task.

Defined cases: null or empty text has just the end id; repeated rows and null doc_id are packed as rows of their own;
extra columns are ignored; an empty table gives an empty result.

Ids are those of the tokenizer file's byte-level BPE (see tokens).
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize, slices, table, tune
from .tokens import encoder

SIZE = 1024
END_ID = 0
#: How far, as a share of the largest count, the gradient of the squares may miss its optimality conditions.
TOLERANCE = 1e-3
#: Steps of the descent, at most; what is then uncovered is left to the residual.
UPDATES = 2_000_000
#: Combinations kept of each length, and tails of a greedy fill.
EACH, GREEDY_TAILS = 2, 6
#: Rows of part offsets (24 bytes each) up to which they are broadcast.
BROADCAST_ROWS = 1_000_000


def tokenize(docs: DataFrame, path: str, end_id: int | None = END_ID, size: int = SIZE) -> DataFrame:
    """doc_id, n, ids (little-endian unsigned 32-bit), part (this task), and counts of full sequences and equal tails before it in the part."""
    tune(docs.sparkSession)
    end = np.array([] if end_id is None else [end_id], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, full, tails, encode = TaskContext.get().partitionId(), 0, defaultdict(int), encoder(path)
        for batch in batches:
            for b in slices(batch, "text"):
                ids = [np.concatenate([x, end]) for x in encode([t or "" for t in b.column(1).to_pylist()])]
                fulls, ranks = [], []
                for x in ids:
                    fulls.append(full)
                    full += len(x) // size
                    ranks.append(tails[len(x) % size])
                    tails[len(x) % size] += 1
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).cast(pa.int64()), pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
                        pa.array([part] * len(ids), pa.int64()), pa.array(fulls, pa.int64()),
                        pa.array(ranks, pa.int64()),
                    ],
                    names=["doc_id", "n", "ids", "part", "full_rank", "tail_rank"],
                )

    return documents(docs).mapInArrow(run, "doc_id long, n long, ids binary, part long, full_rank long, tail_rank long")


def combinations(lengths: list[int], size: int) -> np.ndarray:
    """Rows (a, b, c) of lengths that fill a sequence, ascending: pairs first (a is 0), then triples."""
    have = np.zeros(size + 1, bool)
    have[lengths] = True
    a, b = np.meshgrid(np.arange(size + 1), np.arange(size + 1), indexing="ij")
    c = size - a - b
    ok = (a <= b) & (b <= c) & have[b] & have[np.maximum(c, 0)] & ((a == 0) | have[a]) & (b > 0)
    return np.stack([a[ok], b[ok], c[ok]], 1)


def nnls(combos: np.ndarray, hist: np.ndarray, tolerance: float = TOLERANCE, updates: int = UPDATES) -> np.ndarray:
    """x >= 0 that minimizes |A x - hist|^2, column j of A counting combos[j]'s lengths; cyclic coordinate descent over
    the columns that miss the optimality conditions, until none does by more than `tolerance` of the largest count, or
    after so many updates (what x then leaves uncovered is the residual's)."""
    x, left = np.zeros(len(combos)), hist.astype(float)
    left[0] = 0
    rows = combos.tolist()
    norm = np.array([sum((c == r).sum() for r in c if r) for c in combos], float)
    bound = tolerance * max(1.0, hist.max(initial=0))
    while updates > 0:
        gradient = left[combos].sum(1)
        miss = np.where(x > 0, np.abs(gradient), gradient)
        todo = np.flatnonzero(miss > bound)
        if not len(todo):
            break
        updates -= len(todo)
        work = left.tolist()
        for j in todo.tolist():
            a, b, c = rows[j]
            step = (work[a] + work[b] + work[c]) / norm[j]
            step = max(-x[j], step)
            x[j] += step
            work[b] -= step
            work[c] -= step
            if a:
                work[a] -= step
        left = np.array(work)
    return x


def support(combos: np.ndarray, x: np.ndarray, each: int = EACH) -> np.ndarray:
    """Of each length the `each` combinations that x repeats most: O(lengths) rows of combos, ascending."""
    order = np.argsort(-x, kind="stable")
    order = order[x[order] > 0]
    uses = np.concatenate([np.stack([combos[order, i], np.arange(len(order)), order], 1) for i in range(3)])
    uses = uses[uses[:, 0] > 0]
    uses = uses[np.lexsort((uses[:, 1], uses[:, 0]))]
    first = np.searchsorted(uses[:, 0], uses[:, 0])
    return np.unique(uses[np.arange(len(uses)) - first < each, 2])


def plan(hist: np.ndarray, size: int = SIZE) -> tuple[dict[int, list[tuple]], dict[int, tuple[int, int]], int]:
    """Where tails go, in O(lengths) records whatever the counts:

    - by tail length, (lo, hi, sequence, offset): tails of ranks lo..hi-1 go whole to sequences sequence, sequence + 1, ...
    - by tail length, (rank, position): tails from this rank on follow each other in a stream, the first one at position;
    - the number of sequences before the stream."""
    count = {r: int(c) for r, c in enumerate(hist) if r and c}
    used = dict.fromkeys(count, 0)
    out: dict[int, list[tuple]] = defaultdict(list)
    sequences = 0

    def fill(combo: list[int], most: int) -> bool:
        """Up to `most` sequences of these lengths."""
        nonlocal sequences
        uses = Counter(combo)
        m = min([most, *((count[r] - used[r]) // u for r, u in uses.items())])
        if m > 0:
            offset = 0
            for r in combo:
                out[r].append((used[r], used[r] + m, sequences, offset))
                used[r] += m
                offset += r
            sequences += m
        return m > 0

    combos = combinations(sorted(count), size)
    combos = combos[support(combos, nnls(combos, hist))]
    solved = nnls(combos, hist)
    # Fractions are carried on to the next combination, which mostly shares a length: the rounded counts keep the total.
    repeats = np.diff(np.floor(np.cumsum(solved) + 1e-6), prepend=0).astype(np.int64)
    for j in np.flatnonzero(repeats):
        fill([r for r in combos[j].tolist() if r], int(repeats[j]))
    left = sorted(r for r in count if count[r] > used[r])
    while left:  # the longest tail, then whatever fits best; each round uses a length up, or nearly
        chosen, uses, free = [], defaultdict(int), size
        while free and len(chosen) < GREEDY_TAILS:
            i = bisect_right(left, free)
            r = next((left[k] for k in range(i - 1, -1, -1) if count[left[k]] - used[left[k]] > uses[left[k]]), None)
            if r is None:
                break
            chosen.append(r)
            uses[r] += 1
            free -= r
        if free:
            left.pop()  # no exact fill: this length's rest is for the stream
        else:
            fill(chosen, size * max(count.values()))
            left = [r for r in left if count[r] > used[r]]
    stream, position = {}, 0
    for r in sorted(count, reverse=True):
        stream[r] = (used[r], position)
        position += (count[r] - used[r]) * r
    return dict(out), stream, sequences


def pieces(rank: int, length: int, ranges: np.ndarray, stream: tuple[int, int], after: int, size: int) -> list[tuple[int, int, int, int]]:
    """(start, length, sequence, offset) of the pieces of the tail of this rank; the stream's first sequence is `after`."""
    first, position = stream
    if rank < first:
        lo, _, sequence, offset = ranges[np.searchsorted(ranges[:, 0], rank, "right") - 1].tolist()
        return [(0, length, sequence + rank - lo, offset)]
    at = position + (rank - first) * length
    here = min(length, size - at % size)
    out = [(0, here, after + at // size, at % size)]
    return out if here == length else [*out, (here, length - here, after + at // size + 1, 0)]


def pack(docs: DataFrame, path: str, size: int = SIZE, end_id: int | None = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset."""
    tokens = materialize(tokenize(docs, path, end_id, size), "packing-tokens")
    counts = materialize(
        tokens.groupBy("part", (F.col("n") % size).cast("int").alias("tail")).agg(
            F.count("*").alias("c"), F.sum(F.expr(f"n div {size}")).alias("f"),
        ),
        "packing-counts",
    )
    by = counts.where("tail > 0").select("part", "tail", "c").union(
        counts.groupBy("part").agg(F.lit(0).alias("tail"), F.sum("f").alias("c")).select("part", "tail", "c")
    )
    base = materialize(
        by.withColumn(
            "base",
            F.coalesce(
                F.sum("c").over(Window.partitionBy("tail").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ),
        ).select("part", "tail", "base", "c"),
        "packing-offsets",
    )
    hist, full = np.zeros(size, np.int64), 0
    for r in base.groupBy("tail").agg(F.sum("c").alias("c")).collect():
        if r.tail:
            hist[r.tail] = r.c
        else:
            full = int(r.c)
    records, stream, planned = plan(hist, size)
    side = F.broadcast if base.count() <= BROADCAST_ROWS else (lambda x: x)
    rows = tokens.withColumn("tail", (F.col("n") % size).cast("int")).join(
        side(base.where("tail > 0").select("part", "tail", "base")), ["part", "tail"], "left",
    ).join(side(base.where("tail = 0").select("part", F.col("base").alias("full_base"))), "part")
    rows = rows.select("doc_id", "n", "ids", F.col("full_base") + F.col("full_rank"), F.coalesce("base", F.lit(0)) + F.col("tail_rank"))

    ranges = {r: np.array(x, np.int64) for r, x in records.items()}  # of each length, ascending without gaps
    none = np.zeros((0, 4), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "ids"):
                out: list[tuple] = []
                for doc, n, ids, seq, rank in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    whole = n // size * size
                    out += [(doc, i, size, ids[4 * i : 4 * (i + size)], n, seq + i // size, 0) for i in range(0, whole, size)]
                    tail = n - whole
                    if tail:
                        for start, length, to, offset in pieces(rank, tail, ranges.get(tail, none), stream[tail], planned, size):
                            at = whole + start
                            out.append((doc, at, length, ids[4 * at : 4 * (at + length)], n, full + to, offset))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[i] for x in out], pa.binary() if i == 3 else pa.int64()) for i in range(7)],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

    return rows.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def op3_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    r = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return r.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
