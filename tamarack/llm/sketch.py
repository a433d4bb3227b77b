"""Count-min sketches that are built per task, merged by blocks and broadcast.

Cells saturate at 255 and only ever overestimate, so `estimate(h) < 2` proves that a value was seen at most once. A task
sends a block sparsely (3 bytes a cell in use) or densely (1 byte a cell), whichever is smaller. A merged sketch has
depth x width bytes; callers build one of at most MAX_WIDTH cells a row, so that the broadcast is bounded whatever the
input, and have another way beyond it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, tune
from .textkit import mix

BLOCK = 1 << 16
MAX_WIDTH = 1 << 25
#: Tasks' blocks are summed in so many lanes first.
LANES = 64
_BLOCK_COLUMNS = ["block", "lane", "sparse", "data"]
_BLOCK_SCHEMA = "block long, lane int, sparse boolean, data binary"
_SALTS = (0, 0x2545F4914F6CDD1D, 0x5851F42D4C957F2D)


def width_for(values: float, most: int | None = MAX_WIDTH) -> int:
    """Cells for about so many values: a power of two from BLOCK to `most`."""
    wanted = max(BLOCK, 1 << int(np.ceil(np.log2(max(2.0, values)))))
    return wanted if most is None else min(most, wanted)


def cells(h: np.ndarray, row: int, width: int) -> np.ndarray:
    x = h if row == 0 else mix(h ^ np.uint64(_SALTS[row]))
    return (x >> np.uint64(8)) & np.uint64(width - 1)


class Sketch:
    def __init__(self, rows: np.ndarray):
        self.rows = rows

    def estimate(self, h: np.ndarray) -> np.ndarray:
        depth, width = self.rows.shape
        out = self.rows[0][cells(h, 0, width)]
        for r in range(1, depth):
            out = np.minimum(out, self.rows[r][cells(h, r, width)])
        return out


def build(df: DataFrame, values: Callable[[pa.RecordBatch], np.ndarray], width: int, depth: int = 1, text: str = "text") -> Sketch:
    """values: gives the 64-bit values of a run of rows, each as often as it counts."""
    tune(df.sparkSession)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense, lane = np.zeros((depth, width), np.uint8), TaskContext.get().partitionId() % LANES
        held, n = [], 0

        def flush() -> None:
            nonlocal held, n
            h = np.concatenate(held) if held else np.zeros(0, np.uint64)
            for r in range(depth):
                u, c = np.unique(cells(h, r, width), return_counts=True)
                dense[r][u] = np.minimum(dense[r][u].astype(np.int64) + c, 255)
            held, n = [], 0

        for batch in batches:
            for part in slices(batch, text):
                h = values(part)
                held.append(h)
                n += len(h)
                if n > 1 << 20:
                    flush()
        flush()
        for r in range(depth):
            for b in range(0, width, BLOCK):
                block = dense[r, b : b + BLOCK]
                used = np.flatnonzero(block)
                if len(used):
                    sparse = 3 * len(used) < BLOCK
                    data = used.astype(np.uint16).tobytes() + block[used].tobytes() if sparse else block.tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([r * (width // BLOCK) + b // BLOCK], pa.int64()), pa.array([lane], pa.int32()),
                            pa.array([sparse]), pa.array([data], pa.binary()),
                        ],
                        names=_BLOCK_COLUMNS,
                    )

    def merged(blocks: DataFrame, *keys: str) -> DataFrame:
        """One dense block for each of the keys, summed as its parts stream by: a task holds one block and one Arrow batch."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, total = None, np.zeros(BLOCK, np.int64)

            def done() -> pa.RecordBatch:
                data = pa.array([np.minimum(total, 255).astype(np.uint8).tobytes()], pa.binary())
                return pa.RecordBatch.from_arrays([pa.array(key[:1], pa.int64()), pa.array(key[1:], pa.int32()), pa.array([False]), data], names=_BLOCK_COLUMNS)

            for batch in batches:
                for block, lane, sparse, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if key != (block, lane):
                        if key:
                            yield done()
                        key, total = (block, lane), np.zeros(BLOCK, np.int64)
                    if sparse:
                        n = len(data) // 3
                        total[np.frombuffer(data, np.uint16, n)] += np.frombuffer(data, np.uint8, n, 2 * n)
                    else:
                        total += np.frombuffer(data, np.uint8)
            if key:
                yield done()

        return blocks.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, _BLOCK_SCHEMA)

    # First the blocks of every LANES-th task, then these sums: no task reads the blocks of all tasks.
    first = merged(df.mapInArrow(one, _BLOCK_SCHEMA), "block", "lane")
    last = merged(first.withColumn("lane", F.lit(0).cast("int")), "block")
    rows = np.zeros(depth * width, np.uint8)
    for r in last.toLocalIterator():
        rows[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.data, np.uint8)
    return Sketch(rows.reshape(depth, width))
