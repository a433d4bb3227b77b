"""Folds over the rows of a key in order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_order(rows: DataFrame, keys: list[str], order: list[str], step: Callable) -> DataFrame:
    """accepted per row, by a fold over each key's rows in order. Rows stream through sorted partitions: a key's group is
    never held, only its state."""
    columns = [*keys, *order, *[c for c in rows.columns if c not in (*keys, *order)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = state = None
        for b in batches:
            out = []
            for row in b.to_pylist():
                k = tuple(row[c] for c in keys)
                if k != key:
                    key, state = k, None
                ok, state = step(row, state)
                out.append(ok)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.bool_())], names=[*columns, "accepted"])

    schema = rows.select(*columns).withColumn("accepted", F.lit(True)).schema
    return rows.select(*columns).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
