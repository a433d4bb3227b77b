"""Stateful streams whose state ends: rate limits, quotas and transcripts by transformWithState, with event-time timers.

The state lives in RocksDB (use_rocksdb() sets the provider of the session). A key that falls silent has a timer; when the
watermark passes it, the key's state goes. Rows later than the watermark are left out by the operator (also those at or
before 1970, where the watermark begins). Of a micro-batch one
key's rows are held at a time, since they are taken in order; a source's rows or files a trigger bound it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.transcripts import scored

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _Timed(StatefulProcessor):
    """A processor whose state goes when its one timer fires: names of its list states and their schemas."""

    states: dict[str, str] = {}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        for name, schema in self.states.items():
            setattr(self, name, handle.getListState(name, schema))

    def until(self, millis: int) -> None:
        """Keep the state until the watermark passes this time."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(millis)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for name in self.states:
            getattr(self, name).clear()
        return iter(())

    def close(self) -> None:
        pass


class _Limiter(_Timed):
    states = {"recent": "at double"}

    def __init__(self, most: int, seconds: float):
        self.most, self.seconds = most, seconds

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable")
        recent, said = [x[0] for x in self.recent.get()], []
        for at in batch["at"]:
            recent = [t for t in recent if at - t < self.seconds]
            said.append(len(recent) < self.most)
            if said[-1]:
                recent.append(float(at))
        self.recent.put([(t,) for t in recent])
        self.until(int((batch["at"].iloc[-1] + self.seconds) * 1000) + 1)
        yield batch.drop(columns="ts").assign(accepted=said)


class _Quota(_Timed):
    states = {"used": "used double"}

    def __init__(self, limit: float | None):
        self.limit = limit

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        used, said = next((x[0] for x in self.used.get()), 0.0), []
        for cost in batch["cost"]:
            said.append(self.limit is None or used + cost <= self.limit)
            used += cost if said[-1] else 0.0
        self.used.put([(used,)])
        self.until(int(batch["ends"].iloc[0].timestamp() * 1000) + 1)
        yield batch.drop(columns=["ends", "ts"]).assign(accepted=said)


class _Turns(_Timed):
    states = {"waiting": "turn long, role string, text string", "last": "text string"}

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows))
        more = [tuple(x) for x in batch[["turn", "role", "text"]].itertuples(index=False)]
        self.waiting.put([(int(t), r, x) for t, r, x in [*self.waiting.get(), *more]])
        newest = int(batch["ts"].max().timestamp() * 1000) + self.idle_ms
        self.until(max([newest, *self.handle.listTimers()]))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        previous, out = None, []
        for turn, role, text in sorted(self.waiting.get(), key=lambda x: x[0]):
            if role == "user":
                out.append((key[0], turn, text, previous))
            if role == "assistant" and text is not None:
                previous = text
        super().handleExpiredTimer(key, timerValues, expiredTimerInfo)
        if out:
            yield pd.DataFrame(out, columns=["conv_id", "turn", "text", "previous"])


def _fields(df: DataFrame, *leave: str) -> str:
    return ", ".join(f"{n} {kind}" for n, kind in df.dtypes if n not in leave)


def rate_limit_stream(requests: DataFrame, most: int = 120, seconds: float = 60.0, delay: str = "10 minutes") -> DataFrame:
    """requests: tenant_id, at (seconds), seq (a stream). Adds accepted: fewer than `most` accepted in the last `seconds`. A tenant's
    state, at most `most` times, goes when the watermark (`delay` behind the newest request) passes its last request by `seconds`."""
    r = requests.select("tenant_id", F.col("at").cast("double").alias("at"), "seq", F.timestamp_seconds("at").alias("ts")).withWatermark("ts", delay)
    schema = _fields(r, "ts") + ", accepted boolean"
    return r.groupBy("tenant_id").transformWithStateInPandas(_Limiter(most, seconds), schema, "Append", "EventTime")


def consume_stream(requests: DataFrame, limit: float | None, delay: str = "1 hour") -> DataFrame:
    """requests: tenant_id, period, seq, cost, ts and ends (timestamps: of the request, and when its period ends), a stream. Adds
    accepted, as usage.consume() does. A period's state, one number, goes when the watermark passes its end."""
    r = requests.select("tenant_id", "period", "seq", F.col("cost").cast("double").alias("cost"), "ends", "ts").withWatermark("ts", delay)
    schema = _fields(r, "ends", "ts") + ", accepted boolean"
    return r.groupBy("tenant_id", "period").transformWithStateInPandas(_Quota(limit), schema, "Append", "EventTime")


def scan_stream(turns: DataFrame, idle: str = "10 minutes", delay: str = "10 minutes", ascii_only: bool = False) -> DataFrame:
    """turns: conv_id, turn, role, text, ts (a stream, turns in any order). What transcripts.scan() tells of each conversation, once
    the watermark has passed its newest turn by `idle`, over any split of the turns into micro-batches."""
    r = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", "ts").withWatermark("ts", delay)
    millis = int(pd.Timedelta(idle).total_seconds() * 1000)
    schema = f"conv_id {dict(r.dtypes)['conv_id']}, turn long, text string, previous string"
    return scored(r.groupBy("conv_id").transformWithStateInPandas(_Turns(millis), schema, "Append", "EventTime"), ascii_only)
