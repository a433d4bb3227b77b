"""Streams: duplicate events, running usage, quotas, rate limits and job workers. A micro-batch is bounded by its source (files
or offsets a trigger); of it, one key's rows are held at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import usage


def first_events(events: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """Each event id once, within the watermark; empty ids are never duplicates of one another and are left out."""
    return events.where(F.col(key).isNotNull()).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def usage_by_period(events: DataFrame, tenant: str, time: str, period: str = "1 day", delay: str = "1 hour") -> DataFrame:
    return events.withWatermark(time, delay).groupBy(F.window(time, period), tenant).agg(F.count("*").alias("ops"))


def consume_stream(requests: DataFrame, limit: float | None) -> DataFrame:
    """requests: tenant_id, period, seq, cost (a stream). Adds accepted: within the limit with what was accepted before; others don't
    count. The state of a tenant and period is one number; rows of one micro-batch are taken in order of seq."""
    import pandas as pd

    def step(key, batches, state):
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        used, said = (state.get[0] if state.exists else 0.0), []
        for cost in rows["cost"]:
            said.append(limit is None or used + cost <= limit)
            used += cost if said[-1] else 0.0
        state.update((used,))
        yield rows.assign(accepted=said)

    r = requests.select("tenant_id", "period", "seq", F.col("cost").cast("double").alias("cost"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in r.schema) + ", accepted boolean"
    return r.groupBy("tenant_id", "period").applyInPandasWithState(step, schema, "used double", "append", "NoTimeout")


def rate_limit_stream(requests: DataFrame, most: int = 120, seconds: float = 60.0) -> DataFrame:
    """requests: tenant_id, at (seconds), seq (a stream). Adds accepted: fewer than `most` accepted in the last `seconds`. The state
    holds at most `most` times of a tenant."""
    import pandas as pd

    def step(key, batches, state):
        rows = pd.concat(list(batches)).sort_values(["at", "seq"], kind="stable")
        recent, said = list(state.get[0]) if state.exists else [], []
        for at in rows["at"]:
            recent = [t for t in recent if at - t < seconds]
            said.append(len(recent) < most)
            if said[-1]:
                recent.append(float(at))
        state.update((recent,))
        yield rows.assign(accepted=said)

    r = requests.select("tenant_id", F.col("at").cast("double").alias("at"), "seq")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in r.schema) + ", accepted boolean"
    return r.groupBy("tenant_id").applyInPandasWithState(step, schema, "recent array<double>", "append", "NoTimeout")


def work(jobs: DataFrame, handlers: dict[str, Callable[[DataFrame], DataFrame]], store: Callable[[DataFrame, DataFrame], None], checkpoint: str):
    """A streaming query that takes each micro-batch of queued jobs (as process() takes them) to their handlers and gives finished
    job rows and operations to meter to store(). The stream's offsets are the claims: a batch that failed is taken again."""

    def step(batch: DataFrame, _: int) -> None:
        claimed = batch.where("status = 'queued'").withColumns({"status": F.lit("running"), "attempts": F.col("attempts") + 1})
        results, metered = usage.process(claimed, handlers)
        store(usage.complete(claimed, results.drop("added")), metered)

    return jobs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(stream: DataFrame, path: str) -> None:
    """Run a stream over all that its source holds now, appended to Parquet files below `path`."""
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option(
        "checkpointLocation", f"{path}/checkpoint",
    ).trigger(availableNow=True).start()
    query.awaitTermination()
