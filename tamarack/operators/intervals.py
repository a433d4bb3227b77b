"""Points in intervals by an equi-join: intervals cover nodes of a binary tree of bins, and a point lies in one node of each level.

The points' range is cut into 2**DEPTH bins. A half-open run of bins is covered by at most two nodes a level, and these nodes
share no bin, so a point meets an interval in one node at most, whatever the interval's length. Points are repeated only for the
levels that some interval uses. Bins are monotone in time and clipped at both ends, so open and far intervals need no case of
their own; the ends themselves are compared exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import keep, small

DEPTH = 15


def cover(first: Column, after: Column, depth: int = DEPTH) -> Column:
    """The nodes (level, node) that cover the bins first up to, not including, after (both from 0 to 2**depth)."""
    lo, hi = (lambda s: s["lo"]), (lambda s: s["hi"])
    node = lambda level, at: F.struct(level.cast("int").alias("level"), at.alias("node"))
    none = F.array().cast("array<struct<level: int, node: bigint>>")

    def step(s: Column, level: Column) -> Column:
        open_ = lo(s) < hi(s)
        left, right = open_ & (lo(s) % 2 == 1), open_ & (hi(s) % 2 == 1)
        found = F.concat(
            s["nodes"], F.when(left, F.array(node(level, lo(s)))).otherwise(none), F.when(right, F.array(node(level, hi(s) - 1))).otherwise(none),
        )
        half = lambda x: F.floor(x / 2).cast("long")
        return F.struct(half(lo(s) + left.cast("long")).alias("lo"), half(hi(s) - right.cast("long")).alias("hi"), found.alias("nodes"))

    start = F.struct(first.cast("long").alias("lo"), after.cast("long").alias("hi"), none.alias("nodes"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(depth)), start, step, lambda s: s["nodes"])


def points_in_intervals(points: DataFrame, intervals: DataFrame, by: list[str] | None = None, depth: int = DEPTH) -> DataFrame:
    """points: at; intervals: valid_at, invalid_at (null: open), all seconds; the columns of both, but for `by`, have names of their
    own. Every pair of equal `by` with valid_at <= at < invalid_at. Null times and empty intervals meet nothing."""
    by = by or []
    low, high = points.agg(F.min("at"), F.max("at")).first()
    if low is None:
        low = high = 0.0
    width = (float(high) - float(low)) / 2**depth or 1.0
    place = lambda t: F.least(F.greatest(F.floor((t - float(low)) / width), F.lit(0)), F.lit(2**depth - 1)).cast("long")
    some = intervals.where("valid_at is not null and (invalid_at is null or invalid_at > valid_at)").where(
        (F.col("valid_at") <= float(high)) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > float(low))),
    )
    after = F.when(F.col("invalid_at").isNull(), F.lit(2**depth)).otherwise(place(F.col("invalid_at")) + 1)
    held = keep(some.withColumn("_n", F.explode(cover(place(F.col("valid_at")), after, depth))), "interval-nodes")
    used = [r.level for r in held.select("_n.level").distinct().collect()]  # at most depth + 1
    if not used:
        return points.join(some, by).limit(0) if by else points.crossJoin(some.limit(0))
    nodes = F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(place(F.col("at")), k).alias("node")) for k in sorted(used)])
    spread = points.where("at is not null").withColumn("_n", F.explode(nodes))
    met = spread.join(small(held), [*by, "_n"])
    return met.where("valid_at <= at and (invalid_at is null or at < invalid_at)").drop("_n")


def counts_at(points: DataFrame, intervals: DataFrame, by: list[str], name: str = "n") -> DataFrame:
    """points (at and any columns) with the number of intervals (valid_at, invalid_at; null: open) of equal `by` that hold them, as
    points_in_intervals() pairs them: those begun so far less those ended so far, by running sums over sorted ranges. No pair is
    made and no value of `by`, however common, is one task. Null times lie in none."""
    some = intervals.where("valid_at is not null and (invalid_at is null or invalid_at > valid_at)")
    change = lambda at, n: some.select(*by, F.col(at).cast("double").alias("at"), F.lit(n).cast("long").alias("_d")).where("at is not null")
    changes = change("valid_at", 1).unionByName(change("invalid_at", -1)).groupBy(*by, "at").agg(F.sum("_d").alias("_d"))
    known = [F.col(c).isNotNull() for c in by]
    asked = points.where("at is not null").withColumn("at", F.col("at").cast("double"))
    both = asked.withColumn("_d", F.lit(None).cast("long")).unionByName(changes, allowMissingColumns=True)
    order = [*[F.col(c) for c in by], F.col("at"), F.col("_d").isNull()]  # changes come before the points of their time
    rows = both.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = keep(rows.withColumn("_part", F.shiftright("_at", 33)), "interval-order")
    line = Window.partitionBy(*by, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    held = rows.groupBy(*by, "_part").agg(F.sum(F.coalesce("_d", F.lit(0))).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    base = small(keep(held.select(*by, "_part", "_before"), "interval-ranges"))
    own = rows.withColumn("_own", F.sum(F.coalesce("_d", F.lit(0))).over(line)).where("_d is null")
    for c in known:
        own = own.where(c)
    return own.join(base, [*by, "_part"]).select(*points.columns, (F.col("_own") + F.col("_before")).alias(name))
