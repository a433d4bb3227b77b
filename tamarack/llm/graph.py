"""Connected components by minimum labels with pointer jumping, all in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, remove


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges: a, b. Returns node and label (the smallest node of its component) for every node of an edge.

    Each round takes the smallest label among a node's neighbours and then its label's label, so the rounds grow with
    the logarithm of a component's diameter. Every round is written out: no lineage to recompute.
    """
    # Written before it is read in both directions: a caller's edges may differ from one evaluation to the next.
    once = materialize(edges.select("a", "b").where("a != b"), "edges")
    both = materialize(once.union(once.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    remove(once)
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        hooked = materialize(hooked, "hooked")
        up = hooked.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = materialize(hooked.join(up, "label", "left").select("node", F.coalesce("up", "label").alias("label"), "old"), "labels")
        changed = new.where("label != old").limit(1).count()
        remove(hooked, labels)
        labels = new.drop("old")
        labels.tamarack_path = new.tamarack_path
        if not changed:
            break
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    return labels
