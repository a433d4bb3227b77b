"""Categories of a tenant's memories: proposed from a sample, assigned, tightened."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import keep, small

#: Least memories, sampled texts, rows without a label that call for more labels, least members of a label.
LEAST_ROWS, SAMPLE, SECOND_PASS, LEAST_MEMBERS = 8, 40, 5, 3
UNSORTED = "Sınıflandırılmamış"


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """rows with their position (0 on) by `order`: counted within sorted ranges, and offset by the ranges' sizes."""
    r = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()).withColumn(
        "_at", F.monotonically_increasing_id(),
    )
    r = keep(r, "numbered")
    within = Window.partitionBy("_part").orderBy("_at")
    sizes = r.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    placed = r.withColumn("_row", F.row_number().over(within) - 1).join(F.broadcast(base), "_part")
    return placed.withColumn("position", F.col("_base") + F.col("_row")).drop("_part", "_at", "_row", "_base")


def systematic(rows: DataFrame, order: str, most: int = SAMPLE) -> DataFrame:
    """Every (n div most)-th row by `order`, at most `most`: a sampling operator."""
    n = rows.count()
    step = max(1, n // most)
    return numbered(rows, order).where((F.col("position") % step == 0) & (F.col("position") < step * most))


def induce(
    memories: DataFrame, propose: Callable[[list[str]], Sequence[str]],
    assign: Callable[[DataFrame, Sequence[str]], DataFrame], tenant: str,
) -> tuple[DataFrame, DataFrame] | None:
    """memories: id, content (active). propose(texts) names labels; assign(rows, labels) gives rows a column label (null or
    another word: none). (nodes: id, label, path, member_count; routing: id, node_id, path, confidence), or None with fewer
    than LEAST_ROWS memories or no label.

    Rows without a label that are SECOND_PASS or more get labels proposed of their own; labels of fewer than LEAST_MEMBERS
    rows are dealt out to the larger ones, and empty ones go. Labels are few, so they live on the driver; rows don't.
    """
    m = keep(memories.where(r"content rlike '\\S'"), "memories")
    if m.count() < LEAST_ROWS:
        return None
    texts = lambda rows: [r.content for r in systematic(rows, "id").orderBy("position").select("content").collect()]
    labels = _once(propose(texts(m)))
    if not labels:
        return None

    def labelled(rows: DataFrame, names: Sequence[str]) -> DataFrame:
        got = assign(rows.select(*m.columns), names)
        return keep(
            got.select(
                "id", "content", *[c for c in m.columns if c not in ("id", "content")],
                F.when(F.col("label").isin(*names), F.col("label")).alias("label"),
            ),
            "labelled",
        )

    rows = labelled(m, labels)
    left = rows.where("label is null")
    if left.limit(SECOND_PASS).count() >= SECOND_PASS:
        labels = _once([*labels, *propose(texts(left.drop("label")))])
        rows = keep(rows.where("label is not null").unionByName(labelled(left, labels)), "labelled")
    counts = {r.label: r.n for r in rows.where("label is not null").groupBy("label").agg(F.count("*").alias("n")).collect()}
    large = [x for x in labels if counts.get(x, 0) >= LEAST_MEMBERS]
    tiny = [x for x in labels if 0 < counts.get(x, 0) < LEAST_MEMBERS]
    if large and tiny:
        moved = F.coalesce(F.col("label").isin(*tiny), F.lit(False))
        rows = keep(rows.where(~moved).unionByName(labelled(rows.where(moved), large)), "labelled")
    named = rows.where("label is not null").groupBy("label").agg(F.count("*").alias("member_count"))
    nodes = named.select(node_id(tenant, F.col("label")).alias("id"), "label", F.col("label").alias("path"), "member_count")
    routed = rows.join(small(nodes.select("label", F.col("id").alias("node_id"))), "label", "left")
    return nodes, routed.select(
        "id", "node_id", F.coalesce("label", F.lit(UNSORTED)).alias("path"),
        F.col("node_id").isNotNull().cast("double").alias("confidence"),
    )


def _once(labels: Sequence[str]) -> list[str]:
    """Each label once, in any case."""
    return list({x.strip().lower(): x.strip() for x in reversed([x for x in labels if x.strip()])}.values())[::-1]


def replace_nodes(taxonomy: DataFrame, nodes: DataFrame, tenant: str) -> DataFrame:
    """The table with the tenant's nodes replaced."""
    own = nodes.withColumn("tenant_id", F.lit(tenant))
    return taxonomy.where(F.col("tenant_id") != tenant).unionByName(own, allowMissingColumns=True)


def route(memories: DataFrame, routing: DataFrame) -> DataFrame:
    """memories with node_id of those rows that routing (id, node_id) names."""
    r = routing.select("id", F.col("node_id").alias("_node"), F.lit(True).alias("_hit"))
    return memories.join(r, "id", "left").withColumn(
        "node_id", F.when(F.col("_hit"), F.col("_node")).otherwise(F.col("node_id")),
    ).drop("_node", "_hit")


def node_id(tenant: str, label: Column) -> Column:
    return F.concat(F.lit("tax-"), F.substring(F.sha1(F.concat_ws("|", F.lit(tenant), F.lower(F.trim(label)))), 1, 12))
