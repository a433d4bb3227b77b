"""Quality of rankings and of evaluation runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ranking_quality(ranked: DataFrame, gold: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """ranked: query_id, id, rank; gold: query_id, id. Averages over the queries with gold: whether the first row is gold, the share
    of gold rows among the first 5 and 10, MRR, and NDCG at 10. With sizes (query_id, gold: how many rows are gold), for large
    gold sets, gold need only hold those rows that are ranked."""
    hits = gold.select("query_id", "id").distinct().join(ranked.select("query_id", "id", "rank"), ["query_id", "id"], "left")
    gain = lambda r: 1 / F.log2(r + 1)
    per = hits.groupBy("query_id").agg(
        F.min("rank").alias("first"), F.count("*").alias("gold"),
        F.count_if(F.col("rank") <= 5).alias("in_5"), F.count_if(F.col("rank") <= 10).alias("in_10"),
        F.coalesce(F.sum(F.when(F.col("rank") <= 10, gain(F.col("rank")))), F.lit(0.0)).alias("dcg"),
    )
    if sizes is not None:
        per = sizes.join(per.drop("gold"), "query_id", "left").na.fill(0, ["in_5", "in_10", "dcg"])
    per = per.withColumn("n", F.least("gold", F.lit(10)).cast("int"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("n")), F.lit(0.0), lambda a, r: a + gain(r))
    first = F.avg(F.coalesce((F.col("first") <= 1).cast("int"), F.lit(0)))
    return per.agg(
        F.count("*").alias("queries"), F.round(first, 6).alias("recall_1"),
        F.round(F.avg(F.col("in_5") / F.col("gold")), 6).alias("recall_5"),
        F.round(F.avg(F.col("in_10") / F.col("gold")), 6).alias("recall_10"),
        F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"),
        F.round(F.avg(F.col("dcg") / ideal), 6).alias("ndcg_10"),
    )


#: The ratio of held-out cases, and how far it may lie below that of known ones.
HELD_OUT, GAP = 0.6, 0.3


def run(cases: DataFrame) -> DataFrame:
    """cases: bucket, violations (rule ids; null: skipped). Totals and ratio of each bucket."""
    cases = cases.where("violations is not null")
    return cases.groupBy("bucket").agg(
        F.count("*").alias("total"), F.count_if(F.size("violations") == 0).alias("passed"),
        F.round(F.avg((F.size("violations") == 0).cast("int")), 9).alias("ratio"),
    )


def notes(buckets: DataFrame) -> DataFrame:
    """One row: low, whether held-out cases pass too rarely; overfit, whether known ones pass far more often; sound, neither."""
    ratio = lambda b: F.max(F.when(F.col("bucket") == b, F.col("ratio")))
    both = buckets.agg(ratio("from-corrections").alias("fc"), ratio("held-out").alias("ho"))
    low, overfit = F.col("ho") < HELD_OUT, F.col("fc") - F.col("ho") > GAP
    known = F.col("fc").isNotNull() & F.col("ho").isNotNull()
    return both.select((known & low).alias("low"), (known & overfit).alias("overfit"), (known & ~low & ~overfit).alias("sound"))


REPORT = "buckets array<struct<bucket:string,total:bigint,passed:bigint,ratio:double>>, per_rule array<struct<rule_id:string,violations:bigint>>, skipped bigint"


def report(cases: DataFrame) -> DataFrame:
    """One row: the buckets, how often each rule was broken, and how many cases were skipped. As many entries as buckets and rules."""
    buckets, rules = run(cases), violations_by_rule(cases)
    left = buckets.agg(F.array_sort(F.collect_list(F.struct("bucket", "total", "passed", "ratio"))).alias("buckets"))
    right = rules.agg(F.array_sort(F.collect_list(F.struct("rule_id", "violations"))).alias("per_rule"))
    return left.crossJoin(right).crossJoin(cases.agg(F.count_if(F.col("violations").isNull()).alias("skipped")))


def save_report(found: DataFrame, path: str) -> None:
    found.write.mode("overwrite").json(path)


def load_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPORT).json(path)


def extraction_quality(rows: DataFrame) -> DataFrame:
    """rows as anchor_coverage() takes them: recall over all gold entries, noise that leaked, and what was found where nothing is."""
    c = anchor_coverage(rows)
    out = c.agg(
        F.sum("covered").alias("covered"), F.sum(F.size("gold")).alias("gold"), F.sum("leaked").alias("leaked"),
        F.sum(F.when(F.size("gold") == 0, F.size("found")).otherwise(0)).alias("extra"),
        F.sum(F.size("found")).alias("found"),
    )
    return out.withColumn("recall", F.round(F.when(F.col("gold") > 0, F.col("covered") / F.col("gold")).otherwise(F.lit(0.0)), 9))


def violations_by_rule(cases: DataFrame) -> DataFrame:
    return cases.select(F.explode("violations").alias("rule_id")).groupBy("rule_id").agg(F.count("*").alias("violations"))


def gate(buckets: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """One row, ok: no bucket dropped and no rule is broken more often. Rules absent before count 0."""
    worse = after.withColumnRenamed("violations", "now").join(
        before.withColumnRenamed("violations", "then"), "rule_id", "left",
    ).where("now > coalesce(then, 0)")
    bad = buckets.where("dropped").select("bucket").union(worse.select("rule_id"))
    return bad.agg((F.count("*") == 0).alias("ok"))


def anchor_coverage(rows: DataFrame) -> DataFrame:
    """rows: found (texts), gold (array of anchor lists), noise (texts). How many gold entries have an anchor in a found text, and noise that leaked."""
    from ..functions.text import fold

    blob = fold(F.array_join("found", " "))
    has = lambda a: F.contains(F.col("_blob"), fold(a))
    return rows.withColumn("_blob", blob).select(
        "*", F.size(F.filter("gold", lambda g: F.exists(g, has))).alias("covered"),
        F.size(F.filter("noise", has)).alias("leaked"),
    ).drop("_blob")
