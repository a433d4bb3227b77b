"""Compliance measurement over checks (rule_id, passed 0/1, day)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_rule(checks: DataFrame) -> DataFrame:
    return checks.groupBy("rule_id").agg(
        F.count("*").alias("checks"), F.sum("passed").alias("passed"), F.sum(1 - F.col("passed")).alias("violations"),
        F.round(F.sum("passed") / F.count("*"), 9).alias("ratio"),
    )


def timeseries(checks: DataFrame, today: str | None = None, days: int = 14, rule_id: str | None = None) -> DataFrame:
    """Per rule and day with checks: of the last `days` up to today (None: of all), of one rule or all."""
    if today is not None:
        checks = checks.where(F.col("day") > F.date_sub(F.lit(today).cast("date"), days))
    if rule_id is not None:
        checks = checks.where(F.col("rule_id") == rule_id)
    return checks.groupBy("rule_id", "day").agg(F.count("*").alias("checks"), F.sum("passed").alias("passed"))


def health(rules: DataFrame, checks: DataFrame, today: str, stale_days: int = 7) -> DataFrame:
    """Every rule, with its checks or without: never checked, or not for stale_days."""
    seen = checks.groupBy("rule_id").agg(F.count("*").alias("n"), F.sum("passed").alias("p"), F.max("day").alias("last"))
    idle = F.datediff(F.lit(today).cast("date"), "last")
    return rules.join(seen, "rule_id", "left").select(
        "rule_id", F.coalesce("n", F.lit(0)).alias("checks"), F.coalesce("p", F.lit(0)).alias("passed"),
        F.col("n").isNull().alias("never"), idle.alias("idle_days"),
        F.coalesce(idle >= stale_days, F.lit(True)).alias("stale"),
    )


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Accuracy, precision, recall, F1 and the share of clean rows that are blocked; a zero denominator gives 0. A null prediction
    has failed: it counts as predicted."""
    t, p = F.col(truth) == 1, F.coalesce(F.col(predicted) == 1, F.lit(True))
    c = rows.agg(
        F.count_if(F.col(predicted).isNull()).alias("failed"),
        *[F.count_if(e).alias(n) for n, e in (("tp", t & p), ("fp", ~t & p), ("fn", t & ~p), ("tn", ~t & ~p))]
    )
    ratio = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(F.lit(0.0)), 9)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(
        "tp", "fp", "fn", "tn", ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(fp, fp + tn).alias("fp_rate"), "failed",
    )


def correction_quality(rows: DataFrame) -> DataFrame:
    """rows: violating, blocked. Recall over violating texts, specificity over the others, and their harmonic mean."""
    v, b = F.col("violating"), F.col("blocked")
    c = rows.agg(
        F.count_if(v & b).alias("caught"), F.count_if(v).alias("violating"), F.count_if(~v & ~b).alias("passed"),
        F.count_if(~v).alias("clean"),
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    recall, spec = ratio(F.col("caught"), F.col("violating")), ratio(F.col("passed"), F.col("clean"))
    return c.withColumns({"recall": F.round(recall, 9), "specificity": F.round(spec, 9), "f1": F.round(ratio(2 * recall * spec, recall + spec), 9)})


def regression(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """bucket, ratio of both; dropped where the current ratio is lower by more than 1e-9. Buckets absent from the baseline are ignored."""
    b, c = baseline.withColumnRenamed("ratio", "before"), current.withColumnRenamed("ratio", "after")
    return b.join(c, "bucket").select("bucket", "before", "after", (F.col("before") - F.col("after") > 1e-9).alias("dropped"))
