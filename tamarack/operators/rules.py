"""Rule tables: scope, lookups, the monotonic upsert, and corrections compiled into rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pii
from ..functions.text import SEVERITIES, clean_project, clean_terms, fold, normalized, rule_id, severity, severity_rank
from ..functions.yaml import load_yaml

#: Words that mark a correction as one about personal data.
PII_HINT = r"(?iu)(kimlik\s*num|\btckn\b|t\.?\s?c\.?\s*kimlik|kart\s*num|kredi\s*kart|\biban\b|telefon\s*num|hassas\s*(kişisel|kisisel)|(kişisel|kisisel)\s*ver|\bpii\b)"


def in_scope(rules: DataFrame, project: str | None, active_only: bool = True) -> DataFrame:
    """Rules of a project (folded) and those of none; no project: all."""
    out = rules.where("status = 'active'") if active_only else rules
    return out.where(F.col("project").isNull() | (fold(F.col("project")) == fold(F.lit(project)))) if project else out


def learn(rules: DataFrame, corrections: DataFrame, tenant: str) -> tuple[DataFrame, DataFrame]:
    """corrections: key, project, category, reusable_rule, what_was_wrong, correct_behavior, severity, tags, forbid_terms.

    (correction rows with a content-addressed id, rule rows to be written by merge_writes): a rule has the id of an active one
    that says the same, else one of its own content. A correction of category skill-fix writes no rule.
    """
    c = compile_corrections(corrections).withColumn("project", clean_project(F.col("project"))).withColumn(
        "message", F.coalesce("reusable_rule", F.lit("")),
    )
    corr_id = F.concat(
        F.lit("corr-"),
        F.substring(F.sha1(F.concat_ws("|", F.lit(tenant), "message", F.coalesce("what_was_wrong", F.lit("")))), 1, 12),
    )
    c = c.withColumn("correction_id", corr_id)
    have = existing(rules, c.select("key", "project", "rule_type", "message")).withColumnRenamed("rule_id", "_have")
    own = rule_id(F.col("project"), F.col("rule_type"), F.col("message"))
    out = c.where(~F.col("category").eqNullSafe("skill-fix")).join(have, "key", "left")
    written = out.select(
        "key", F.coalesce("_have", own).alias("rule_id"), "project", "rule_type", "severity", "message",
        F.col("forbid").alias("patterns"), F.lit("active").alias("status"), "correction_id",
    )
    return c.select(
        "key", F.col("correction_id").alias("id"), "project",
        F.coalesce("category", F.lit("procedure")).alias("category"), "reusable_rule", "what_was_wrong",
        "correct_behavior", "tags",
    ), written


def from_yaml(spark: SparkSession, path: str) -> DataFrame:
    """The rules of a YAML file (key `rules`), as rule_id, project, rule_type, severity, message, rule, forbid, require."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    loaded = load_yaml(text)
    listed = loaded.get("rules", []) if isinstance(loaded, dict) else loaded or []
    rows = [
        (
            str(r["id"]), r.get("project"), r.get("type"), r.get("severity"), r.get("message"), r.get("rule"),
            [str(x) for x in r.get("forbid_patterns") or []], [str(x) for x in r.get("require_patterns") or []]
        ) for r in listed if isinstance(r, dict) and r.get("id")
    ]
    return spark.createDataFrame(
        rows,
        "rule_id string, project string, rule_type string, severity string, message string, rule string, forbid array<string>, require array<string>",
    )


def seed(rules: DataFrame, loaded: DataFrame) -> DataFrame:
    """rules (as merge_writes gives them) after those of a file are written."""
    new = loaded.select(
        "rule_id", "rule_type", "severity", F.concat("forbid", "require").alias("patterns"),
        F.lit("active").alias("status"), "message", F.lit(1).alias("_at"),
    )
    old = rules.select("rule_id", "rule_type", "severity", "patterns", "status", "message", F.lit(0).alias("_at"))
    return merge_writes(old.union(new), F.col("_at"))


def existing(rules: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (key, project, rule_type, message) with the first id of an active rule that says the same."""
    keys = lambda d: (fold(d["project"]).alias("_p"), d["rule_type"].alias("_t"), normalized(d["message"]).alias("_m"))
    have = rules.where("status = 'active'").select("rule_id", *keys(rules)).groupBy("_p", "_t", "_m").agg(F.min("rule_id").alias("rule_id"))
    return wanted.select("key", *keys(wanted)).join(have, ["_p", "_t", "_m"], "left").select("key", "rule_id")


def merge_writes(writes: DataFrame, order: Column) -> DataFrame:
    """rule_id, rule_type, severity, patterns, status, message: one rule per id after all writes in order.

    The upsert is monotonic (hard stays hard, severity only rises, patterns unite, disabled stays), so it is an
    aggregate with map-side combination, whatever the order; only the message is the last one's.
    """
    hard = (F.lower("rule_type") == "hard") | (F.size("patterns") > 0)
    rank = severity_rank(severity(F.col("severity"), "high"))
    each = writes.select(
        "rule_id", hard.alias("hard"), rank.alias("rank"), F.explode_outer("patterns").alias("pattern"),
        (F.col("status") == "disabled").alias("off"), "message", order.alias("_at"),
    )
    per = each.groupBy("rule_id").agg(
        F.max("hard").alias("hard"), F.max("rank").alias("rank"),
        F.array_sort(F.collect_set("pattern")).alias("patterns"), F.max("off").alias("off"),
        F.max_by("message", "_at").alias("message"), F.count_distinct("_at").cast("long").alias("version"),
    )
    level = F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("rank"))
    return per.select(
        "rule_id", F.when(F.col("hard"), "hard").otherwise("soft").alias("rule_type"), level.alias("severity"),
        "patterns", F.when(F.col("off"), "disabled").otherwise("active").alias("status"), "message", "version",
    )


def disable(rules: DataFrame, ids: DataFrame) -> DataFrame:
    hit = ids.select("rule_id", F.lit(True).alias("_hit")).distinct()
    return rules.join(hit, "rule_id", "left").withColumn("status", F.when(F.col("_hit"), "disabled").otherwise(F.col("status"))).drop("_hit")


def delete(rules: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what stays, history rows of what goes)."""
    return rules.join(ids, "rule_id", "left_anti"), rules.join(ids, "rule_id", "left_semi").withColumn("change", F.lit("delete"))


def by_project(rules: DataFrame) -> DataFrame:
    hard = F.count_if(F.col("rule_type") == "hard")
    return rules.where("status = 'active'").groupBy(F.coalesce("project", F.lit("")).alias("project")).agg(
        F.count("*").alias("rules"), hard.alias("hard"), (F.count("*") - hard).alias("soft"),
        F.max("updated_at").alias("updated_at"),
    )


def ranked(rules: DataFrame) -> list[Column]:
    """Severe first (unknown: medium), hard before soft, then by id."""
    return [severity_rank(severity(F.col("severity"), "medium")).desc(), (F.lower("rule_type") == "hard").desc(), F.col("rule_id").asc()]


def compile_corrections(corrections: DataFrame) -> DataFrame:
    """corrections: correct_behavior, what_was_wrong, reusable_rule, severity, tags, forbid_terms. Adds rule_type and forbid patterns: fixed formats for personal data, else the quoted terms."""
    blob = F.concat_ws(" ", "reusable_rule", "what_was_wrong", "correct_behavior", F.concat_ws(" ", "tags"))
    personal = blob.rlike(PII_HINT)
    fixed = F.array(*[F.lit(p) for p in (pii.CARD, pii.NATIONAL_ID, pii.IBAN, pii.PHONE)])
    return corrections.withColumn("rule_type", F.when(personal, "hard").otherwise("soft")).withColumn(
        "forbid",
        F.when(personal, fixed).otherwise(
            F.coalesce(clean_terms(F.col("forbid_terms")), F.array().cast("array<string>"))
        ),
    ).withColumn("severity", severity(F.col("severity"), "high"))
