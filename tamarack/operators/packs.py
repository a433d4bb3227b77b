"""Context packs: rules and memories within a token budget, hashed and rendered; sessions handed over; audited answers."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import model
from ..functions.text import content_id, estimated_tokens, normalized, scrub
from . import rules as policy
from .memory import active
from .retrieval import within_budget

#: Budget, most rules and memories, share of the budget that rules may take, tokens around each.
BUDGET, MOST_RULES, MOST_MEMORIES, RULE_SHARE, RULE_EXTRA, MEMORY_EXTRA = 2000, 30, 20, 0.5, 6, 2
LEAST_BUDGET, LARGEST_BUDGET, MOST_ITEMS = 1, 200_000, 500


def rule_tokens(rule: DataFrame) -> Column:
    """Of message, rule and patterns, and some for the label."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in rule.columns else F.lit("")
    listed = lambda c: F.coalesce(F.array_join(c, " "), F.lit("")) if c in rule.columns else F.lit("")
    return estimated_tokens(
        F.concat(text("message"), F.lit(" "), text("rule"), F.lit(" "), listed("forbid"), F.lit(" "), listed("require"))
    ) + RULE_EXTRA


def pack_rules(rules: DataFrame, budget: int = BUDGET, share: float = RULE_SHARE, most: int = MOST_RULES) -> DataFrame:
    """The rules of a pack, with cost and position: the most severe first, while they fit their share (one always does)."""
    ranked = rules.withColumn("cost", rule_tokens(rules)).orderBy(*policy.ranked(rules)).limit(most)
    return within_budget(ranked.withColumn("_all", F.lit(1)), "_all", policy.ranked(rules), "cost", int(budget * share)).drop("_all", "running")


def build_packs(
    rules: DataFrame, memories: DataFrame, project: str | None = None, budget: int = BUDGET,
    most_rules: int = MOST_RULES, most_memories: int = MOST_MEMORIES, share: float = RULE_SHARE,
) -> DataFrame:
    """A pack per user. rules: rule_id, project, rule_type, severity, message, rule, forbid, require, status; memories: user_id,
    id, content, salience, score, source, rank (as a search ranks them; without it, by salience and start, active ones that
    are not a third party's).

    user_id, rules and memories (arrays, secrets masked), rules_total, memories_total, truncated. Rules take their share of
    the budget first, memories what is left; of each the longest prefix that fits, at least one.
    """
    budget, most_rules, most_memories = min(max(budget, LEAST_BUDGET), LARGEST_BUDGET), min(most_rules, MOST_ITEMS), min(most_memories, MOST_ITEMS)
    share = share if 0 <= share <= 1 else RULE_SHARE
    own = policy.in_scope(rules, project)
    total = own.count()
    chosen = pack_rules(own, budget, share, most_rules)
    masked = F.struct(
        "position", F.col("rule_id").alias("id"), F.col("rule_type").alias("type"), "severity",
        scrub(F.coalesce("project", F.lit(""))).alias("project"),
        scrub(F.coalesce("message", F.lit(""))).alias("message"), scrub(F.coalesce("rule", F.lit(""))).alias("rule"),
        F.transform("forbid", scrub).alias("forbid_patterns"), F.transform("require", scrub).alias("require_patterns"),
        "cost",
    )
    listed = [r.asDict(True) for r in chosen.select(masked.alias("r")).select("r.*").orderBy("position").collect()]
    left = budget - sum(r["cost"] for r in listed)

    m = memories if "rank" in memories.columns else ranked_memories(memories, most_memories)
    m = m.where(F.col("rank") <= most_memories)
    sized = m.groupBy("user_id").agg(F.count("*").alias("memories_total"))
    m = m.withColumn("content", scrub(F.coalesce("content", F.lit("")))).where("content != ''").withColumn(
        "cost", estimated_tokens(F.col("content")) + MEMORY_EXTRA,
    )
    fit = within_budget(m, "user_id", [F.col("rank")], "cost", left)
    item = F.struct(
        "position",
        F.struct(
            "content", F.col("score").cast("double").alias("score"), F.col("salience").cast("double").alias("salience"),
            scrub(F.coalesce("source", F.lit(""))).alias("source"),
        ).alias("m"),
    )
    per = fit.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["m"]).alias("memories"))
    kind = "array<struct<id:string,type:string,severity:string,project:string,message:string,rule:string,forbid_patterns:array<string>,require_patterns:array<string>>>"
    fixed = F.from_json(F.lit(json.dumps([{k: v for k, v in r.items() if k not in ("position", "cost")} for r in listed])), kind)
    out = sized.join(per, "user_id", "left").withColumn("rules", fixed)
    out = out.withColumn(
        "memories",
        F.coalesce(
            "memories", F.array().cast("array<struct<content:string,score:double,salience:double,source:string>>"),
        ),
    )
    cut = (F.lit(len(listed) < total)) | (F.size("memories") < F.col("memories_total"))
    return out.select(
        "user_id", F.lit(project).cast("string").alias("project"), "rules", "memories",
        F.lit(total).alias("rules_total"), "memories_total", cut.alias("truncated"),
    )


def ranked_memories(memories: DataFrame, most: int) -> DataFrame:
    """Each user's active memories that are not a third party's, by salience and start; the first `most`."""
    order = Window.partitionBy("user_id").orderBy(F.coalesce("salience", F.lit(0.0)).desc(), F.coalesce("valid_at", F.lit(0.0)).desc(), "id")
    m = active(memories, exclude_third=True).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return m.withColumn("score", F.lit(None).cast("double"))


def finish_packs(packs: DataFrame) -> DataFrame:
    """Adds markdown, token_estimate and hash: 16 hex digits of the SHA-256 of rules, memories and project as JSON with sorted
    keys. A pack is bounded by its budget, so each is made in one piece."""
    schema = packs.withColumns({"markdown": F.lit(""), "hash": F.lit("")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            body = [
                json.dumps(
                    {"rules": r["rules"], "memories": r["memories"], "project": r["project"]}, ensure_ascii=False,
                    sort_keys=True,
                ) for r in rows
            ]
            digests = [hashlib.sha256(x.encode()).hexdigest()[:16] for x in body]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([markdown(r) for r in rows], pa.string()), pa.array(digests, pa.string())],
                names=[*b.schema.names, "markdown", "hash"],
            )

    return packs.mapInArrow(run, schema).withColumn("token_estimate", estimated_tokens(F.col("markdown")))


def markdown(pack: dict) -> str:
    """The headings and labels of a rendered pack."""
    out = ["# Context Pack"]
    if pack["project"]:
        out.append(f"_proje: {pack['project']}_")
    if pack["memories"]:
        out += ["\n## Bilinen gerçekler (memory)", *(f"- {m['content']}" for m in pack["memories"])]
    if pack["rules"]:
        out.append("\n## Uygulanacak kurallar (policy)")
    for r in pack["rules"] or ():
        out.append(f"- [{(r['type'] or '').upper()}/{r['severity']}] {r['message']}")
        for label, value in (
            ("niyet", r["rule"]), ("yasak", ", ".join(r["forbid_patterns"] or ())),
            ("zorunlu", ", ".join(r["require_patterns"] or ())),
        ):
            if value:
                out.append(f"    {label}: {value}")
    if pack["truncated"]:
        out.append("\n_(token bütçesi nedeniyle kırpıldı)_")
    return "\n".join(out)


def snapshot(handoffs: DataFrame, sessions: DataFrame, facts: DataFrame, outcomes: DataFrame, now: float) -> DataFrame:
    """The table of sessions after these (session_id, user_id, summary). facts: key, session_id; outcomes: key, id, as memory
    ingest gives them. An old row keeps its created_at; the summary's secrets are masked."""
    ids = facts.join(outcomes.where("id is not null"), "key").groupBy("session_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("key", "id"))), lambda x: x["id"]).alias("fact_ids")
    )
    new = sessions.join(ids, "session_id", "left").select(
        "session_id", "user_id", scrub(F.coalesce("summary", F.lit(""))).alias("summary"),
        F.coalesce("fact_ids", F.array().cast("array<string>")).alias("fact_ids"), F.lit(now).alias("created_at"),
        F.lit(now).alias("updated_at"),
    )
    from .memory import upsert

    return upsert(handoffs.select(*new.columns), new, ["session_id"], ["created_at"])


def resume(handoffs: DataFrame, wanted: DataFrame, packs: DataFrame) -> DataFrame:
    """Each wanted session_id: found, its summary and fact_ids, and its user's pack."""
    h = handoffs.select("session_id", "user_id", "summary", "fact_ids", F.lit(True).alias("_found"))
    out = wanted.select("session_id").join(h, "session_id", "left").join(packs, "user_id", "left")
    return out.withColumn("found", F.coalesce("_found", F.lit(False))).drop("_found")


def memory_id(tenant: str, user: Column, content: Column) -> Column:
    return content_id("mem-", F.lit(tenant), user, normalized(content))


def audit(answers: DataFrame, verdicts: DataFrame) -> DataFrame:
    """answers: id, answer, reply (the claims a model found in it), cites (structs with a url); verdicts: id, violations, allow,
    checked, as enforcement gives them for the scrubbed answers. Each with its claims and how many there are of each kind."""
    said = answers.withColumn("claims", model.claims(F.col("reply"), F.col("cites")))
    count = lambda kind: F.size(F.filter("claims", lambda c: c["type"] == kind)).alias(kind)
    return said.select(
        "id", "answer", "claims", *[count(k) for k in model.CLAIMS], F.size("cites").alias("sources"),
    ).join(verdicts.select("id", "violations", "allow", "checked"), "id")
