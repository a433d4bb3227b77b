"""Memory tables: reads, upserts, deduplication, erasure, and the bi-temporal graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash, content_id, normalized, scrub, stripped
from ..sources.tables import keep
from .similarity import cosine_join, followers

MOST_SALIENCE = 5.0


def merge_by_content(memories: DataFrame) -> DataFrame:
    """One row per user and content: the first id, how often it came, and the salience that repeated adds give."""
    m = memories.withColumn("content_hash", content_hash(F.col("content")))
    return m.groupBy("user_id", "content_hash").agg(F.min("id").alias("id"), F.count("*").alias("times")).withColumn(
        "salience", F.least(F.lit(MOST_SALIENCE), 1 + 0.5 * (F.col("times") - 1)),
    )


def without_tombstones(memories: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Rows whose content hash has no tombstone."""
    return memories.withColumn("content_hash", content_hash(F.col("content"))).join(
        tombstones.select("content_hash").distinct(), "content_hash", "left_anti",
    )


def users(memories: DataFrame) -> DataFrame:
    """Per user of active memories: how many, the last and first time, and the salience."""
    last, first = F.coalesce("updated_at", "valid_at", "created_at"), F.coalesce("created_at", "valid_at")
    return active(memories).groupBy("user_id").agg(
        F.count("*").alias("n"), F.max(last).alias("last"), F.min(first).alias("first"),
        F.sum("salience").alias("salience"),
    )


def add(memories: DataFrame, new: DataFrame, now: Column, raised: bool = True) -> DataFrame:
    """memories (id, content, embedding, salience, valid_at, updated_at, invalid_at) after the new ones (id, content, embedding).

    A known id takes the new content and vector and the time, and its salience rises (not if `raised` is false, as in bulk
    loads); one that ended stays ended. A new id starts with salience 1."""
    columns = memories.columns
    o = memories.select("id", *[F.col(c).alias(f"_o_{c}") for c in columns if c != "id"], F.lit(True).alias("_old"))
    both = o.join(new.select("id", "content", "embedding", F.lit(True).alias("_new")), "id", "full")
    step = F.least(F.lit(MOST_SALIENCE), F.col("_o_salience") + (SALIENCE_STEP if raised else 0.0))
    taken = {
        "content": F.col("content"), "embedding": F.col("embedding"),
        "salience": F.when(F.col("_old"), step).otherwise(1.0), "valid_at": now, "updated_at": now,
    }
    return both.select(
        "id",
        *[
            F.when(
                F.col("_new"), taken.get(c, F.col(f"_o_{c}")),
            ).otherwise(F.col(f"_o_{c}")).alias(c) for c in columns if c != "id"
        ]
    )


def supersede(facts: DataFrame, order: list[Column]) -> DataFrame:
    """Single-valued facts (subject, predicate, object, valid_at): a fact ends when the next one of its key begins; repeats of the current object add nothing."""
    key = Window.partitionBy("subject", "predicate").orderBy(*order)
    changed = facts.withColumn("_before", F.lag("object").over(key)).where(
        F.col("_before").isNull() | (F.col("_before") != F.col("object"))
    ).drop("_before")
    return changed.withColumn("invalid_at", F.lead("valid_at").over(key))


def as_of(edges: DataFrame, when: Column) -> DataFrame:
    return edges.where((F.col("valid_at") <= when) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > when)))


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep: list[str]) -> DataFrame:
    """new replaces old by key; columns in `keep` stay as they were where they were set."""
    o = old.select(*key, *[F.col(c).alias(f"_o_{c}") for c in old.columns if c not in key], F.lit(True).alias("_old"))
    n = new.withColumn("_new", F.lit(True))
    out = [
        F.coalesce(f"_o_{c}", c).alias(c) if c in keep else F.when(
            F.col("_new"), F.col(c),
        ).otherwise(F.col(f"_o_{c}")).alias(c) for c in old.columns if c not in key
    ]
    return o.join(n, key, "full").select(*key, *out)


def quota(usage: DataFrame, limit: int) -> DataFrame:
    """usage: tenant_id, period, ops."""
    u = usage.groupBy("tenant_id", "period").agg(F.sum("ops").alias("used"))
    return u.withColumn("remaining", F.greatest(F.lit(0), limit - F.col("used"))).withColumn("allowed", F.col("used") < limit)


SALIENCE_STEP, SAME_FACT = 0.5, 0.95


def active(memories: DataFrame, user_id: str | None = None, exclude_third: bool = False) -> DataFrame:
    """Rows without an end; a null subject_party is the user's own."""
    out = memories.where("invalid_at is null")
    out = out.where(F.col("user_id") == user_id) if user_id is not None else out
    return out.where("coalesce(subject_party, 'self') != 'third_party'") if exclude_third else out


def reinforce(memories: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Each id raises its row's salience, as often as it comes, and refreshes its time; ended rows stay as they are."""
    n = ids.groupBy("id").agg(F.count("*").alias("_n"))
    hit = F.col("_n").isNotNull() & F.col("invalid_at").isNull()
    m = memories.join(n, "id", "left")
    return m.withColumn(
        "salience",
        F.when(
            hit, F.least(F.lit(MOST_SALIENCE), F.col("salience") + SALIENCE_STEP * F.col("_n")),
        ).otherwise(F.col("salience")),
    ).withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at"))).drop("_n")


def touch(memories: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Each id adds to its row's access_count, as often as it comes, and sets last_accessed."""
    n = ids.groupBy("id").agg(F.count("*").alias("_n"))
    m = memories.join(n, "id", "left")
    count = F.coalesce("access_count", F.lit(0)) + F.coalesce("_n", F.lit(0))
    return m.withColumn("access_count", count).withColumn(
        "last_accessed", F.when(F.col("_n").isNotNull(), now).otherwise(F.col("last_accessed")),
    ).drop("_n")


def forget(memories: DataFrame, doomed: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(memories with content and embedding of the doomed ids erased and ended, tombstones of those that were active)."""
    gone = memories.where("invalid_at is null").join(doomed.select("id").distinct(), "id", "left_semi")
    hit = doomed.select("id", F.lit(True).alias("_hit")).distinct()
    m = memories.join(hit, "id", "left")
    hit = F.col("_hit").isNotNull() & F.col("invalid_at").isNull()
    out = m.withColumn("content", F.when(hit, "").otherwise(F.col("content"))).withColumn("embedding", F.when(~hit, F.col("embedding"))).withColumn(
        "invalid_at", F.when(hit, now).otherwise(F.col("invalid_at")),
    ).drop("_hit")
    return out, gone.select(content_hash(F.col("content")).alias("content_hash"), "embedding")


def of_subject(memories: DataFrame, party: str) -> DataFrame:
    """Active rows of a subject party, as forget() takes them."""
    return active(memories).where(F.coalesce("subject_party", F.lit("self")) == party)


def blocked(facts: DataFrame, tombstones: DataFrame, threshold: float = SAME_FACT) -> DataFrame:
    """facts (content, embedding) that tombstones bar: the same content, a vector at or above the threshold, or no vector while a
    tombstone has one. Vectors meet by a cosine-threshold join, after the cheap tests."""
    f = facts.withColumn("content_hash", content_hash(F.col("content")))
    hashes = tombstones.select("content_hash").distinct()
    vectors = tombstones.where("embedding is not null").select(F.col("content_hash").alias("id"), F.lit("").alias("kind"), "embedding")
    by_hash = f.join(hashes, "content_hash", "left_semi")
    rest = f.join(hashes, "content_hash", "left_anti")
    unknown = rest.where("embedding is null").join(vectors.select("id").limit(1), how="left_semi")
    known = keep(rest.where("embedding is not null").withColumn("_row", F.monotonically_increasing_id()), "facts-known")
    near = cosine_join(known.select(F.col("_row").alias("key"), F.lit("").alias("kind"), "embedding"), vectors, threshold, best=True)
    return by_hash.unionByName(unknown).unionByName(known.join(near.select(F.col("key").alias("_row")), "_row", "left_semi").drop("_row"))


def _side(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, "user_id", F.lit("").alias("kind"), "embedding")


def nearest(facts: DataFrame, memories: DataFrame, threshold: float = SAME_FACT) -> DataFrame:
    """key, id: the user's active memory most similar to each fact, at or above the threshold (ties: the smallest id). Vectors meet by
    a cosine-threshold join within each user, however large."""
    return cosine_join(_side(facts, "key"), _side(active(memories), "id"), threshold, ["user_id"], best=True).select("key", "id")


def ingest(memories: DataFrame, facts: DataFrame, tombstones: DataFrame, tenant: str = "") -> DataFrame:
    """key, outcome and id of each fact (key: their order, user_id, content, embedding), whose secrets are masked first.

    skipped: no content; blocked: by a tombstone; reinforced: the user's active memory `id` has a vector at or above 0.95 or the
    content, or a memory that an earlier fact of the batch added does; added: what is left, as the memory `id`.
    """
    f = keep(
        facts.withColumn(
            "content", stripped(scrub(F.coalesce("content", F.lit("")))),
        ).withColumn("content_hash", content_hash(F.col("content"))),
        "facts",
    )
    said = f.where("content != ''")
    barred = blocked(said.drop("content_hash"), tombstones).select("key").distinct().withColumn("_barred", F.lit(True))
    have = active(memories).groupBy("user_id", content_hash(F.col("content")).alias("content_hash")).agg(F.min("id").alias("_have"))
    near = nearest(said, memories).withColumnRenamed("id", "_near")
    f = f.join(barred, "key", "left").join(have, ["user_id", "content_hash"], "left").join(near, "key", "left")
    f = keep(f.withColumn("id", F.coalesce("_near", "_have")), "facts-met")
    fresh = f.where("content != '' and _barred is null and id is null")
    first = fresh.groupBy("user_id", "content_hash").agg(
        F.min_by(F.struct("key", "embedding"), "key").alias("x")
    ).select("user_id", "content_hash", "x.*")
    led = followers(_side(keep(first, "facts-first"), "key"), SAME_FACT, ["user_id"])
    first = first.join(led, F.col("key") == F.col("later"), "left").select("user_id", "content_hash", F.coalesce("leader", "key").alias("_lead"))
    named = f.select(F.col("key").alias("_lead"), content_id("mem-", F.lit(tenant), F.col("user_id"), normalized(F.col("content"))).alias("_new"))
    out = f.join(first.join(named, "_lead"), ["user_id", "content_hash"], "left")
    state = F.when(F.col("content") == "", "skipped").when(F.col("_barred"), "blocked")
    state = state.when(F.col("id").isNotNull() | (F.col("_lead") < F.col("key")), "reinforced").otherwise("added")
    out = out.withColumn("outcome", state)
    return out.select(
        "key", "outcome",
        F.when(
            F.col("outcome").isin("added", "reinforced"), F.coalesce(F.col("id").cast("string"), "_new"),
        ).alias("id"),
    )


def personal_summary(memories: DataFrame) -> DataFrame:
    return memories.agg(
        F.count_if(F.coalesce("subject_party", F.lit("self")) == "self").alias("own"),
        F.count_if(F.col("subject_party") == "third_party").alias("third_party"),
        F.count_if(F.size("pii_flags") > 0).alias("with_personal_data"),
    )


def assign_labels(rows: DataFrame, least: int = 3) -> DataFrame:
    """rows: id, label. Labels with fewer than `least` members lose them (null)."""
    big = rows.groupBy("label").agg(F.count("*").alias("members")).where(F.col("members") >= least)
    return rows.join(big, "label", "left").select("id", F.when(F.col("members").isNotNull(), F.col("label")).alias("label"), "members")
