"""Entities and edges: names to entities, inserts, bounds, neighbours, edge search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_id, decimal_text, fold
from ..sources.tables import keep
from .containment import contained
from .folds import in_order
from .similarity import cosine_join, followers

SAME_ENTITY, ENTITY_CAP, ANCHOR_BOOST = 0.92, 50_000, 0.00015


def entity_id(tenant: Column, name: Column) -> Column:
    return content_id("ent-", tenant, fold(name))


def _sides(df: DataFrame, key: str) -> DataFrame:
    """key, kind and embedding: kinds are compared trimmed, in lower case."""
    kind = F.lower(F.trim(F.coalesce(F.col("kind").cast("string"), F.lit(""))))
    return df.select(key, kind.alias("kind"), "embedding")


def resolve(mentions: DataFrame, entities: DataFrame, threshold: float = SAME_ENTITY, tenant: str = "", cap: int = ENTITY_CAP) -> DataFrame:
    """mentions: key (their order), name, kind, embedding; entities: id, name, kind, embedding. key, entity_id and how:

    name: the entity of the same folded name (smallest id); vector: the most similar one of a compatible kind at or above
    the threshold (ties: smallest id); batch: an earlier new one of this batch, by name or vector; new: a node of its own,
    named by its folded name; none: a blank name, or no room below `cap` entities. Vectors meet by a cosine-threshold join.
    """
    names = entities.groupBy(fold(F.col("name")).alias("_n")).agg(F.min(F.col("id").cast("string")).alias("by_name"))
    m = keep(mentions.withColumn("_n", fold(F.col("name"))).join(names, "_n", "left"), "mentions")
    near = cosine_join(_sides(m.where("by_name is null and _n != ''"), "key"), _sides(entities, "id"), threshold, best=True)
    m = keep(m.join(near.select("key", F.col("id").cast("string").alias("by_vector")), "key", "left"), "mentions-met")
    fresh = m.where("by_name is null and by_vector is null and _n != ''")
    first = fresh.groupBy("_n").agg(F.min_by(F.struct("key", "kind", "embedding"), "key").alias("x")).select("_n", "x.*")
    led = followers(_sides(keep(first, "mentions-first"), "key"), threshold)
    first = first.join(led, F.col("key") == F.col("later"), "left").select("_n", F.coalesce("leader", "key").alias("leader"))
    opened, space = first.select("leader").distinct(), max(0, cap - entities.count())
    opened = (opened if opened.count() <= space else opened.orderBy("leader").limit(space)).withColumn("_room", F.lit(True))
    named = m.select(F.col("key").alias("leader"), entity_id(F.lit(tenant), F.col("name")).alias("_new"))
    out = m.join(first.join(opened, "leader", "left").join(named, "leader"), "_n", "left")
    how = F.when(F.col("by_name").isNotNull(), "name").when(F.col("by_vector").isNotNull(), "vector").when(~F.coalesce("_room", F.lit(False)), "none")
    how = how.when(F.col("leader") < F.col("key"), "batch").otherwise("new")
    new = F.when(F.col("_room"), F.col("_new"))
    return out.select("key", F.coalesce("by_name", "by_vector", new).alias("entity_id"), how.alias("how"))


def insert_new(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """table with those rows whose key it lacks; among equal keys one is kept."""
    return table.unionByName(rows.dropDuplicates(key).join(table.select(*key), key, "left_anti"), allowMissingColumns=True)


def upsert_entities(entities: DataFrame, new: DataFrame) -> DataFrame:
    """entities (id, name, kind, embedding) after the new ones: name and kind are replaced, a vector stays where the new one is null."""
    o = entities.select("id", F.col("name").alias("_n"), F.col("kind").alias("_k"), F.col("embedding").alias("_e"))
    both = o.join(new.select("id", "name", "kind", "embedding", F.lit(True).alias("_new")), "id", "full")
    pick = lambda a, b: F.when(F.col("_new"), F.col(a)).otherwise(F.col(b)).alias(a)
    return both.select("id", pick("name", "_n"), pick("kind", "_k"), F.coalesce("embedding", "_e").alias("embedding"))


def bound(edges: DataFrame, bounds: DataFrame) -> DataFrame:
    """bounds: edge_id, at. An edge that isn't retracted and is open past `at` ends there."""
    b = bounds.groupBy("edge_id").agg(F.min("at").alias("_at"))
    cut = F.col("_at").isNotNull() & F.col("expired_at").isNull() & (F.col("invalid_at").isNull() | (F.col("invalid_at") > F.col("_at")))
    return edges.join(b, "edge_id", "left").withColumn("invalid_at", F.when(cut, F.col("_at")).otherwise(F.col("invalid_at"))).drop("_at")


def expire(edges: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """Retracts the edges of these ids that are not retracted yet."""
    hit = ids.select("id", F.lit(True).alias("_hit")).distinct()
    now = F.when(F.col("_hit") & F.col("expired_at").isNull(), at).otherwise(F.col("expired_at"))
    return edges.join(hit, "id", "left").withColumn("expired_at", now).drop("_hit")


def bound_and_add(edges: DataFrame, bounds: DataFrame, new: DataFrame) -> DataFrame:
    """edges (edge_id) with the bounds set and the new ones added that it lacks, as one table."""
    return insert_new(bound(edges, bounds), new, ["edge_id"])


def edge_id(tenant: Column, subject: Column, predicate: Column, target: Column, valid_at: Column) -> Column:
    """target: an entity id, or lit: and the folded literal; valid_at: epoch seconds, to the microsecond."""
    return content_id("edg-", tenant, subject, predicate, target, decimal_text(valid_at))


def neighbours(edges: DataFrame, entities: DataFrame, names: DataFrame) -> DataFrame:
    """Edges of the entities so named, with the object's name or literal."""
    wanted = entities.withColumn("_n", fold(F.col("name"))).join(names.select(fold(F.col("name")).alias("_n")).distinct(), "_n", "left_semi")
    objects = entities.select(F.col("id").alias("object_id"), F.col("name").alias("_object"))
    out = edges.join(wanted.select(F.col("id").alias("subject_id")), "subject_id", "left_semi").join(objects, "object_id", "left")
    return out.withColumn("object_name", F.coalesce("_object", "object_value")).drop("_object")


#: Predicates of which a subject has several objects at once (compared folded).
MULTI_VALUED = (
    "likes", "knows", "owns", "has", "related_to", "mentions", "met", "visited", "uses", "sever", "biliyor", "kullanir",
    "kullanıyor", "links_to", "links", "references", "tagged",
)


def many_valued(predicate: Column) -> Column:
    return predicate.isin(*sorted({p.replace("ı", "i") for p in MULTI_VALUED}))


def assert_facts(facts: DataFrame, now: float) -> DataFrame:
    """facts: arrival (their order), subject, predicate (folded), object, valid_at, in any order of valid_at. The edges they
    leave (with invalid_at): a fact whose object is current at `now` already adds nothing, nor does one of the same object and
    valid_at as another; of a single-valued predicate a fact ends when one with another object begins, even if that came
    first (backfill), and at once if another object began at the same time and came first. Multi-valued ones never end.

    What a fact meets on arrival depends on the current object alone, so facts stream past that one value, key by key;
    the ends are windows over what is kept.
    """
    key = ["subject", "predicate"]
    many = many_valued(F.col("predicate"))

    def step(row, current):
        at, obj = current or (None, None)
        if row["object"] == obj:
            return False, current
        begun = row["valid_at"] <= now and (at is None or row["valid_at"] > at)
        return True, (row["valid_at"], row["object"]) if begun else current

    single = in_order(facts.where(~many), key, ["arrival"], step).where("accepted").drop("accepted")
    same = Window.partitionBy(*key, "object")
    begun = F.min(F.when(F.col("valid_at") <= now, F.col("arrival"))).over(same)
    several = facts.where(many).withColumn("_b", begun).where("_b is null or arrival <= _b").drop("_b")
    once = lambda d: d.groupBy(*key, "object", "valid_at").agg(F.min("arrival").alias("arrival"))
    single, several = once(single), once(several)

    at = single.groupBy(*key, "valid_at").agg(F.min_by("object", "arrival").alias("_first"), F.count("*").alias("_c"))
    line = Window.partitionBy(*key).orderBy("valid_at")
    breaks = F.lag("_first").over(line).isNull() | (F.col("_c") > 1) | (F.col("_first") != F.lag("_first").over(line))
    at = at.withColumn("_break", breaks.cast("int")).withColumn("_run", F.sum("_break").over(line))
    later = Window.partitionBy(*key).orderBy("_run").rangeBetween(1, Window.unboundedFollowing)
    at = at.withColumn("_end", F.min("valid_at").over(later)).select(*key, "valid_at", "_first", "_end")
    ended = single.join(at, [*key, "valid_at"]).withColumn(
        "invalid_at", F.when(F.col("object") == F.col("_first"), F.col("_end")).otherwise(F.col("valid_at")),
    )
    columns = ["arrival", *key, "object", "valid_at", "invalid_at"]
    return ended.select(*columns).unionByName(
        several.withColumn("invalid_at", F.lit(None).cast(ended.schema["invalid_at"].dataType)).select(*columns)
    )


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


#: Nodes and edges of a drawing.
MOST_NODES, MOST_EDGES = 600, 2000


def view(entities: DataFrame, edges: DataFrame, most_nodes: int = MOST_NODES, most_edges: int = MOST_EDGES) -> tuple[DataFrame, DataFrame]:
    """A graph to draw: the first entities by id, and the first edges by id that join two of them."""
    nodes = entities.select("id", "name", "kind").orderBy("id").limit(most_nodes)
    ends = F.broadcast(nodes.select("id"))
    both = edges.join(
        ends.withColumnRenamed("id", "subject_id"), "subject_id", "left_semi",
    ).join(ends.withColumnRenamed("id", "object_id"), "object_id", "left_semi")
    return nodes, both.orderBy("id").limit(most_edges).select(
        "id", F.col("subject_id").alias("source"), F.col("object_id").alias("target"), "predicate",
    )


ANCHOR_COSINE, EDGE_CANDIDATES = 0.6, 256


def _words(text: Column) -> Column:
    return F.array_distinct(
        F.filter(
            F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), 0),
            lambda t: F.length(t) > 2,
        )
    )


def anchors(queries: DataFrame, entities: DataFrame, threshold: float = ANCHOR_COSINE) -> DataFrame:
    """query_id, entity_id: entities that a query names, found by automata, or whose vector is near its own, by a cosine-threshold join."""
    e = entities.select(F.col("id").alias("entity_id"), fold(F.col("name")).alias("name"), "embedding")
    texts = queries.select(F.col("query_id").alias("id"), fold(F.col("text")).alias("text"))
    named = contained(texts, e.select("name")).join(e.select("entity_id", "name"), "name").select(F.col("id").alias("query_id"), "entity_id")
    blank = F.lit("").alias("kind")
    near = cosine_join(
        queries.select(F.col("query_id").alias("key"), blank, F.col("query_vec").alias("embedding")),
        e.select(F.col("entity_id").alias("id"), blank, "embedding"), threshold, digits=None,
    )
    return named.unionByName(near.select(F.col("key").alias("query_id"), F.col("id").alias("entity_id"))).distinct()


def search_edges(edges: DataFrame, entities: DataFrame, queries: DataFrame, k: int, candidates: int | None = EDGE_CANDIDATES) -> DataFrame:
    """edges: id, subject_id, object_id, fact, embedding; entities: id, name, embedding; queries: query_id, text, query_vec.
    Each query's dense candidates (None: all edges, as for a search of a point in time), ranked by reciprocal ranks of cosine and word overlap, with a small boost beside an anchor."""
    from .retrieval import dense_candidates, reciprocal_rank, top_k

    c = dense_candidates(edges.select("id", "embedding"), queries, candidates).select(
        "query_id", "id", F.greatest("score", F.lit(0.0)).alias("dense"),
    )
    c = c.join(edges.select("id", "subject_id", "object_id", "fact"), "id").join(
        queries.select("query_id", _words(F.col("text")).alias("_q")), "query_id",
    )
    c = c.withColumn("sparse", F.round(jaccard(_words(F.col("fact")), F.col("_q")), 9)).drop("_q", "fact")
    a = anchors(queries, entities).withColumn("_hit", F.lit(True))
    for end in ("subject_id", "object_id"):
        c = c.join(a.select("query_id", F.col("entity_id").alias(end), F.col("_hit").alias(f"_a_{end}")), ["query_id", end], "left")
    graph = F.coalesce("_a_subject_id", "_a_object_id", F.lit(False))
    fused = reciprocal_rank(c.withColumn("anchored", graph), "query_id", "id", {"dense": 1.0, "sparse": 1.0}, spread=candidates is None)
    scored = fused.withColumn("score", F.round(F.col("rrf") + F.when(F.col("anchored"), ANCHOR_BOOST).otherwise(0.0), 9))
    return top_k(scored, "query_id", "score", "id", k).select(
        "query_id", "id", "subject_id", "object_id", "dense", "sparse", "anchored", "score", "rank",
    )

