"""Registered queries of indexes (vectors, postings) and of joins by bounds. Search queries: vectors of id % 20 = 0, benchmark items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import containment, graph, intervals, memory, postings, retrieval, similarity, usage
from ..sources import keyed
from ..sources.tables import new_path
from .catalog import ORACLE_SQL, _t, _vectors, query
from .extended import _seconds

_COSINES = """s as (select q.vec_id as query_id, e.vec_id as id, round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 6) as score from embeddings e, embeddings q where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, id) as rank from s)"""


@query(f"with {_COSINES} select query_id, id, score, cast(rank as integer) as rank from r where rank <= 10")
def vector_search(spark, d):
    """The index's exact search: cells that the bounds can't rule out are read in a second pass."""
    e, q = _vectors(spark, d)
    return similarity.search_index(spark, similarity.new_index(e), q, 10, exact=True)


@query("select count(*) as queries, true as enough from embeddings where vec_id % 20 = 0")
def vector_recall(spark, d):
    """Whether the index's search by a fixed number of cells finds nine of ten rows that a full scan finds."""
    e, q = _vectors(spark, d)
    found = similarity.search_index(spark, similarity.new_index(e), q, 10)
    got = similarity.index_recall(found, retrieval.dense_candidates(e, q, 10))
    return got.select("queries", (F.col("recall") >= 0.9).alias("enough"))


@query("""select a.vec_id as key, b.vec_id as id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as score
from embeddings a join embeddings b on b.vec_id < a.vec_id and (a.label = b.label or a.label = 0 or b.label = 0) where round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) >= 0.4""")
def cosine_pairs(spark, d):
    """All pairs of vectors at or above 0.4, of equal labels or one of label 0."""
    e, _ = _vectors(spark, d)
    side = lambda c: e.select(F.col("id").alias(c), F.when(F.col("label") != 0, F.col("label").cast("string")).otherwise("").alias("kind"), "embedding")
    return similarity.cosine_join(side("key"), side("id"), 0.4).where("id < key")


@query(ORACLE_SQL["bm25_search"])
def postings_search(spark, d):
    """As bm25_search, from an index that is written in two segments."""
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    path = new_path(spark, "postings")
    postings.append(docs.where("id % 3 = 0"), path)
    postings.append(docs.where("id % 3 != 0"), path)
    return postings.search(spark, path, _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), 10)


_PAIR = "regexp_extract(text, '^([a-zA-Z]+) ([a-zA-Z]+)', {})"
_FOLDED = "lower(trim(translate(coalesce({}, ''), 'İIı', 'iii')))"


@query(f"""with e as (select item_id as entity_id, {_FOLDED.format(_PAIR.format(0))} as name from benchmark)
select doc_id as query_id, entity_id from documents join e on name <> '' and contains({_FOLDED.format('text')}, name)""")
def named_entities(spark, d):
    """The entities (named by the first two words of benchmark items) that each document names."""
    e = _t(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.expr(_PAIR.format(0)).alias("name"), F.lit(None).cast("array<float>").alias("embedding"))
    q = _t(spark, d, "documents").select(F.col("doc_id").alias("query_id"), "text", F.lit(None).cast("array<float>").alias("query_vec"))
    return graph.anchors(q, e)


@query(rf"""with r as (select item_id as rule_id, case when item_id % 3 = 0 then 'LOW' when item_id % 3 = 1 then 'high' else 'odd' end as severity, item_id % 5 = 0 as required,
  {_PAIR.format(1)} || '\s+' || {_PAIR.format(2)} || case when item_id % 2 = 0 then '(s|es)?' else '' end as p from benchmark where {_PAIR.format(0)} <> ''),
t as (select doc_id as id, substr(coalesce(text, ''), 1, 10000) as t from documents)
select id, rule_id, case severity when 'LOW' then 'low' when 'odd' then 'critical' else severity end as severity, case when required then 'missing /' || p || '/' else regexp_extract(t, '(?i)' || p) end as evidence
from t, r where regexp_matches(t, '(?i)' || p) <> required""")
def rulebook_check(spark, d):
    """Rules as a table: the first two words of each benchmark item, forbidden, or required for every fifth."""
    n = F.col("item_id")
    pattern = F.concat(F.expr(_PAIR.format(1)), F.lit(r"\s+"), F.expr(_PAIR.format(2)), F.when(n % 2 == 0, "(s|es)?").otherwise(""))
    none = F.array().cast("array<string>")
    r = _t(spark, d, "benchmark").where(F.expr(_PAIR.format(0)) != "").select(
        n.alias("rule_id"), F.when(n % 3 == 0, "LOW").when(n % 3 == 1, "high").otherwise("odd").alias("severity"),
        F.when(n % 5 != 0, F.array(pattern)).otherwise(none).alias("forbid"), F.when(n % 5 == 0, F.array(pattern)).otherwise(none).alias("require"),
    )
    return containment.check(_t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), r)


@query("""with f as (select user_id as subject, event_type as object, epoch_us(ts) / 1e6 as at_, event_id from events),
g as (select *, lag(object) over (partition by subject order by at_, event_id) as b from f),
e as (select subject, object, at_ as valid_at, lead(at_) over (partition by subject order by at_, event_id) as invalid_at from g where b is null or b <> object)
select event_id, count(*) as others from f join e using (object) where e.valid_at <= f.at_ and (e.invalid_at is null or e.invalid_at > f.at_) group by 1""")
def edges_at_times(spark, d):
    """For each event, the users whose last action was the same at its time: all events' times against all edges."""
    facts = _t(spark, d, "events").select(
        F.col("user_id").alias("subject"), F.lit("last_action").alias("predicate"), F.col("event_type").alias("object"), _seconds().alias("valid_at"), "event_id",
    )
    edges = memory.supersede(facts, [F.col("valid_at"), F.col("event_id")]).select("object", "valid_at", "invalid_at")
    points = facts.select("event_id", "object", F.col("valid_at").alias("at"))
    return intervals.counts_at(points, edges, ["object"], "others").where("others > 0").groupBy("event_id").agg(F.sum("others").alias("others"))


@query("""select doc_id as id, case when l.doc_id is not null then 'labelled' else d.source end as source, case when l.doc_id is not null then coalesce(n_chars, 0) + l.q else n_chars end as n_chars
from documents d left join (select doc_id, max(quality) as q from labels group by 1) l using (doc_id) union all select 1000000 + item_id, 'new', null from benchmark""".replace("case when l.doc_id is not null then", "case when l.q is not null then"))
def keyed_upsert(spark, d):
    """Documents as a keyed table; labelled ones are changed and benchmark items added by one upsert, the rest is left as it lies."""
    path = new_path(spark, "keyed")
    keyed.write_keyed(_t(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "n_chars"), path, ["id"])
    quality = _t(spark, d, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").cast("long").alias("n"))
    added = _t(spark, d, "benchmark").select((F.lit(1_000_000) + F.col("item_id")).alias("id"), F.lit(None).cast("long").alias("n"))

    def merge(old, new):
        both = old.join(new.withColumn("_new", F.lit(True)), "id", "full")
        source = F.when(F.col("_new") & F.col("n").isNull(), "new").when(F.col("_new"), "labelled").otherwise(F.col("source"))
        return both.select("id", source.alias("source"), F.when(F.col("n").isNotNull(), F.coalesce("n_chars", F.lit(0)) + F.col("n")).otherwise(F.col("n_chars")).alias("n_chars"))

    known = quality.join(_t(spark, d, "documents").select(F.col("doc_id").alias("id")), "id", "left_semi").where("n is not null")
    keyed.upsert_keyed(known.unionByName(added), path, ["id"], merge)
    return keyed.read_keyed(spark, path)


@query("""with recursive o as (select event_id as seq, case when event_type = 'purchase' then 5 when event_type = 'view' then 0.5 else 1 end::double as cost, row_number() over (order by event_id) as n from events),
lim as (select floor(sum(cost) / 2)::double as lim from o),
r as (select o.*, cost <= lim as accepted, case when cost <= lim then cost else 0 end as used, lim from o, lim where n = 1
union all select o.*, r.used + o.cost <= lim, case when r.used + o.cost <= lim then r.used + o.cost else r.used end, lim from r join o on o.n = r.n + 1)
select seq, cost, accepted from r""")
def quota_hot_tenant(spark, d):
    """One tenant that holds all rows, decided by prefix sums over ranges."""
    kind = F.col("event_type")
    e = _t(spark, d, "events").select(
        F.lit("t").alias("tenant_id"), F.lit("p").alias("period"), F.col("event_id").alias("seq"),
        F.when(kind == "purchase", 5.0).when(kind == "view", 0.5).otherwise(1.0).alias("cost"),
    )
    limit = e.agg(F.floor(F.sum("cost") / 2)).first()[0]
    return usage.consume(e, float(limit), fold_rows=0).select("seq", "cost", "accepted")
