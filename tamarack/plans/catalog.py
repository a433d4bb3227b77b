"""Registered queries of the engine over the driver's tables, and the SQL that each must equal.

checks: events (rule_id event_type, passed where value < 50); memories: documents (user_id source); facts: events; usage:
events by user and month; tombstones: documents labelled toxic; search queries: benchmark items, and the embeddings
whose id is divisible by 20.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import EMAIL_PATTERN, content_hash, content_id, estimated_tokens
from ..operators import compliance, memory, policy, retrieval
from ..sources.tables import read_table, spread

RULES = ("click", "error", "purchase", "refund", "signup", "view")
TODAY = "2024-02-05"
AS_OF = "2024-01-15 00:00:00"
TEXT_RULES = (
    policy.Rule("no-email", forbid=(EMAIL_PATTERN,)), policy.Rule("no-shouting", forbid=(r"[A-Z]{4,}!!",)),
    policy.Rule("ends-with-stop", require=(r"\.\s*$",)),
)
QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    df = read_table(spark, path)
    return spread(df, path) if name == "documents" else df


def _checks(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select(
        F.col("event_type").alias("rule_id"), F.when(F.col("value") < 50, 1).otherwise(0).alias("passed"),
        F.to_date("ts").alias("day"),
    )


def _memories(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("user_id"), F.col("text").alias("content"))


_CHECKS = "checks as (select event_type as rule_id, case when value < 50 then 1 else 0 end as passed, cast(ts as date) as day from events)"
_HASH = r"sha1(trim(regexp_replace(lower(text), '[\x20\x09-\x0D]+', ' ', 'g')))"


@query(f"with {_CHECKS} select rule_id, count(*) as checks, cast(sum(passed) as bigint) as passed, cast(sum(1 - passed) as bigint) as violations, round(sum(passed) / count(*), 9) as ratio from checks group by rule_id")
def compliance_by_rule(spark, d):
    return compliance.by_rule(_checks(spark, d))


@query(f"with {_CHECKS} select rule_id, day, count(*) as checks, cast(sum(passed) as bigint) as passed from checks group by rule_id, day")
def compliance_timeseries(spark, d):
    return compliance.timeseries(_checks(spark, d))


@query(f"with {_CHECKS} select rule_id, day, count(*) as checks, cast(sum(passed) as bigint) as passed from checks where rule_id = 'error' and day > date '{TODAY}' - 14 group by rule_id, day")
def compliance_trend(spark, d):
    return compliance.timeseries(_checks(spark, d), TODAY, 14, "error")


@query(f"""with {_CHECKS}, s as (select rule_id, count(*) as n, sum(passed) as p, max(day) as last from checks group by rule_id)
select r.rule_id, coalesce(n, 0) as checks, cast(coalesce(p, 0) as bigint) as passed, n is null as never, cast(date_diff('day', last, date '{TODAY}') as integer) as idle_days, coalesce(date_diff('day', last, date '{TODAY}') >= 7, true) as stale
from (select unnest({list(RULES)}) as rule_id) r left join s using (rule_id)""")
def rule_health(spark, d):
    rules = spark.range(1).select(F.explode(F.array(*[F.lit(r) for r in RULES])).alias("rule_id"))
    return compliance.health(rules, _checks(spark, d), TODAY)


@query("""with j as (
select case when doc_id % 50 = 7 then 1 when regexp_matches(text, '[A-Z]{4,}!!') or regexp_matches(text, '(idiot|moron|worthless|clown)') then 1 else 0 end as p, doc_id % 50 = 7 as x, toxic as t from documents join labels using (doc_id)),
c as (select count(*) filter (x) as failed, count(*) filter (t = 1 and p = 1) as tp, count(*) filter (t <> 1 and p = 1) as fp, count(*) filter (t = 1 and p <> 1) as fn, count(*) filter (t <> 1 and p <> 1) as tn from j)
select tp, fp, fn, tn, failed, round(case when fp + tn > 0 then fp / (fp + tn) else 0 end, 9) as fp_rate, round((tp + tn) / (tp + fp + fn + tn), 9) as accuracy, round(case when tp + fp > 0 then tp / (tp + fp) else 0 end, 9) as "precision", round(case when tp + fn > 0 then tp / (tp + fn) else 0 end, 9) as recall, round(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end, 9) as f1 from c""")
def enforcement_confusion(spark, d):
    hit = F.col("text").rlike("[A-Z]{4,}!!") | F.col("text").rlike("(idiot|moron|worthless|clown)")
    rows = _t(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 50 != 7, hit.cast("int")).alias("predicted"))
    return compliance.confusion(rows.join(_t(spark, d, "labels").select("doc_id", "toxic"), "doc_id"), "toxic", "predicted")


@query(f"""with {_CHECKS}, b as (select rule_id as bucket, round(avg(passed), 9) as r from checks where day < date '2024-01-16' group by 1), c as (select rule_id as bucket, round(avg(passed), 9) as r from checks where day >= date '2024-01-16' group by 1)
select bucket, b.r as before, c.r as after, b.r - c.r > 1e-9 as dropped from b join c using (bucket)""")
def eval_regression(spark, d):
    ratio = lambda x: x.groupBy(F.col("rule_id").alias("bucket")).agg(F.round(F.avg("passed"), 9).alias("ratio"))
    c = _checks(spark, d)
    return compliance.regression(ratio(c.where("day < date '2024-01-16'")), ratio(c.where("day >= date '2024-01-16'")))


@query("select doc_id as id, (case when regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}') then 'no-email,' else '' end || case when regexp_matches(text, '[A-Z]{4,}!!') then 'no-shouting,' else '' end || case when not regexp_matches(text, '\\.\\s*$') then 'ends-with-stop,' else '' end) as violations from documents".replace("\\\\", "\\"))
def rule_evaluation(spark, d):
    r = policy.evaluate(_t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), TEXT_RULES)
    return r.select("id", F.array_join(F.transform("violations", lambda v: F.concat(v, F.lit(","))), "").alias("violations"))


@query(f"select source as user_id, {_HASH} as content_hash, min(doc_id) as id, count(*) as times, least(5.0::double, 1 + 0.5::double * (count(*) - 1)) as salience from documents group by 1, 2")
def memory_merge(spark, d):
    return memory.merge_by_content(_memories(spark, d))


@query(f"with h as (select doc_id as id, {_HASH} as content_hash from documents), t as (select content_hash from h join labels on id = doc_id where toxic = 1) select id, content_hash from h where content_hash not in (select content_hash from t)")
def tombstone_guard(spark, d):
    m = _memories(spark, d)
    toxic = _t(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return memory.without_tombstones(m, m.join(toxic, "id").select(content_hash(F.col("content")).alias("content_hash"))).select("id", "content_hash")


@query("""select source as user_id, count(*) as n, max(coalesce(case when doc_id % 2 = 0 then doc_id + 5 end, doc_id))::double as last, min(coalesce(case when doc_id % 3 = 0 then doc_id - 3 end, doc_id))::double as first,
sum(doc_id % 5)::double as salience from documents where doc_id % 7 <> 0 group by 1""")
def list_users(spark, d):
    times = {
        "updated_at": F.when(F.col("id") % 2 == 0, F.col("id") + 5.0), "valid_at": F.col("id").cast("double"),
        "created_at": F.when(F.col("id") % 3 == 0, F.col("id") - 3.0),
    }
    m = _memories(spark, d).withColumns(times | {"salience": (F.col("id") % 5).cast("double"), "invalid_at": F.when(F.col("id") % 7 == 0, 1.0)})
    return memory.users(m)


@query("select doc_id as id, 'mem-' || substr(sha1('t1|' || source || '|' || trim(regexp_replace(lower(text), '[\\x20\\x09-\\x0D]+', ' ', 'g'))), 1, 16) as mem_id from documents")
def memory_ids(spark, d):
    from ..functions.text import normalized

    return _memories(spark, d).select("id", content_id("mem-", F.lit("t1"), F.col("user_id"), normalized(F.col("content"))).alias("mem_id"))


_FACTS = """f as (select user_id as subject, 'last_action' as predicate, event_type as object, ts as valid_at, event_id from events),
g as (select *, lag(object) over (partition by subject, predicate order by valid_at, event_id) as b from f),
e as (select subject, predicate, object, valid_at, event_id, lead(valid_at) over (partition by subject, predicate order by valid_at, event_id) as invalid_at from g where b is null or b <> object)"""


def _edges(spark, d):
    facts = _t(spark, d, "events").select(
        F.col("user_id").alias("subject"), F.lit("last_action").alias("predicate"), F.col("event_type").alias("object"),
        F.col("ts").alias("valid_at"), "event_id",
    )
    return memory.supersede(facts, [F.col("valid_at"), F.col("event_id")])


@query(f"with {_FACTS} select subject, predicate, object, event_id, cast(valid_at as varchar) as valid_at, cast(invalid_at as varchar) as invalid_at from e where valid_at <= timestamp '{AS_OF}' and (invalid_at is null or invalid_at > timestamp '{AS_OF}')")
def graph_as_of(spark, d):
    e = memory.as_of(_edges(spark, d), F.lit(AS_OF).cast("timestamp_ntz"))
    return e.select(
        "subject", "predicate", "object", "event_id", F.col("valid_at").cast("string").alias("valid_at"),
        F.col("invalid_at").cast("string").alias("invalid_at"),
    )


@query(f"with {_FACTS} select object, count(*) as edges, count(invalid_at) as ended from e group by object")
def graph_history(spark, d):
    return _edges(spark, d).groupBy("object").agg(F.count("*").alias("edges"), F.count("invalid_at").alias("ended"))


@query("select user_id as tenant_id, strftime(ts, '%Y-%m') as period, count(*) as used, greatest(0, 60 - count(*)) as remaining, count(*) < 60 as allowed from events group by 1, 2")
def usage_quota(spark, d):
    u = _t(spark, d, "events").select(
        F.col("user_id").alias("tenant_id"), F.date_format("ts", "yyyy-MM").alias("period"),
        F.lit(1).cast("long").alias("ops"),
    )
    return memory.quota(u, 60)


@query("""with s as (select q.vec_id as query_id, e.vec_id as id, round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 6) as score from embeddings e, embeddings q where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, id) as rank from s)
select query_id, id, score, cast(rank as integer) as rank from r where rank <= 5""")
def dense_top_k(spark, d):
    e, q = _vectors(spark, d)
    return retrieval.dense_candidates(e, q, 5)


def _vectors(spark, d):
    """All vectors (id, embedding, label), and the query set: those whose id is divisible by 20."""
    e = _t(spark, d, "embeddings").withColumnRenamed("vec_id", "id")
    return e, e.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vec"))


_TERMS = "list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda t: length(t) > 2)"


@query(f"""with q as (select distinct item_id as query_id, unnest({_TERMS}) as term from benchmark), d as (select doc_id as id, {_TERMS} as w, greatest(1, len({_TERMS})) as dl from documents),
st as (select count(*) as n, avg(dl) as avgdl from d), tf as (select id, dl, term, count(*) as tf from (select id, dl, unnest(w) as term from d) where term in (select term from q) group by all),
df as (select term, count(*) as df from tf group by term),
s as (select query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) as score from q join df using (term) join tf using (term), st group by query_id, id),
r as (select *, row_number() over (partition by query_id order by score desc, id) as rank from s)
select query_id, id, score, cast(rank as integer) as rank from r where rank <= 10""")
def bm25_search(spark, d):
    return retrieval.bm25(
        _t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"),
        _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), 10,
    )


@query("""with i as (select source as user_id, doc_id as id, cast(coalesce(quality, 0) as double) as salience, cast(n_chars as double) as size from documents left join (select doc_id, max(quality) as quality from labels group by 1) using (doc_id)),
r as (select *, row_number() over (partition by user_id, salience > 0 order by salience desc, id) as r1, row_number() over (partition by user_id, size > 0 order by size desc, id) as r2 from i)
select user_id, id, round(case when salience > 0 then 1.0::double / (60 + r1) else 0 end + case when size > 0 then 0.5::double / (60 + r2) else 0 end, 9) as rrf from r""")
def fused_ranking(spark, d):
    lab = _t(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    i = _t(spark, d, "documents").join(lab, "doc_id", "left").select(
        F.col("source").alias("user_id"), F.col("doc_id").alias("id"),
        F.coalesce("quality", F.lit(0)).cast("double").alias("salience"), F.col("n_chars").cast("double").alias("size"),
    )
    return retrieval.reciprocal_rank(i, "user_id", "id", {"salience": 1.0, "size": 0.5}).select("user_id", "id", "rrf")


@query("""with i as (select source as user_id, doc_id as id, greatest(1, length(text) // 4) as cost from documents),
r as (select *, sum(cost) over w as running, row_number() over w as position from i window w as (partition by user_id order by id rows between unbounded preceding and current row))
select user_id, id, cost, cast(running as bigint) as running, cast(position as integer) as position from r where running <= 4000 or position = 1""")
def context_pack(spark, d):
    i = _memories(spark, d).select("user_id", "id", estimated_tokens(F.col("content")).alias("cost"))
    return retrieval.within_budget(i, "user_id", [F.col("id")], "cost", 4000)


@query(f"with {_CHECKS} select rule_id, count(*) as pruned from checks where day < date '2024-01-10' group by 1")
def prune_telemetry(spark, d):
    return _checks(spark, d).where("day < date '2024-01-10'").groupBy("rule_id").agg(F.count("*").alias("pruned"))


from . import agents, extended, indexes, lookups, scalars, search, streams, tenant, writes  # noqa: E402, F401  (they register their queries)
