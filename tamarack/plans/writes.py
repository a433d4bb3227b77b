"""Registered queries of writes: memories, rules, edges, sessions, categories, jobs, quotas, tokens, hooks.

Written rows are parts of the driver's tables met with other parts of them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import graph, memory, rules, taxonomy, usage
from ..sources import bundles, delivery, store
from ..sources.tables import keep
from .catalog import _HASH, _memories, _t, query

NOW = 5000.0


def _rows(spark, d):
    """Documents as whole memory rows."""
    m = _memories(spark, d)
    return m.withColumns(
        {
            "embedding": F.array(F.col("id").cast("double")), "salience": (F.col("id") % 6).cast("double"),
            "valid_at": F.col("id").cast("double"), "updated_at": F.col("id").cast("double"),
            "invalid_at": F.when(F.col("id") % 7 == 0, 1.0), "access_count": (F.col("id") % 2).cast("long"),
            "last_accessed": F.lit(None).cast("double"),
            "subject_party": F.when(F.col("id") % 3 == 0, "third_party").when(F.col("id") % 3 == 1, "self"),
            "node_id": F.when(F.col("id") % 2 == 0, "old"),
        }
    )


def _picked(spark, d):
    """Ids of labelled documents, those divisible by 5 twice."""
    ids = _t(spark, d, "labels").select(F.col("doc_id").alias("id"))
    return ids.union(ids.where("id % 5 = 0"))


_PICKED = "p as (select doc_id as id, count(*) * case when doc_id % 5 = 0 then 2 else 1 end as n from labels group by doc_id)"


@query(f"""with {_PICKED} select doc_id as id, case when n is not null and doc_id % 7 <> 0 then least(5, doc_id % 6 + 0.5::double * n) else doc_id % 6 end::double as salience,
case when n is not null and doc_id % 7 <> 0 then 5000 else doc_id end::double as updated_at from documents left join p on id = doc_id""")
def memory_reinforce(spark, d):
    return memory.reinforce(_rows(spark, d), _picked(spark, d), F.lit(NOW)).select("id", "salience", "updated_at")


@query(f"with {_PICKED} select doc_id as id, doc_id % 2 + coalesce(n, 0) as access_count, case when n is not null then 5000::double end as last_accessed from documents left join p on id = doc_id")
def memory_touch(spark, d):
    return memory.touch(_rows(spark, d), _picked(spark, d), F.lit(NOW)).select("id", "access_count", "last_accessed")


@query(f"select doc_id as id, {_HASH} as content_hash from documents where doc_id % 3 <> 0 and doc_id % 7 <> 0")
def forget_subject(spark, d):
    """A null party is the user's own. Tombstones by id of what is forgotten."""
    m = _rows(spark, d)
    left, stones = memory.forget(m, memory.of_subject(m, "self"), F.lit(NOW))
    gone = left.where("content = '' and invalid_at = 5000").select("id")
    return gone.join(
        m.select("id", text.content_hash(F.col("content")).alias("content_hash")), "id",
    ).join(stones.select("content_hash").distinct(), "content_hash", "left_semi").select("id", "content_hash")


@query("""select coalesce(a.doc_id, b.doc_id) as id, sha1(coalesce(b.text, a.text, '')) as content, case when b.doc_id is null then a.doc_id % 6 when a.doc_id is null then 1 else least(5, a.doc_id % 6 + 0.5::double) end::double as salience,
case when b.doc_id is null then a.doc_id else 5000 end::double as valid_at, case when a.doc_id % 7 = 0 then 1::double end as invalid_at
from (select * from documents where doc_id % 3 <> 0) a full join (select doc_id, 'new ' || lang as text from documents where doc_id % 2 = 0) b on a.doc_id = b.doc_id""")
def memory_add(spark, d):
    m = _rows(spark, d)
    new = _t(spark, d, "documents").where("doc_id % 2 = 0").select(
        F.col("doc_id").alias("id"), F.concat(F.lit("new "), "lang").alias("content"),
        F.lit(None).cast("array<double>").alias("embedding"),
    )
    return memory.add(m.where("id % 3 != 0"), new, F.lit(NOW)).select(
        "id", F.sha1(F.coalesce("content", F.lit(""))).alias("content"), "salience", "valid_at", "invalid_at",
    )


@query("""select coalesce(a.doc_id, b.doc_id) as id, case when a.doc_id is null then 1 else a.doc_id % 6 end::double as salience from (select * from documents where doc_id % 3 <> 0) a
full join (select * from documents where doc_id % 2 = 0) b on a.doc_id = b.doc_id""")
def memory_bulk_add(spark, d):
    """A bulk load raises no salience."""
    m = _rows(spark, d)
    return memory.add(
        m.where("id % 3 != 0"), m.where("id % 2 = 0").select("id", "content", "embedding"), F.lit(NOW), raised=False,
    ).select("id", "salience")


@query("select coalesce(a.h, b.h) as content_hash, case when b.h is null then a.e else b.e end as e from (select 'h' || doc_id as h, doc_id as e from labels where doc_id % 3 <> 0) a full join (select 'h' || doc_id as h, case when doc_id % 4 = 0 then null else -doc_id end as e from labels where doc_id % 2 = 0) b on a.h = b.h")
def tombstone_upsert(spark, d):
    t = _t(spark, d, "labels").select(F.concat(F.lit("h"), "doc_id").alias("content_hash"), F.col("doc_id").alias("e"))
    new = t.where("e % 2 = 0").withColumn("e", F.when(F.col("e") % 4 != 0, -F.col("e")))
    return memory.upsert(t.where("e % 3 != 0"), new, ["content_hash"], [])


def _rules(spark, d):
    return _t(spark, d, "part").select(
        F.concat(F.lit("r"), "p_partkey").alias("rule_id"), F.col("p_brand").alias("project"),
        F.lit("soft").alias("rule_type"), F.col("p_name").alias("message"),
        F.when(F.col("p_size") % 10 == 0, "disabled").otherwise("active").alias("status"), "p_partkey", "p_size",
    )


@query("select 'r' || p_partkey as rule_id, case when p_size % 10 = 0 or p_partkey % 4 = 0 then 'disabled' else 'active' end as status from part")
def rule_disable(spark, d):
    r = _rules(spark, d)
    return rules.disable(r, r.where("p_partkey % 4 = 0").select("rule_id")).select("rule_id", "status")


@query("select 'r' || p_partkey as rule_id, case when p_partkey % 4 = 0 then 'delete' end as change from part")
def rule_delete(spark, d):
    r = _rules(spark, d)
    left, gone = rules.delete(r, r.where("p_partkey % 4 = 0").select("rule_id"))
    return left.select("rule_id", F.lit(None).cast("string").alias("change")).union(gone.select("rule_id", "change"))


@query("""with a as (select lower(p_brand) as p, lower(p_name) as m, min('r' || p_partkey) as rule_id from part where p_size % 10 <> 0 group by 1, 2)
select p_partkey as key, a.rule_id from part left join a on lower(p_brand) = p and lower(p_name) = m""")
def rule_match(spark, d):
    """Each part's rule in capitals and with blanks doubled: the first active one that says the same."""
    r = _rules(spark, d)
    wanted = r.select(
        F.col("p_partkey").alias("key"), F.upper("project").alias("project"), "rule_type",
        F.concat(F.lit("  "), F.replace(F.upper("message"), F.lit(" "), F.lit("  "))).alias("message"),
    )
    return rules.existing(r, wanted)


_CORRECTIONS = """c as (select p_partkey as key, case p_size % 3 when 0 then 'None' when 1 then p_brand end as project, case when p_size % 7 = 0 then 'skill-fix' else 'procedure' end as category, p_name as rule, p_type as wrong,
case p_size % 5 when 0 then ' HIGH ' when 1 then 'low' else 'odd' end as severity, case when p_size % 6 = 0 then 'iban' else 'style' end as tag, p_size from part),
k as (select *, case when lower(project) = 'none' then null else project end as pr, tag = 'iban' as pii, case when lower(trim(severity)) in ('high', 'low') then lower(trim(severity)) else 'high' end as sev from c)"""


def _corrections(spark, d):
    s = F.col("p_size")
    return _t(spark, d, "part").select(
        F.col("p_partkey").alias("key"), F.when(s % 3 == 0, "None").when(
            s % 3 == 1, F.col("p_brand"),
        ).alias("project"), F.when(s % 7 == 0, "skill-fix").otherwise("procedure").alias("category"),
        F.col("p_name").alias("reusable_rule"), F.col("p_type").alias("what_was_wrong"), F.lit("").alias("correct_behavior"), F.when(
            s % 5 == 0, " HIGH ",
        ).when(s % 5 == 1, "low").otherwise("odd").alias("severity"),
        F.array(F.when(s % 6 == 0, "iban").otherwise("style")).alias("tags"), F.array(F.lit(" abc "), F.lit("a b"), F.lit("lo.ng")).alias("forbid_terms"))


@query(f"with {_CORRECTIONS} select key, case when pii then 'hard' else 'soft' end as rule_type, sev as severity, case when pii then 4 else 2 end as patterns, case when pii then '' else 'a\\ b|lo\\.ng' end as terms from k")
def correction_compile(spark, d):
    c = rules.compile_corrections(_corrections(spark, d))
    return c.select(
        "key", "rule_type", "severity", F.size("forbid").alias("patterns"),
        F.when(F.col("rule_type") == "soft", F.array_join("forbid", "|")).otherwise("").alias("terms"),
    )


_SLUG = "trim(substr(regexp_replace(lower(rule), '[^a-z0-9]+', '-', 'g'), 1, 40), '-')"
_BASE = "replace(lower(coalesce(pr, 'global')), ' ', '-')"
_RULE_ID = f"{_BASE} || '-' || {_SLUG} || '-' || substr(sha1({_BASE} || '|' || case when pii then 'hard' else 'soft' end || '|' || lower(rule)), 1, 8)"


@query(f"""with {_CORRECTIONS}, a as (select lower(pr) as p, case when pii then 'hard' else 'soft' end as t, lower(rule) as m, min('r' || key) as id from k where p_size % 2 = 0 group by 1, 2, 3)
select k.key, 'corr-' || substr(sha1('t1|' || rule || '|' || wrong), 1, 12) as correction_id, case when category <> 'skill-fix' then coalesce(a.id, {_RULE_ID}) end as rule_id
from k left join a on coalesce(lower(pr), '') = coalesce(p, '') and m = lower(rule) and t = case when pii then 'hard' else 'soft' end""")
def correction_ingest(spark, d):
    """Half of the rules are there already, under ids of their own."""
    c = _corrections(spark, d)
    project = F.when(F.lower("project") != "none", F.col("project"))
    old = c.join(_t(spark, d, "part").where("p_size % 2 = 0").select(F.col("p_partkey").alias("key")), "key").select(
        F.concat(F.lit("r"), "key").alias("rule_id"), project.alias("project"),
        F.when(F.col("tags")[0] == "iban", "hard").otherwise("soft").alias("rule_type"),
        F.col("reusable_rule").alias("message"), F.lit("active").alias("status"),
    )
    rows, written = rules.learn(old, c, "t1")
    return rows.select("key", F.col("id").alias("correction_id")).join(written.select("key", "rule_id"), "key", "left")


def _edges(spark, d):
    e = _t(spark, d, "events")
    return e.select(
        F.col("event_id").alias("edge_id"), "user_id",
        F.when(F.col("event_id") % 4 == 0, F.col("event_id") + 50.0).alias("invalid_at"),
        F.when(F.col("event_id") % 9 == 0, 1.0).alias("expired_at"),
    )


@query("""with e as (select event_id as edge_id, case when event_id % 4 = 0 then event_id + 50 end as i, event_id % 9 = 0 as x from events where event_id % 5 <> 0),
b as (select edge_id, case when not x and edge_id % 3 = 0 and (i is null or i > edge_id + 20) then edge_id + 20 else i end::double as invalid_at from e)
select * from b union all select event_id, 7::double from events where event_id % 5 = 0""")
def edge_bounds(spark, d):
    e = _edges(spark, d)
    new = e.where("edge_id % 5 = 0 or edge_id % 7 = 0").withColumn("invalid_at", F.lit(7.0))
    ends = e.where("edge_id % 3 = 0").select("edge_id", (F.col("edge_id") + 20.0).alias("at"))
    return graph.bound_and_add(e.where("edge_id % 5 != 0"), ends, new).select("edge_id", "invalid_at")


@query("select event_id as id, case when event_id % 9 = 0 then 1 when event_id % 2 = 0 then 5000 end::double as expired_at from events")
def edge_expire(spark, d):
    e = _edges(spark, d).withColumnRenamed("edge_id", "id")
    return graph.expire(e, e.where("id % 2 = 0").select("id"), F.lit(NOW)).select("id", "expired_at")


@query("""select coalesce(a.c_custkey, b.c_custkey) as id, coalesce(b.name, a.c_name) as name, case when b.c_custkey is null or b.e is null then a.c_acctbal else b.e end as e
from (select * from customer where c_custkey % 3 <> 0) a full join (select c_custkey, upper(c_name) as name, case when c_custkey % 4 = 0 then c_acctbal + 1 end as e from customer where c_custkey % 2 = 0) b on a.c_custkey = b.c_custkey""")
def entity_upsert(spark, d):
    c = _t(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("kind"),
        F.array("c_acctbal").alias("embedding"),
    )
    new = c.where("id % 2 = 0").select(
        "id", F.upper("name").alias("name"), "kind",
        F.when(F.col("id") % 4 == 0, F.transform("embedding", lambda x: x + 1)).alias("embedding"),
    )
    return graph.upsert_entities(c.where("id % 3 != 0"), new).select("id", "name", F.get("embedding", 0).alias("e"))


@query("""with f as (select event_id as arrival, user_id % 40 as subject, case when event_id % 4 = 0 then 'kullanir' else 'last_action' end as predicate, event_type as object, (event_id * 7919) % 1000 as valid_at from events),
o as (select *, row_number() over (partition by subject, predicate order by arrival) as n from f where predicate = 'last_action'),
s as (with recursive r as (select subject, arrival, object, valid_at, n, true as keep, case when valid_at <= 800 then valid_at end as at, case when valid_at <= 800 then object end as cur from o where n = 1
  union all select o.subject, o.arrival, o.object, o.valid_at, o.n, r.cur is null or o.object <> r.cur,
  case when (r.cur is null or o.object <> r.cur) and o.valid_at <= 800 and (r.at is null or o.valid_at > r.at) then o.valid_at else r.at end,
  case when (r.cur is null or o.object <> r.cur) and o.valid_at <= 800 and (r.at is null or o.valid_at > r.at) then o.object else r.cur end
  from r join o on o.subject = r.subject and o.n = r.n + 1) select * from r),
k as (select subject, object, valid_at, min(arrival) as arrival from s where keep group by all),
m as (select *, min(case when valid_at <= 800 then arrival end) over (partition by subject, object) as b from f where predicate = 'kullanir'),
u as (select subject, object, valid_at, min(arrival) as arrival from m where b is null or arrival <= b group by all)
select arrival, subject, 'last_action' as predicate, object, valid_at, (select min(g.valid_at) from k g where g.subject = k.subject and g.object <> k.object and (g.valid_at > k.valid_at or g.valid_at = k.valid_at and g.arrival < k.arrival)) as invalid_at from k
union all select arrival, subject, 'kullanir', object, valid_at, null from u""")
def graph_ingest(spark, d):
    """Facts out of order, some after the present (800), single- and multi-valued."""
    predicate = F.when(F.col("event_id") % 4 == 0, "kullanir").otherwise("last_action")
    f = _t(spark, d, "events").select(
        F.col("event_id").alias("arrival"), (F.col("user_id") % 40).alias("subject"), predicate.alias("predicate"),
        F.col("event_type").alias("object"), ((F.col("event_id") * 7919) % 1000).alias("valid_at"),
    )
    return graph.assert_facts(f, 800)


@query("""with n as (select c_custkey as id from customer order by 1 limit 60), e as (select event_id as id, user_id as source, event_id % 150 as target, event_type as predicate from events)
select id, source, target, predicate from e where source in (select id from n) and target in (select id from n) order by id limit 500""")
def graph_view(spark, d):
    e = _t(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("subject_id"),
        (F.col("event_id") % 150).alias("object_id"), F.col("event_type").alias("predicate"),
    )
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("kind"))
    return graph.view(c, e, 60, 500)[1]


# Categories.
@query("select 't1' as tenant_id, n_name as label from nation where n_nationkey % 3 = 0 union all select 't0', n_name from nation where n_nationkey % 2 = 0")
def taxonomy_replace(spark, d):
    n = _t(spark, d, "nation")
    old = n.select(F.concat(F.lit("t"), F.col("n_nationkey") % 2).alias("tenant_id"), F.col("n_name").alias("label"))
    return taxonomy.replace_nodes(old, n.where("n_nationkey % 3 = 0").select(F.col("n_name").alias("label")), "t1")


@query("select doc_id as id, case when doc_id % 5 = 0 then case when doc_id % 10 = 0 then lang end when doc_id % 2 = 0 then 'old' end as node_id from documents")
def routing_set(spark, d):
    r = _t(spark, d, "documents").where("doc_id % 5 = 0").select(
        F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 10 == 0, F.col("lang")).alias("node_id"),
    )
    return taxonomy.route(_rows(spark, d), r).select("id", "node_id")


# Accounts.
@query("""select coalesce(a.c_custkey, b.c_custkey) as tenant_id, coalesce(b.name, a.c_name) as name, coalesce(b.k, sha256('old')) as key_hash, a.plan
from (select *, 'pro' as plan from customer where c_custkey % 3 <> 0) a full join (select c_custkey, upper(c_name) as name, sha256('key-' || c_custkey) as k from customer where c_custkey % 2 = 0) b on a.c_custkey = b.c_custkey""")
def tenant_upsert(spark, d):
    c = _t(spark, d, "customer")
    old = c.where("c_custkey % 3 != 0").select(
        F.col("c_custkey").alias("tenant_id"), F.col("c_name").alias("name"),
        F.sha2(F.lit("old"), 256).alias("key_hash"), F.lit("pro").alias("plan"),
    )
    new = c.where("c_custkey % 2 = 0").select(
        F.col("c_custkey").alias("tenant_id"), F.upper("c_name").alias("name"),
        F.sha2(F.concat(F.lit("key-"), "c_custkey"), 256).alias("key_hash"), F.lit(None).cast("string").alias("plan"),
    )
    return memory.upsert(old, new, ["tenant_id"], ["plan"])


@query("select 'sub' || c_custkey as provider_ref, case when c_custkey % 2 = 0 then 'new' else 'old' end || c_nationkey as tenant_id from customer where c_custkey % 2 = 0 or c_custkey % 3 <> 0")
def subscription_link(spark, d):
    c = _t(spark, d, "customer")
    rows = lambda cond, who: c.where(cond).select(F.concat(F.lit("sub"), "c_custkey").alias("provider_ref"), F.concat(F.lit(who), "c_nationkey").alias("tenant_id"))
    return memory.upsert(rows("c_custkey % 3 != 0", "old"), rows("c_custkey % 2 = 0", "new"), ["provider_ref"], [])


@query("""with u as (select event_id as key, user_id as tok, event_type as purpose from events where event_id % 3 = 0), t as (select c_custkey as tok, case when c_custkey % 2 = 0 then 'click' else 'view' end as purpose, c_nationkey as tenant_id from customer where c_custkey % 5 <> 0 and c_custkey % 7 <> 0)
select min(key) as key, any_value(tenant_id)::varchar as tenant_id from u join t using (tok, purpose) group by tok""")
def token_consume(spark, d):
    c = _t(spark, d, "customer")
    tokens = c.select(
        F.sha2(F.col("c_custkey").cast("string"), 256).alias("token_hash"),
        F.col("c_nationkey").cast("string").alias("tenant_id"),
        F.when(F.col("c_custkey") % 2 == 0, "click").otherwise("view").alias("purpose"),
        F.when(F.col("c_custkey") % 5 == 0, 1.0).otherwise(9999.0).alias("expires_at"),
        F.when(F.col("c_custkey") % 7 == 0, 2.0).alias("used_at"),
    )
    uses = _t(spark, d, "events").where("event_id % 3 = 0").select(
        F.col("event_id").alias("key"), F.sha2(F.col("user_id").cast("string"), 256).alias("token_hash"),
        F.col("event_type").alias("purpose"),
    )
    return usage.consume_tokens(tokens, uses, NOW)[1]


@query("select c_custkey::varchar as id, 'member' as role, c_custkey::varchar as tenant_id, true as fresh from customer")
def api_key_create(spark, d):
    """Every key is its own, and finds its tenant and role again by its hash."""
    c = _t(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_custkey").cast("string").alias("tenant_id"),
        F.col("c_name").alias("name"), F.lit("member").alias("role"),
    )
    keys = keep(store.create_keys(c, NOW), "keys")
    owners = keys.limit(0).select("key_hash", "tenant_id")
    many = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    found = store.resolve_keys(keys.select("key"), keys, owners).join(many, "key")
    return found.select("id", "role", "tenant_id", (F.col("n") == 1).alias("fresh"))


# Jobs.
def _jobs(spark, d):
    e = _t(spark, d, "events")
    status = F.when(F.col("event_id") % 3 == 0, "running").otherwise("queued")
    return e.select(
        F.col("event_id").alias("job_id"), F.col("user_id").cast("string").alias("tenant_id"),
        F.col("event_type").alias("kind"), status.alias("status"), (F.col("event_id") % 6).alias("attempts"),
        (F.col("event_id") * 13 % 997).cast("double").alias("created_at"), F.lit(1.0).alias("updated_at"),
    )


@query("select status, count(*) as jobs, sum(attempts)::bigint as attempts from (select case when event_id % 3 = 0 then 'running' else 'queued' end as status, event_id % 6 as attempts from events union all select 'queued', 0 from orders) group by 1")
def job_enqueue(spark, d):
    new = _t(spark, d, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.lit("t1").alias("tenant_id"), F.lit("memory").alias("kind"),
        F.lit("{}").alias("payload"),
    )
    return usage.enqueue(_jobs(spark, d), new, NOW).groupBy("status").agg(F.count("*").alias("jobs"), F.sum("attempts").alias("attempts"))


@query("select event_id as job_id, 'running' as status, event_id % 6 + 1 as attempts from events where event_id % 3 <> 0 order by event_id * 13 % 997, event_id limit 1")
def job_claim_oldest(spark, d):
    return usage.claim(_jobs(spark, d)).select("job_id", "status", "attempts")


@query("""select event_id as job_id, case when event_id % 3 <> 0 then 'queued' when event_type = 'view' then case when event_id % 6 < 5 then 'queued' else 'error' end when event_type in ('click', 'error') then 'done' else 'queued' end as status,
case when event_id % 3 = 0 and event_type = 'view' then 500 when event_id % 3 = 0 and event_type not in ('click', 'error') then length('unknown kind: ' || event_type) end as message from events""".replace("when event_type in ('click', 'error') then 'done' else 'queued' end", "when event_type in ('click', 'error') then 'done' when event_id % 6 < 5 then 'queued' else 'error' end"))
def job_processing(spark, d):
    """Running jobs go to their kind's handler: clicks and errors end, views fail, kinds without a handler fail too."""
    ok = lambda j: j.select("job_id", F.lit("ok").alias("result"), F.lit(3).cast("long").alias("added"), F.lit(None).cast("string").alias("error"))
    bad = lambda j: j.select("job_id", F.lit(None).cast("string").alias("result"), F.lit(0).cast("long").alias("added"), F.repeat(F.lit("x"), 600).alias("error"))
    jobs = _jobs(spark, d)
    results, _ = usage.process(jobs.where("status = 'running'"), {"click": ok, "error": ok, "view": bad})
    return usage.complete(jobs, results.drop("added")).select("job_id", "status", F.length("error").cast("long").alias("message"))


@query("select user_id::varchar as tenant_id, 'memory_add' as op, sum(event_id % 4 - 1)::bigint as n from events where event_id % 3 = 0 and event_id % 4 > 1 group by 1")
def job_metering(spark, d):
    work = lambda j: j.select("job_id", F.lit("ok").alias("result"), (F.col("job_id") % 4).alias("added"), F.lit(None).cast("string").alias("error"))
    jobs = _jobs(spark, d).where("status = 'running'").withColumn("kind", F.lit("memory"))
    return usage.process(jobs, {"memory": work})[1].groupBy("tenant_id", "op").agg(F.sum("n").alias("n"))


_FOLD = """with recursive o as (select {key} as k, event_id as seq, {cost} as cost, row_number() over (partition by {key} order by event_id) as n from events),
r as (select k, seq, cost, n, cost <= {limit} as ok, case when cost <= {limit} then cost else 0 end::double as used from o where n = 1
union all select o.k, o.seq, o.cost, o.n, r.used + o.cost <= {limit}, case when r.used + o.cost <= {limit} then r.used + o.cost else r.used end from r join o on o.k = r.k and o.n = r.n + 1)"""


@query(_FOLD.format(key="user_id", cost="case when event_type in ('view', 'click') then 0.2 when event_type = 'error' then 10 else 1 end::double", limit=25) + " select k as tenant_id, round(max(used), 6) as used, round(25 - max(used), 6) as remaining, count(*) filter (not ok) as refused from r group by 1")
def quota_charge(spark, d):
    op = F.when(F.col("event_type").isin("view", "click"), "memory_search").when(F.col("event_type") == "error", "correct").otherwise("other")
    n = F.when(F.col("event_type") == "error", 2).otherwise(1)
    ops = _t(spark, d, "events").select(
        F.col("user_id").alias("tenant_id"), F.lit("p").alias("period"), F.col("event_id").alias("seq"), op.alias("op"),
        n.alias("n"),
    )
    done, left = usage.charge(ops, 25.0)
    refused = done.groupBy("tenant_id").agg(F.count_if(~F.col("accepted")).alias("refused"))
    return left.join(refused, "tenant_id").select("tenant_id", "used", F.round("remaining", 6).alias("remaining"), "refused")


@query("""select c_custkey as tenant_id, p as plan, n as next_plan, 12::double as overage_per_1000 from (select c_custkey, case c_mktsegment when 'BUILDING' then 'pro' when 'MACHINERY' then 'enterprise' else 'free' end as p from customer)
join (values ('free', 'solo'), ('pro', 'enterprise'), ('enterprise', null)) x(p, n) using (p)""")
def upgrade_hints(spark, d):
    plan = F.when(F.col("c_mktsegment") == "BUILDING", "pro").when(F.col("c_mktsegment") == "MACHINERY", "enterprise").otherwise("lapsed")
    return usage.upgrade_hint(
        _t(spark, d, "customer").select(F.col("c_custkey").alias("tenant_id"), plan.alias("plan"))
    ).select("tenant_id", "plan", "next_plan", "overage_per_1000")


# Hooks.
_KEY = "seal"
_PADS = {x: bytes(b ^ x for b in b"whsec".ljust(64, b"\0")).hex() for x in (0x36, 0x5C)}


def _hmac(message: str) -> str:
    return f"sha256(unhex('{_PADS[0x5C]}') || unhex(sha256(unhex('{_PADS[0x36]}') || encode({message}))))"


@query(f"""with w as (select event_id, user_id::varchar as body, case when event_id % 4 = 0 then 'x' when event_id % 9 = 0 then null else (1000 + event_id % 800)::varchar end as ts from events)
select event_id, coalesce(abs(1300 - try_cast(ts as bigint)) <= 300 and event_id % 5 <> 0, false) as valid from w""")
def webhook_verify(spark, d):
    """Every fifth signature is wrong; some times are no numbers, or null."""
    ts = F.when(F.col("event_id") % 4 == 0, "x").when(F.col("event_id") % 9 == 0, None).otherwise((1000 + F.col("event_id") % 800).cast("string"))
    w = _t(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("body"), ts.alias("timestamp"))
    signed = text.hmac_sha256("whsec", F.concat("timestamp", F.lit("."), "body"))
    return usage.verify(
        w.withColumn("signature", F.when(F.col("event_id") % 5 == 0, "no").otherwise(signed)), "whsec", 1300.0,
    ).select("event_id", "valid")


def _hooks(spark, d):
    s = _t(spark, d, "supplier").where("s_acctbal < 1000")
    events = F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("ping"), F.lit("odd"), F.lit("rule.created"))).otherwise(F.array(F.lit("odd")))
    url = F.when(F.col("s_suppkey") % 9 == 0, "http://127.0.0.1/x").otherwise("https://x.org/in")
    return delivery.register(s.select(F.col("s_suppkey").alias("id"), url.alias("url"), events.alias("events"), F.lit("whsec").alias("secret")), _KEY)


@query("select s_suppkey as id, case when s_suppkey % 2 = 0 then 'ping,rule.created' else '' end as events, true as sealed, true as active from supplier where s_acctbal < 1000")
def webhook_register(spark, d):
    return _hooks(spark, d).select("id", "events", F.col("secret").startswith(text.SEALED).alias("sealed"), "active")


_BODY = """'{"event": "' || ev || '", "data": {"n":"' || user_id || '","k":"[REDACTED_SECRET]"}, "ts": ' || event_id || '}'"""
_SENT = f"""e as (select event_id, user_id, case when event_type = 'click' then 'ping' else 'kg.updated' end as ev from events where event_type in ('click', 'error')),
h as (select s_suppkey as hook_id, s_suppkey % 9 <> 0 as allowed, s_suppkey % 2 = 0 as listed from supplier where s_acctbal < 1000), x as (select *, {_BODY} as body from e, h where ev = 'ping' or not listed)"""


def _sent(spark, d):
    h = _hooks(spark, d).withColumn("events", text.listed(F.col("events")))
    e = _t(spark, d, "events").where("event_type in ('click', 'error')")
    data = F.concat(F.lit('{"n":"'), F.col("user_id"), F.lit('","k":"sk-ant-abcdefghijklmnopqrstuvwxyz"}'))
    e = e.select(
        "event_id", F.when(F.col("event_type") == "click", "ping").otherwise("kg.updated").alias("event"),
        data.alias("data"), F.col("event_id").alias("ts"),
    )
    return h, e, _KEY, F.array(F.lit("93.184.216.34"))


@query(f"with {_SENT} select hook_id, event_id, sha1(body) as body, {_hmac('body')} as signature, allowed from x")
def webhook_deliveries(spark, d):
    return delivery.deliveries(*_sent(spark, d), {"digest": F.sha1}).select("hook_id", "event_id", F.col("digest").alias("body"), "signature", "allowed")


@query(f"with {_SENT} select hook_id, event_id, case when not allowed then 'err: unsafe_url' when event_id % 20 = 0 then 'err: TimeoutError' else '200' end as status from x")
def webhook_send(spark, d):
    def post(url: str, body: str, signature: str, event: str) -> str:
        if int(body.rsplit(" ", 1)[1][:-1]) % 20 == 0:
            raise TimeoutError
        return "200"

    return delivery.send_events(*_sent(spark, d), post)


@query("""with u as (select event_id, (event_id % 256)::varchar || '.' || (event_id % 200)::varchar || '.3.4' as ip, event_id % 256 as a, event_id % 200 as b from events)
select event_id, event_id % 6 <> 0 and not (a in (0, 10, 127) or a >= 224 or (a = 169 and b = 254) or (a = 192 and b = 168) or (a = 172 and b between 16 and 31) or (a = 198 and b in (18, 19))) as safe from u""")
def safe_urls(spark, d):
    e = F.col("event_id")
    ip = F.concat_ws(".", e % 256, e % 200, F.lit("3"), F.lit("4"))
    url = F.when(e % 6 == 0, F.concat(F.lit("ftp://"), ip)).when(
        e % 3 == 0, F.concat(F.lit("https://user@"), ip, F.lit(":8080/p?q")),
    ).otherwise("http://host.org/")
    return _t(spark, d, "events").select("event_id", text.safe_url(url, F.array(ip)).alias("safe"))


@query("""with c as (select case event_type when 'view' then 'GET' else 'POST' end as m, user_id % 3 as s, count(*) as n from events group by 1, 2)
select 'http_requests_total{method="' || m || '",path="/v1/keys/{id}",status="' || s || '"} ' || n as line from c""")
def prometheus_lines(spark, d):
    r = _t(spark, d, "events").select(
        F.when(F.col("event_type") == "view", "GET").otherwise("POST").alias("method"),
        F.concat(F.lit("/v1/keys/"), "event_id").alias("path"), (F.col("user_id") % 3).alias("status"),
    )
    return store.prometheus(store.route_counts(r))


@query("""select 'memories' as name, (select count(*) from documents) as rows, (select count(*) from documents) > 500 as refused union all select 'rules', (select count(*) from part), (select count(*) from part) > 500""")
def bundle_sizes(spark, d):
    """Tables of a bundle, and whether a limit of 500 rows a table refuses them."""

    def refused(name, rows):
        try:
            bundles.check_size({name: rows}, 500, None)
        except ValueError:
            return True
        return False

    tables = {"memories": _t(spark, d, "documents"), "rules": _t(spark, d, "part")}
    sizes = bundles.check_size(tables, None, None)
    return spark.createDataFrame([(n, sizes[n], refused(n, t)) for n, t in tables.items()], "name string, rows long, refused boolean")
