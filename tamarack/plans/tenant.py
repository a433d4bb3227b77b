"""Registered queries of one tenant's tables: lookups, counts, and rewrites of whole tables.

ROWS binds each table to one of the driver's; its expressions are the same text in Spark and DuckDB. Rows belong to
tenants t0, t1 and t2, and queries run as t1.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import Store
from .catalog import ORACLE_SQL, QUERIES, _t

T = "t1"
ROWS: dict[str, tuple[str, list[str]]] = {
    "memories": (
        "documents",
        [
            "concat('t', doc_id % 3) as tenant_id", "concat('m', doc_id) as id", "source as user_id", "text as content",
            "cast(doc_id % 5 as double) as salience", "cast(doc_id as double) as valid_at",
            "case when doc_id % 7 = 0 then cast(doc_id as double) end as invalid_at",
            "case doc_id % 4 when 0 then 'third_party' when 1 then 'self' when 2 then 'unknown' end as subject_party",
        ],
    ),
    "rules": (
        "part",
        [
            "concat('t', p_partkey % 3) as tenant_id", "concat('r', p_partkey) as rule_id",
            "case when p_size % 5 <> 0 then p_brand end as project",
            "case when p_size % 7 = 0 then 'hard' else 'soft' end as rule_type", "p_name as message",
            "case when p_size % 10 = 0 then 'disabled' else 'active' end as status",
            "concat('[\"', p_type, '\"]') as patterns",
        ],
    ),
    "rule_history": (
        "part",
        [
            "concat('t', p_partkey % 3) as tenant_id", "concat('r', p_size) as rule_id",
            "cast(p_partkey as bigint) as version", "p_name as snapshot",
            "cast(p_partkey % 10 as double) as created_at",
        ],
    ),
    "audit": (
        "events",
        [
            "concat('t', event_id % 3) as tenant_id", "event_type as action", "concat('x', event_id) as target",
            "cast(event_id % 50 as double) as created_at",
        ],
    ),
    "corrections": (
        "conversations",
        [
            "concat('t', conv_id % 3) as tenant_id", "concat(conv_id, '-', turn) as id", "text as raw",
            "case turn % 3 when 0 then '[\"a\",\"b\"]' when 1 then '[broken' end as tags",
        ],
    ),
    "handoffs": (
        "customer",
        [
            "concat('t', c_custkey % 3) as tenant_id", "concat('s', c_custkey) as session_id", "c_name as summary",
            "concat('[\"f', c_custkey, '\"]') as fact_ids", "concat('{\"n\":\"', c_nationkey, '\"}') as metadata",
            "cast(c_custkey % 20 as double) as updated_at",
        ],
    ),
    "taxonomy": (
        "nation",
        [
            "concat('t', n_nationkey % 2) as tenant_id", "concat('n', n_nationkey) as id", "n_name as label",
            "cast(n_regionkey as bigint) as member_count", "n_nationkey % 5 <> 0 as active",
        ],
    ),
    "entities": (
        "customer",
        [
            "concat('t', c_custkey % 3) as tenant_id", "concat('e', c_custkey) as id", "c_name as name",
            "c_mktsegment as kind", "concat('{\"n\":\"', c_nationkey, '\"}') as attributes",
        ],
    ),
    "edges": (
        "events",
        [
            "concat('t', event_id % 3) as tenant_id", "concat('x', event_id) as id",
            "concat('e', user_id) as subject_id", "event_type as predicate", "event_type as fact",
            "cast(event_id as double) as valid_at",
            "case when event_id % 4 = 0 then cast(event_id + 90 as double) end as invalid_at",
            "case when event_id % 11 = 0 then 1.0e0 end as expired_at",
        ],
    ),
    "api_keys": (
        "supplier",
        [
            "concat('t', s_suppkey % 3) as tenant_id", "concat('k', s_suppkey) as id", "s_name as name",
            "case when s_suppkey % 2 = 0 then 'member' else 'owner' end as role",
            "cast(s_suppkey % 4 as double) as created_at", "case when s_suppkey % 5 = 0 then 9.0e0 end as revoked_at",
        ],
    ),
    "hooks": (
        "supplier",
        [
            "concat('t', s_suppkey % 3) as tenant_id", "concat('h', s_suppkey) as id", "s_name as url",
            "case when s_suppkey % 2 = 0 then 'rule.added, memory.added' else '' end as events",
            "s_suppkey % 4 <> 0 as active",
        ],
    ),
    "users": (
        "customer",
        [
            "concat('t', c_custkey % 3) as tenant_id", "concat(lower(c_name), '@x.org') as email",
            "cast(c_custkey % 9 as double) as created_at", "case when c_custkey % 4 <> 0 then 1 end as approved",
        ],
    ),
    "tenants": ("region", ["concat('t', r_regionkey) as tenant_id", "case when r_regionkey = 1 then 'solo' end as plan"]),
    "usage": ("events", ["concat('t', user_id % 3) as tenant_id", "concat('p', event_id % 4) as period", "1.0e0 as ops"]),
    "subscriptions": ("customer", ["concat('t', c_custkey % 3) as tenant_id", "concat('sub-', c_custkey) as provider_ref"]),
    "jobs": (
        "events",
        [
            "concat('t', event_id % 3) as tenant_id", "concat('j', event_id) as job_id", "event_type as kind",
            "case event_id % 5 when 0 then 'queued' when 1 then 'running' when 2 then 'error' else 'done' end as status",
            "concat('{\"n\":\"', user_id, '\"}') as result", "cast(event_id % 70 as double) as created_at",
        ],
    ),
    "checks": (
        "events",
        [
            "concat('t', event_id % 3) as tenant_id", "event_type as rule_id",
            "case when value < 50 then 1 else 0 end as passed", "cast(event_id as double) as created_at",
        ],
    ),
    "violations": ("events", ["concat('t', user_id % 3) as tenant_id", "event_type as rule_id", "cast(event_id as double) as created_at"]),
    "tombstones": ("labels", ["concat('t', doc_id % 3) as tenant_id", "concat('h', doc_id) as content_hash"]),
}
CTES = {name: f"{name} as (select {', '.join(columns)} from {table})" for name, (table, columns) in ROWS.items()}


def store(spark, d, names, tenant: str | None = T) -> Store:
    return Store(spark, {n: _t(spark, d, ROWS[n][0]).selectExpr(*ROWS[n][1]) for n in names}, tenant)


def add(name: str, names: str, sql: str, run: Callable[[Store], DataFrame]) -> None:
    """Register run(store of the named tables) and its SQL, in which the tables bear their names."""
    tables = names.split()

    def fn(spark, d):
        return run(store(spark, d, tables))

    fn.__name__ = name
    QUERIES[name] = fn
    ORACLE_SQL[name] = f"with {', '.join(CTES[n] for n in tables)} {sql}"


def flat(df: DataFrame, *columns: str) -> DataFrame:
    """The columns, lists joined by commas and maps as k=v."""
    kinds = dict(df.dtypes)
    one = lambda c: F.array_join(c, ",") if kinds[c].startswith("array") else F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return df.select(*[one(c).alias(c) if kinds[c].startswith(("array", "map")) else c for c in columns])


_OWN = f"tenant_id = '{T}'"
_LIVE = f"{_OWN} and expired_at is null and valid_at <= 500 and (invalid_at is null or invalid_at > 500)"

# Point lookups and scans.
add("active_memories", "memories", f"select id, user_id from memories where {_OWN} and invalid_at is null and coalesce(subject_party, 'self') <> 'third_party'", lambda s: _active(s).select("id", "user_id"))
add("get_memory", "memories", f"select id, user_id, sha1(content) as content, salience from memories where {_OWN} and id = 'm7'", lambda s: s.get("memories", "id", "m7").select("id", "user_id", F.sha1("content").alias("content"), "salience"))
add("get_tombstones", "tombstones", f"select content_hash from tombstones where {_OWN}", lambda s: s.table("tombstones").select("content_hash"))
add("get_corrections", "corrections", f"select id, case when tags = '[\"a\",\"b\"]' then 'a,b' else '' end as tags from corrections where {_OWN}", lambda s: flat(s.table("corrections").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>"))), "id", "tags"))
add("rule_history", "rule_history", f"select version, snapshot from rule_history where {_OWN} and rule_id = 'r7' order by created_at desc, version desc limit 5", lambda s: s.rule_history("r7", 5).select("version", "snapshot"))
add("admin_log", "audit", f"select action, target, created_at from audit where {_OWN} order by created_at desc, target desc limit 100", lambda s: s.admin_log().select("action", "target", "created_at"))
add("get_handoff", "handoffs", f"select session_id, summary, 'f' || substr(session_id, 2) as fact_ids, 'n=' || regexp_extract(metadata, '[0-9]+') as metadata from handoffs where {_OWN} and session_id = 's4'", lambda s: flat(s.handoff("s4"), "session_id", "summary", "fact_ids", "metadata"))
add("list_handoffs", "handoffs", f"select session_id, updated_at from handoffs where {_OWN}", lambda s: s.handoffs().select("session_id", "updated_at"))
add("list_taxonomy", "taxonomy", f"select label, member_count from taxonomy where {_OWN} and active", lambda s: s.taxonomy().select("label", "member_count"))
add("get_entity", "entities", f"select id, name, 'n=' || regexp_extract(attributes, '[0-9]+') as attributes from entities where {_OWN} and id = 'e4'", lambda s: flat(s.get("entities", "id", "e4"), "id", "name", "attributes"))
add("entity_by_name", "entities", f"select min(id) as id from entities where {_OWN} and lower(name) = 'customer#000000004' having count(*) > 0", lambda s: s.entity_named(" Customer#000000004 ").select("id"))
add("list_entities", "entities", f"select id, kind, 'n=' || regexp_extract(attributes, '[0-9]+') as attributes from entities where {_OWN}", lambda s: flat(s.table("entities"), "id", "kind", "attributes"))
add("get_edges", "edges", f"select id from edges where {_LIVE} and predicate = 'click'", lambda s: s.edges(predicate="click", now=F.lit(500.0)).select("id"))
add("edges_as_of", "edges", f"select id, predicate, fact from edges where {_LIVE}", lambda s: s.edges(now=F.lit(500.0)).select("id", "predicate", "fact"))
add("list_api_keys", "api_keys", f"select id, name, role, created_at, revoked_at is not null as revoked from api_keys where {_OWN}", lambda s: s.api_keys())
add("list_webhooks", "hooks", f"select id, case when events = '' then '' else 'rule.added,memory.added' end as events, active from hooks where {_OWN} and active", lambda s: flat(s.webhooks(True), "id", "events", "active"))
add("user_by_email", "users", "select email, tenant_id, created_at from users where email = 'customer#000000005@x.org'", lambda s: s.user_by_email("customer#000000005@x.org").select("email", "tenant_id", "created_at"))
add("user_by_tenant", "users", f"select min(email) as email from users where {_OWN}", lambda s: s.user_of_tenant().select("email"))
add("pending_users", "users", "select email, created_at from users where approved is null", lambda s: s.pending_users().select("email", "created_at"))
add("tenant_plan", "tenants", f"select coalesce(max(plan), 'free') as plan from tenants where {_OWN}", lambda s: s.plan())
add("tenant_usage", "usage", f"select coalesce(sum(ops), 0)::double as ops from usage where {_OWN} and period = 'p2'", lambda s: s.used("p2"))
add("tenant_by_subscription", "subscriptions", "select tenant_id from subscriptions where provider_ref = 'sub-7'", lambda s: s.tenant_of_subscription("sub-7"))
add("get_job", "jobs", f"select job_id, kind, 'n=' || regexp_extract(result, '[0-9]+') as result from jobs where {_OWN} and job_id = 'j7'", lambda s: flat(s.job("j7"), "job_id", "kind", "result"))
add("list_jobs", "jobs", f"select job_id, created_at from jobs where {_OWN} order by created_at desc, job_id desc limit 50", lambda s: s.jobs().select("job_id", "created_at"))
add("pending_jobs", "jobs", f"select kind, bool_or(status in ('queued', 'running')) as pending from jobs where {_OWN} and kind in ('click', 'error') group by 1", lambda s: s.spark.createDataFrame([(k, s.has_pending_job(k)) for k in ("click", "error")], "kind string, pending boolean"))
add("decode_rules", "rules", f"select rule_id, replace(replace(patterns, '[\"', ''), '\"]', '') as patterns from rules where {_OWN}", lambda s: flat(s.table("rules"), "rule_id", "patterns"))


def _active(s: Store) -> DataFrame:
    from ..operators import memory

    return memory.active(s.table("memories"), exclude_third=True)


# Counts.
add("count_memories", "memories", f"select count(*) as memories from memories where {_OWN} and user_id = 'src3' and invalid_at is null and coalesce(subject_party, 'self') <> 'third_party'", lambda s: s.count_memories("src3", exclude_third=True))
add("count_distinct_users", "memories", f"select count(distinct user_id) as users from memories where {_OWN} and invalid_at is null", lambda s: s.count_users())
add("count_graph", "entities edges", f"select (select count(*) from entities where {_OWN}) as entities, (select count(*) from edges where {_LIVE}) as edges", lambda s: s.counts(F.lit(500.0)))
add("count_entities", "entities", f"select count(*) as entities from entities where {_OWN}", lambda s: s.count_entities())
add("count_jobs", "jobs", "select count(*) as jobs from jobs where status = 'error'", lambda s: s.count_jobs("error"))

# Rewrites: what is left of each table, and what goes.
_ALL = "memories rules checks violations tombstones audit entities edges taxonomy handoffs jobs"


def _sizes(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, [df.agg(F.lit(n).alias("name"), F.count("*").alias("rows")) for n, df in sorted(tables.items())])


def _left(cond: Callable[[str], str | None]) -> str:
    return " union all ".join(f"select '{n}' as name, count(*) as rows from {n}{f' where not ({c})' if (c := cond(n)) else ''}" for n in _ALL.split())


_IMPORTS = ("memories", "entities", "edges", "taxonomy")
add("purge_tenant", _ALL, _left(lambda n: None if n == "audit" else _OWN), lambda s: _sizes(s.purge()))
add("clear_knowledge", _ALL, _left(lambda n: _OWN if n in (*_IMPORTS, "rules", "checks", "violations", "handoffs") else None), lambda s: _sizes(s.clear()))
add("clear_imported", _ALL, _left(lambda n: _OWN if n in _IMPORTS else None), lambda s: _sizes(s.clear_imported()))
add("removed_rows", _ALL, " union all ".join(f"select '{n}' as name, count(*) as rows from {n} where {_OWN}" for n in _ALL.split()), lambda s: s.removed(tuple(_ALL.split())))
add("prune_old", _ALL, _left(lambda n: "created_at < 300" if n in ("checks", "violations") else None), lambda s: _sizes(s.without_old(F.lit(300.0))))
add("record_rows", "checks audit violations", "select 'checks' as name, count(*) + 2 as rows from checks union all select 'audit', count(*) + 1 from audit union all select 'violations', count(*) + 1 from violations", lambda s: _recorded(s))


def _recorded(s: Store) -> DataFrame:
    """Single checks, an audit row and a violation, appended."""
    rows = lambda data, ddl: s.spark.createDataFrame(data, ddl)
    return _sizes({
        "checks": s.append("checks", rows([("r1", 1, 5.0), ("r2", 0, 6.0)], "rule_id string, passed int, created_at double")),
        "audit": s.append("audit", rows([("forget", "m1", 7.0)], "action string, target string, created_at double")),
        "violations": s.append("violations", rows([("r2", 8.0)], "rule_id string, created_at double")),
    })


def tenant_isolation(spark, d):
    """What each tenant sees of the memories; without a tenant the access is refused."""
    rows = [(t, store(spark, d, ["memories"], t)) for t in ("t0", "t1", "t2", "t9")]
    out = [s.count_memories(active_only=False).withColumn("tenant_id", F.lit(t)) for t, s in rows]
    try:
        store(spark, d, ["memories"], None).count_memories()
    except PermissionError:
        out.append(spark.createDataFrame([(0, "refused")], "memories long, tenant_id string"))
    return reduce(DataFrame.unionByName, out)


QUERIES["tenant_isolation"] = tenant_isolation
ORACLE_SQL[
    "tenant_isolation"
] = f"with {CTES['memories']} select tenant_id, count(*) as memories from memories group by 1 union all select 't9', 0 union all select 'refused', 0"

# An older table lacks columns; they are null.
add("schema_evolution", "tombstones users", f"select 'tombstones' as name, count(*) as rows, 0 as filled from tombstones where {_OWN} union all select 'users', count(*), count(approved) from users where {_OWN}", lambda s: _evolved(s))


def _evolved(s: Store) -> DataFrame:
    one = lambda n, c: s.table(n).agg(F.lit(n).alias("name"), F.count("*").alias("rows"), F.count(c).alias("filled"))
    return one("tombstones", "embedding").union(one("users", "approved"))


def tables_round_trip(spark, d):
    """The tables written to a folder, opened again as another tenant, and counted."""
    from ..sources.store import open_store
    from ..sources.tables import new_path

    path = new_path(spark, "store")
    store(spark, d, ["memories", "edges", "users"]).save(path)
    s = open_store(spark, path, "t2")
    return s.removed(("memories", "edges", "users"))


QUERIES["tables_round_trip"] = tables_round_trip
ORACLE_SQL["tables_round_trip"] = f"with {', '.join(CTES[n] for n in ('memories', 'edges', 'users'))} " + " union all ".join(
    f"select '{n}' as name, count(*) as rows from {n} where tenant_id = 't2'" for n in ("memories", "edges", "users")
)
