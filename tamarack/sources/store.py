"""Named tables of one tenant: schemas, access that fails closed, lookups, retention, hooks and counters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold, listed, path_template

#: Columns of the tables, as DDL. Times are epoch seconds.
SCHEMAS = {
    "tenants": "tenant_id string, name string, key_hash string, plan string, created_at double",
    "api_keys": "tenant_id string, id string, key_hash string, name string, role string, created_at double, revoked_at double",
    "users": "tenant_id string, email string, created_at double, approved int",
    "auth_tokens": "tenant_id string, token_hash string, purpose string, expires_at double, used_at double",
    "subscriptions": "tenant_id string, provider_ref string, created_at double",
    "events_seen": "event_id string, at double",
    "usage": "tenant_id string, period string, ops double",
    "hooks": "tenant_id string, id string, url string, events string, secret string, active boolean",
    "audit": "tenant_id string, action string, target string, detail string, created_at double",
    "rules": "tenant_id string, rule_id string, project string, rule_type string, severity string, message string, rule string, patterns array<string>, status string, version long, updated_at double",
    "rule_history": "tenant_id string, rule_id string, version long, snapshot string, change string, created_at double",
    "corrections": "tenant_id string, id string, raw string, category string, tags array<string>, created_at double",
    "violations": "tenant_id string, rule_id string, bucket string, trace string, evidence string, created_at double",
    "checks": "tenant_id string, rule_id string, passed int, source string, created_at double",
    "memories": "tenant_id string, id string, user_id string, content string, embedding array<double>, salience double, access_count long, last_accessed double, valid_at double, invalid_at double, updated_at double, subject_party string, pii_flags array<string>, term_hashes array<string>, node_id string, source string",
    "tombstones": "tenant_id string, content_hash string, embedding array<double>",
    "entities": "tenant_id string, id string, name string, kind string, attributes map<string,string>, embedding array<double>",
    "edges": "tenant_id string, id string, subject_id string, predicate string, object_id string, object_value string, fact string, embedding array<double>, valid_at double, invalid_at double, created_at double, expired_at double",
    "taxonomy": "tenant_id string, id string, parent_id string, label string, path string, member_count long, active boolean",
    "handoffs": "tenant_id string, session_id string, user_id string, summary string, fact_ids array<string>, metadata map<string,string>, created_at double, updated_at double",
    "jobs": "tenant_id string, job_id string, kind string, payload string, status string, attempts long, result string, error string, created_at double, updated_at double",
}
#: What a tenant knows; of that, what an import of notes writes; what is measured.
IMPORTED = ("memories", "entities", "edges", "taxonomy")
KNOWLEDGE = (*IMPORTED, "rules", "rule_history", "corrections", "violations", "checks", "handoffs")
MEASURED = ("checks", "violations")


def open_store(spark: SparkSession, folder: str, tenant: str | None, form: str = "parquet") -> Store:
    """The tables that lie in a folder, one sub-folder or file each."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = {f.getPath().getName().split(".")[0] for f in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)}
    return Store(spark, {n: spark.read.format(form).schema(SCHEMAS[n]).load(f"{folder}/{n}") for n in sorted(found & set(SCHEMAS))}, tenant)


def decoded(rows: DataFrame, name: str) -> DataFrame:
    """Rows whose lists, maps and vectors are JSON text, as the schema has them: broken JSON gives null, a broken list of strings none."""
    want = {f.name: f.dataType for f in rows.sparkSession.createDataFrame([], SCHEMAS[name]).schema}
    have = dict(rows.dtypes)
    nested = [c for c, t in want.items() if c in have and have[c] == "string" and t.typeName() in ("array", "map")]

    def value(c: str) -> Column:
        got = F.from_json(F.col(c), want[c].simpleString())
        return F.coalesce(got, F.array().cast(want[c])) if want[c].simpleString() == "array<string>" else got

    return rows.withColumns({c: value(c) for c in nested}) if nested else rows


class Store:
    """Tables of one tenant. Without a tenant every access is refused."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], tenant: str | None):
        self.spark, self.tables, self.tenant = spark, tables, tenant

    def table(self, name: str) -> DataFrame:
        """The tenant's rows, with every column of the schema (null where the stored table is older)."""
        if not self.tenant:
            raise PermissionError("no tenant")
        return self.every(name).where(F.col("tenant_id") == self.tenant)

    def every(self, name: str) -> DataFrame:
        """The rows of all tenants, for the service itself."""
        empty = self.spark.createDataFrame([], SCHEMAS[name])
        return empty.unionByName(decoded(self.tables[name], name), allowMissingColumns=True) if name in self.tables else empty

    def save(self, folder: str, form: str = "parquet") -> None:
        for name, df in self.tables.items():
            df.write.mode("overwrite").format(form).save(f"{folder}/{name}")

    def get(self, name: str, column: str, value: str) -> DataFrame:
        return self.table(name).where(F.col(column) == value)

    def newest(self, name: str, most: int, limit: int = 1000, time: str = "created_at", tie: str | None = None) -> DataFrame:
        """The last rows by time (ties: the largest `tie` first), 1 to `most` of them."""
        order = [F.desc(time), *([F.desc(tie)] if tie else [])]
        return self.table(name).orderBy(*order).limit(max(1, min(most, limit)))

    def rule_history(self, rule_id: str, limit: int = 50) -> DataFrame:
        own = self.get("rule_history", "rule_id", rule_id)
        return own.orderBy(F.desc("created_at"), F.desc("version")).limit(max(1, min(500, limit)))

    def admin_log(self, limit: int = 100) -> DataFrame:
        return self.newest("audit", 1000, limit, tie="target")

    def jobs(self, limit: int = 50) -> DataFrame:
        return self.newest("jobs", 200, limit, tie="job_id")

    def has_pending_job(self, kind: str) -> bool:
        waiting = self.get("jobs", "kind", kind).where("status in ('queued', 'running')")
        return waiting.limit(1).count() > 0

    def job(self, job_id: str, result: str = "map<string,string>") -> DataFrame:
        return self.get("jobs", "job_id", job_id).withColumn("result", F.from_json("result", result))

    def handoff(self, session_id: str) -> DataFrame:
        return self.get("handoffs", "session_id", session_id)

    def handoffs(self) -> DataFrame:
        return self.table("handoffs").orderBy(F.desc("updated_at"), "session_id")

    def taxonomy(self) -> DataFrame:
        return self.table("taxonomy").where("active").orderBy(F.desc("member_count"), "label")

    def entity_named(self, name: str) -> DataFrame:
        """The entity of that folded name, the one of the smallest id."""
        return self.table("entities").where(fold(F.col("name")) == fold(F.lit(name))).orderBy("id").limit(1)

    def edges(self, subject_id: str | None = None, predicate: str | None = None, now: Column | None = None) -> DataFrame:
        """Edges of a subject and predicate (None: any), those current at `now` (None: all)."""
        e = self.table("edges")
        for column, value in (("subject_id", subject_id), ("predicate", predicate)):
            e = e if value is None else e.where(F.col(column) == value)
        return e if now is None else current_edges(e, now)

    def api_keys(self) -> DataFrame:
        """Names and roles, without hashes, the newest first."""
        keys = self.table("api_keys").orderBy(F.desc("created_at"), "id")
        return keys.select("id", "name", "role", "created_at", F.col("revoked_at").isNotNull().alias("revoked"))

    def webhooks(self, active_only: bool = False) -> DataFrame:
        """Without secrets; events as a list."""
        h = self.table("hooks").where("active") if active_only else self.table("hooks")
        return h.select("id", "url", listed(F.col("events")).alias("events"), "active")

    def user_by_email(self, email: str) -> DataFrame:
        return self.every("users").where(F.col("email") == email)

    def user_of_tenant(self) -> DataFrame:
        return self.table("users").orderBy("email").limit(1)

    def pending_users(self) -> DataFrame:
        return self.every("users").where("approved is null").orderBy("created_at", "email")

    def plan(self) -> DataFrame:
        """One row, free where the tenant has none."""
        return self.table("tenants").agg(F.coalesce(F.max("plan"), F.lit("free")).alias("plan"))

    def used(self, period: str) -> DataFrame:
        return self.get("usage", "period", period).agg(F.coalesce(F.sum("ops"), F.lit(0.0)).alias("ops"))

    def tenant_of_subscription(self, provider_ref: str) -> DataFrame:
        return self.every("subscriptions").where(F.col("provider_ref") == provider_ref).select("tenant_id")

    def counts(self, now: Column | None = None) -> DataFrame:
        """Entities and edges that are current at `now` (None: without an end)."""
        e = self.table("entities").agg(F.count("*").alias("entities"))
        edges = self.table("edges").where("expired_at is null and invalid_at is null") if now is None else self.edges(now=now)
        return e.crossJoin(edges.agg(F.count("*").alias("edges")))

    def count_memories(self, user_id: str | None = None, active_only: bool = True, exclude_third: bool = False) -> DataFrame:
        m = self.table("memories")
        m = m.where("invalid_at is null") if active_only else m
        m = m if user_id is None else m.where(F.col("user_id") == user_id)
        m = m.where("coalesce(subject_party, 'self') != 'third_party'") if exclude_third else m
        return m.agg(F.count("*").alias("memories"))

    def count_users(self) -> DataFrame:
        return self.table("memories").where("invalid_at is null").agg(F.count_distinct("user_id").alias("users"))

    def count_entities(self) -> DataFrame:
        return self.table("entities").agg(F.count("*").alias("entities"))

    def count_jobs(self, status: str | None = None) -> DataFrame:
        """Of all tenants."""
        j = self.every("jobs")
        return (j if status is None else j.where(F.col("status") == status)).agg(F.count("*").alias("jobs"))

    def append(self, name: str, rows: DataFrame) -> DataFrame:
        """The whole table with the tenant's new rows."""
        self.table(name)
        own = rows.withColumn("tenant_id", F.lit(self.tenant))
        return self.tables[name].unionByName(own, allowMissingColumns=True) if name in self.tables else own

    def without(self, names: tuple[str, ...]) -> dict[str, DataFrame]:
        """All tables without the tenant's rows in those named."""
        self.table("audit")
        return {n: (d.where(~F.col("tenant_id").eqNullSafe(self.tenant)) if n in names else d) for n, d in self.tables.items()}

    def removed(self, names: tuple[str, ...]) -> DataFrame:
        """name, rows: how many of the tenant's rows each table loses."""
        each = [self.table(n).agg(F.lit(n).alias("name"), F.count("*").alias("rows")) for n in names]
        return reduce(DataFrame.union, each)

    def clear(self) -> dict[str, DataFrame]:
        """Without the tenant's knowledge; tombstones, keys and what is billed stay."""
        return self.without(KNOWLEDGE)

    def clear_imported(self) -> dict[str, DataFrame]:
        return self.without(IMPORTED)

    def purge(self) -> dict[str, DataFrame]:
        """Without the tenant, but for the audit."""
        return self.without(tuple(n for n in SCHEMAS if n not in ("audit", "events_seen")))

    def without_old(self, before: Column) -> dict[str, DataFrame]:
        """Without checks and violations of any tenant from before that time."""
        return {n: (d.where(F.col("created_at") >= before) if n in MEASURED else d) for n, d in self.tables.items()}


def current_edges(edges: DataFrame, now: Column) -> DataFrame:
    """Not retracted, begun, and not ended at `now`; a null start counts as begun."""
    return edges.where(
        F.col("expired_at").isNull() & (F.coalesce("valid_at", now) <= now) & (
            F.col("invalid_at").isNull() | (F.col("invalid_at") > now)
        )
    )


def create_keys(wanted: DataFrame, now: float) -> DataFrame:
    """wanted: tenant_id, id, name, role. Adds key, drawn at random, to be shown once, and key_hash, which is kept."""
    rows = wanted.withColumn("key", F.concat(F.lit("key_"), F.replace(F.uuid(), F.lit("-"), F.lit("")), F.replace(F.uuid(), F.lit("-"), F.lit(""))))
    return rows.withColumns({"key_hash": F.sha2("key", 256), "created_at": F.lit(now), "revoked_at": F.lit(None).cast("double")})


def resolve_keys(requests: DataFrame, keys: DataFrame, owners: DataFrame) -> DataFrame:
    """requests: key; keys: key_hash, tenant_id, role, revoked_at; owners: key_hash, tenant_id. Tenant and role of each key, an active key first, then a bootstrap key, which owns its tenant."""
    r = requests.withColumn("key_hash", F.sha2(F.col("key"), 256))
    k = keys.where("revoked_at is null").select("key_hash", F.col("tenant_id").alias("_kt"), "role")
    o = owners.select("key_hash", F.col("tenant_id").alias("_ot"))
    out = r.join(k, "key_hash", "left").join(o, "key_hash", "left")
    return out.select(
        "key", F.coalesce("_kt", "_ot").alias("tenant_id"),
        F.when(F.col("_kt").isNotNull(), F.col("role")).when(F.col("_ot").isNotNull(), "owner").alias("role"),
    )


def hooks_for(hooks: DataFrame, event: Column | str) -> DataFrame:
    """Active hooks that take the event; a hook without a list takes all."""
    event = F.lit(event) if isinstance(event, str) else event
    return hooks.where(
        F.col("active") & (
            (
                F.size(F.coalesce("events", F.array().cast("array<string>"))) == 0
            ) | F.array_contains(F.col("events"), event)
        )
    )


def route_counts(requests: DataFrame) -> DataFrame:
    """requests: method, path, status."""
    return requests.groupBy("method", path_template(F.col("path")).alias("route"), "status").agg(F.count("*").alias("requests"))


def prometheus(counts: DataFrame, metric: str = "http_requests_total") -> DataFrame:
    """Lines of the text format, in order of their labels."""
    line = F.format_string(metric + '{method="%s",path="%s",status="%s"} %d', "method", "route", F.col("status").cast("string"), "requests")
    return counts.orderBy("method", "route", "status").select(line.alias("line"))
