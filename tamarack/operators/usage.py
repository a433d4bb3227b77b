"""Plans, quotas, invoices, rate limits, subscription events and job queues."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import hmac_sha256
from ..sources.tables import keep, small
from .folds import in_order

#: Plan, operations, memories, price with tax, in rising order.
PLANS = [
    ("free", 2_000, 1_000, 0),
    ("solo", 25_000, 60_000, 349),
    ("starter", 90_000, 225_000, 990),
    ("growth", 300_000, 900_000, 3990),
    ("pro", 800_000, 2_400_000, 12990),
    ("enterprise", None, None, None),
]
#: What an operation costs.
OPERATION_COST = {"memory_add": 1.0, "memory_reinforce": 0.0, "memory_search": 0.2, "check": 1.0, "correct": 5.0, "llm_extract": 40.0, "induce": 0.5}
OVERAGE_PER_1000, TAX = 12.0, 0.20
USD_PER_OPERATION, USD_PER_MEMORY, FEE_SHARE, FEE = 0.000012, 0.0000105, 0.0399, 0.25
ATTEMPTS, LEASE_SECONDS = 5, 300.0


def plans(spark: SparkSession) -> DataFrame:
    """A table of six rows, safe to broadcast, with each plan's successor."""
    rows = [(*p, PLANS[i + 1][0] if i + 1 < len(PLANS) else None) for i, p in enumerate(PLANS)]
    return F.broadcast(spark.createDataFrame(rows, "plan string, ops_limit long, mem_limit long, price long, next_plan string"))


def with_plan(tenants: DataFrame) -> DataFrame:
    """Limits and price of each tenant's plan; missing or unknown plans are free."""
    known = F.when(F.col("plan").isin(*[p[0] for p in PLANS]), F.col("plan")).otherwise("free")
    return tenants.withColumn("plan", known).join(plans(tenants.sparkSession), "plan", "left")


def meter(operations: DataFrame) -> DataFrame:
    """operations: tenant_id, period, op, n. Adds up cost per tenant and period."""
    cost = F.create_map(*[F.lit(x) for kv in OPERATION_COST.items() for x in kv])
    return operations.groupBy("tenant_id", "period").agg(
        F.round(F.sum(F.coalesce(F.try_element_at(cost, F.col("op")), F.lit(1.0)) * F.col("n")), 6).alias("ops")
    )


def invoices(usage: DataFrame) -> DataFrame:
    """usage: tenant_id, period, plan, ops. Net base, overage, tax and total of each."""
    u = with_plan(usage)
    over = F.coalesce(F.greatest(F.lit(0.0), F.col("ops") - F.col("ops_limit")), F.lit(0.0))
    u = u.withColumn("overage", F.round(over / 1000 * OVERAGE_PER_1000, 2)).withColumn("base", F.round(F.coalesce("price", F.lit(0)) / (1 + TAX), 2))
    u = u.withColumn("net", F.round(F.col("base") + F.col("overage"), 2))
    u = u.withColumn("tax", F.round(F.col("net") * TAX, 2))
    return u.select("tenant_id", "period", "plan", "ops", "base", "overage", "net", "tax", F.round(F.col("net") + F.col("tax"), 2).alias("total"))


def breakeven(rows: DataFrame) -> DataFrame:
    """Exchange rate at which a plan that is used in full earns nothing; null for free and unlimited plans."""
    price, ops, mem = F.nullif("price", F.lit(0)), F.col("ops_limit"), F.col("mem_limit")
    return rows.withColumn(
        "breakeven",
        F.round((price / (1 + TAX) - (price * FEE_SHARE + FEE)) / (ops * USD_PER_OPERATION + mem * USD_PER_MEMORY), 1),
    )


def storage(memories: DataFrame, tenants: DataFrame) -> DataFrame:
    used = memories.where("invalid_at is null").groupBy("tenant_id").agg(F.count("*").alias("used"))
    t = with_plan(tenants).join(used, "tenant_id", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    return t.select(
        "tenant_id", "plan", "used", F.col("mem_limit").alias("limit"),
        F.coalesce(F.col("used") < F.col("mem_limit"), F.lit(True)).alias("allowed"),
    )


#: Requests of a tenant and period up to which one task takes them in order.
FOLD_ROWS = 100_000
#: Costs that are multiples of this are summed without rounding, so in any order.
EXACT_UNIT = 2.0**-20


def consume(requests: DataFrame, limit: float | None, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """requests: tenant_id, period, seq, cost (null: free). Accepted while the accepted costs stay within the limit; others don't count.

    Keys of up to `fold_rows` requests are folded in order, many keys a task. Larger ones without negative costs are decided by
    prefix sums over sorted ranges (_in_rounds), spread over all tasks; only where a sum meets the limit so closely that its
    rounding decides are they folded too."""
    if limit is None:
        return requests.withColumn("accepted", F.lit(True))

    def step(row, used):
        total = (used or 0.0) + (row["cost"] or 0.0)
        ok = total <= limit
        return ok, total if ok else used

    name = F.to_json(F.struct("tenant_id", "period"))
    cost = F.coalesce(F.col("cost").cast("double"), F.lit(0.0))
    exact = F.bool_and(cost / EXACT_UNIT == F.floor(cost / EXACT_UNIT)) & (F.sum(cost) < 2.0**32)
    slack = F.when(exact, 0.0).otherwise(F.count("*") * 2.0**-50 * (F.sum(cost) + limit))  # more than sums in another order can differ
    hot = requests.groupBy(name.alias("_key")).agg(F.count("*").alias("_c"), F.min(cost).alias("_least"), F.sum(cost).alias("_sum"), slack.alias("_slack"))
    hot = keep(hot.where((F.col("_c") > fold_rows) & (F.col("_least") >= 0) & (F.col("_sum") < 2.0**62)).select("_key", "_slack"), "hot-keys")
    if not hot.limit(1).count():
        return in_order(requests, ["tenant_id", "period"], ["seq"], step)
    named = requests.withColumn("_key", name)
    many, unsure = _in_rounds(named.join(small(hot), "_key", "left_semi").withColumn("_cost", cost), hot, float(limit))
    few = named.join(small(hot.join(unsure, "_key", "left_anti")), "_key", "left_anti").drop("_key")
    return in_order(few, ["tenant_id", "period"], ["seq"], step).unionByName(many.join(small(unsure), "_key", "left_anti").drop("_key", "_cost"))


def _in_rounds(rows: DataFrame, keys: DataFrame, limit: float) -> tuple[DataFrame, DataFrame]:
    """rows (_key, seq, _cost >= 0) with accepted, and keys for which a sum lies within _slack of the quota, so that only a fold in
    order can tell. What is left of a quota never grows, so a cost above it is rejected for good. Of the others, those whose
    running sum fits are accepted, up to the first that doesn't; that one is rejected in the next round, with all costs as
    high. So there are at most as many rounds as costs, and running sums are taken range by range."""
    ranged = rows.repartitionByRange("_key", "seq").sortWithinPartitions("_key", "seq")
    open_ = keep(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "requests")
    left, done, unsure = keys.withColumn("_left", F.lit(limit)), [], []
    while True:
        left = keep(left, "quota-left")
        tried = open_.join(small(left), "_key")
        able = tried.where("_cost <= _left")
        sums = able.groupBy("_key", "_part").agg(F.sum("_cost").alias("_s"))
        before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        base = keep(sums.select("_key", "_part", F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_base")), "quota-ranges")
        inner = F.sum("_cost").over(Window.partitionBy("_key", "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
        said = keep(able.join(small(base), ["_key", "_part"]).withColumn("_total", F.col("_base") + inner).drop("_base"), "quota-said")
        near = lambda c: (F.col("_slack") > 0) & (F.abs(F.col(c) - F.col("_left")) <= F.col("_slack"))
        unsure += [said.where(near("_total")).select("_key"), tried.where(near("_cost")).select("_key")]
        fits, more = said.where("_total <= _left"), said.where("_total > _left")
        mark = lambda df, ok: df.select(*rows.columns, F.lit(ok).alias("accepted"))
        done += [mark(tried.where("not (_cost <= _left)"), False), mark(fits, True)]
        open_ = keep(more.select(*rows.columns, "_at", "_part"), "requests")
        if not open_.limit(1).count():
            return reduce(DataFrame.unionByName, done), keep(reduce(DataFrame.union, unsure).distinct(), "quota-unsure")
        spent = fits.groupBy("_key").agg(F.sum("_cost").alias("_spent"))
        left = left.join(spent, "_key", "left").select("_key", "_slack", (F.col("_left") - F.coalesce("_spent", F.lit(0.0))).alias("_left"))


def rate_limited(requests: DataFrame, most: int = 120, seconds: float = 60.0) -> DataFrame:
    """requests: tenant_id, at (seconds), seq. Accepted while fewer than `most` were accepted in the last `seconds`; the state is at most `most` times."""
    from collections import deque

    def step(row, recent):
        recent = deque() if recent is None else recent
        while recent and row["at"] - recent[0] >= seconds:
            recent.popleft()
        ok = len(recent) < most
        if ok:
            recent.append(row["at"])
        return ok, recent

    return in_order(requests, ["tenant_id"], ["at", "seq"], step)


def reserved(operations: DataFrame) -> DataFrame:
    """operations: op, n. Adds cost, as consume() takes it; unknown operations cost 1."""
    cost = F.create_map(*[F.lit(x) for kv in OPERATION_COST.items() for x in kv])
    return operations.withColumn("cost", F.coalesce(F.try_element_at(cost, F.col("op")), F.lit(1.0)) * F.greatest(F.lit(1), F.col("n")))


def charge(operations: DataFrame, limit: float | None) -> tuple[DataFrame, DataFrame]:
    """operations: tenant_id, period, seq, op, n. (each with accepted, and what is then used and left of each quota)."""
    done = consume(reserved(operations).select("tenant_id", "period", "seq", "cost"), limit)
    used = done.groupBy("tenant_id", "period").agg(F.round(F.coalesce(F.sum(F.when(F.col("accepted"), F.col("cost"))), F.lit(0.0)), 6).alias("used"))
    left = F.greatest(F.lit(0.0), F.lit(limit) - F.col("used")) if limit is not None else F.lit(None).cast("double")
    return done, used.withColumn("remaining", left).withColumn("allowed", F.coalesce(F.col("used") < F.lit(limit).cast("double"), F.lit(True)))


def upgrade_hint(tenants: DataFrame) -> DataFrame:
    """Each tenant's next plan (null after the last), and what an overage costs."""
    return with_plan(tenants).withColumn("overage_per_1000", F.lit(OVERAGE_PER_1000))


def period(at: Column) -> Column:
    """The month of an epoch time in UTC, as 2024-01."""
    return F.date_format(F.to_utc_timestamp(F.timestamp_seconds(at), F.current_timezone()), "yyyy-MM")


def consume_tokens(tokens: DataFrame, uses: DataFrame, now: float) -> tuple[DataFrame, DataFrame]:
    """tokens: token_hash, tenant_id, purpose, expires_at, used_at; uses: key (their order), token_hash, purpose. (tokens, those
    used now marked; key and tenant_id of the uses that hold: the first of an unused token that fits and has not expired)."""
    fit = uses.join(
        tokens.where(
            F.col("used_at").isNull() & (F.col("expires_at") > now)
        ).select("token_hash", "purpose", "tenant_id"),
        ["token_hash", "purpose"],
    )
    first = fit.groupBy("token_hash").agg(F.min("key").alias("key"), F.min_by("tenant_id", "key").alias("tenant_id"))
    spent = first.select("token_hash", F.lit(True).alias("_hit"))
    left = tokens.join(spent, "token_hash", "left").withColumn("used_at", F.when(F.col("_hit"), F.lit(now)).otherwise(F.col("used_at"))).drop("_hit")
    return left, first.select("key", "tenant_id")


#: Seconds that a signature holds.
MOST_SKEW = 300


def verify(deliveries: DataFrame, secret: str, now: float) -> DataFrame:
    """deliveries: body, signature, timestamp. Adds valid: HMAC-SHA256 of timestamp.body under the secret, not older or newer than
    MOST_SKEW; without a secret or a whole timestamp none is."""
    at = F.col("timestamp").try_cast("long")
    mac = hmac_sha256(secret or "-", F.concat(at.cast("string"), F.lit("."), F.coalesce("body", F.lit(""))))
    fresh = F.abs(F.lit(now) - at) <= MOST_SKEW
    return deliveries.withColumn("valid", F.coalesce(F.lit(bool(secret)) & fresh & (mac == F.col("signature")), F.lit(False)))


def first_deliveries(events: DataFrame) -> DataFrame:
    """Each event id once, the earliest; events without an id all stay."""
    w = Window.partitionBy("event_id").orderBy("at")
    named = events.where("event_id != ''").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return named.unionByName(events.where("event_id is null or event_id = ''"))


def plan_changes(events: DataFrame, links: DataFrame) -> DataFrame:
    """events: event_id, at, kind (created, updated, canceled), subscription, plan; links: subscription, tenant_id. The last plan of each mapped tenant."""
    e = first_deliveries(events).join(links, "subscription")
    plan = F.when(F.col("kind") == "canceled", "free").otherwise(F.col("plan"))
    return e.groupBy("tenant_id").agg(F.max_by(plan, F.struct("at", "event_id")).alias("plan"))


def enqueue(jobs: DataFrame, new: DataFrame, now: float) -> DataFrame:
    """jobs with new ones (job_id, tenant_id, kind, payload), queued."""
    rows = new.withColumns({"status": F.lit("queued"), "attempts": F.lit(0).cast("long"), "created_at": F.lit(now), "updated_at": F.lit(now)})
    return jobs.unionByName(rows, allowMissingColumns=True)


def process(jobs: DataFrame, handlers: dict[str, Callable[[DataFrame], DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Claimed jobs (job_id, tenant_id, kind, payload, attempts). A handler takes its kind's jobs and gives job_id, result, added
    and error (null: done). (results for complete(), operations to meter: one addition was paid for when the job was queued)."""
    none = jobs.limit(0).select("job_id", F.lit("").alias("result"), F.lit(0).cast("long").alias("added"), F.lit("").alias("error"))
    done = [h(jobs.where(F.col("kind") == k)).select(*none.columns) for k, h in handlers.items()]
    unknown = jobs.where(~F.col("kind").isin(*handlers)).select(
        "job_id", F.lit(None).cast("string").alias("result"), F.lit(0).cast("long").alias("added"),
        F.concat(F.lit("unknown kind: "), F.col("kind")).alias("error"),
    )
    results = reduce(DataFrame.unionByName, [*done, unknown], none)
    extra = results.where("error is null and added > 1").join(jobs.select("job_id", "tenant_id"), "job_id")
    return results, extra.select("tenant_id", F.lit("memory_add").alias("op"), (F.col("added") - 1).alias("n"))


def claim(jobs: DataFrame, key: str | None = None) -> DataFrame:
    """The oldest queued job (of each key value, if one is given), running, with one more attempt."""
    queued = jobs.where("status = 'queued'")
    first = (queued.groupBy(key) if key else queued.groupBy()).agg(
        F.min_by(F.struct(*jobs.columns), F.struct("created_at", "job_id")).alias("j")
    ).where("j is not null").select("j.*")
    return first.withColumn("status", F.lit("running")).withColumn("attempts", F.col("attempts") + 1)


def after_failure(attempts: Column) -> Column:
    return F.when(attempts < ATTEMPTS, "queued").otherwise("error")


def reclaim(jobs: DataFrame, now: Column) -> DataFrame:
    """Running jobs past their lease are queued again, or failed after the last attempt."""
    stale = (F.col("status") == "running") & (F.col("updated_at") < now - LEASE_SECONDS)
    return jobs.withColumn("status", F.when(stale, after_failure(F.col("attempts"))).otherwise(F.col("status")))


def complete(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """results: job_id, result, error. A null error ends the job; else it is tried again or fails. Messages keep 500 characters."""
    r = results.select("job_id", "result", F.substring("error", 1, 500).alias("error"), F.lit(True).alias("_done"))
    status = F.when(
        F.col("_done") & F.col("error").isNull(), "done",
    ).when(F.col("_done"), after_failure(F.col("attempts"))).otherwise(F.col("status"))
    return jobs.join(r, "job_id", "left").withColumn("status", status).drop("_done")
