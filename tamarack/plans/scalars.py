"""Registered queries of scalar operators over the driver's columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import model, pii, text
from ..operators import graph, packs, retrieval, taxonomy, usage
from ..sources import bundles, notes
from ..sources.tables import spread
from .catalog import _t, query
from .extended import _ROOTS, _SCRUBBED

_KEY = "blind-key"
_PADS = {x: bytes(b ^ x for b in _KEY.encode().ljust(64, b"\0")).hex() for x in (0x36, 0x5C)}


def _blind(term: str) -> str:
    return f"substr(sha256(unhex('{_PADS[0x5C]}') || unhex(sha256(unhex('{_PADS[0x36]}') || encode({term})))), 1, 16)"


@query("""with c as (select c_custkey as id, case c_custkey % 5 when 0 then ' None ' when 1 then 'YOK' when 2 then '  ' || c_mktsegment || ' ' when 3 then '' else c_name end as p from customer)
select id, case when lower(trim(p)) in ('none', 'yok', '') then null else trim(p) end as project from c""")
def clean_projects(spark, d):
    k = F.col("c_custkey")
    raw = F.when(k % 5 == 0, " None ").when(k % 5 == 1, "YOK").when(
        k % 5 == 2, F.concat(F.lit("  "), "c_mktsegment", F.lit(" ")),
    ).when(k % 5 == 3, "").otherwise(F.col("c_name"))
    return _t(spark, d, "customer").select(k.alias("id"), text.clean_project(raw).alias("project"))


@query("select p_partkey as id, case when length(p_brand) >= 5 then regexp_replace(p_brand, '([^A-Za-z0-9_])', '\\\\\\1', 'g') || '|' else '' end || 'a\\ ' || p_size as terms from part".replace("\\\\\\1", "\\\\\\1"))
def clean_terms(spark, d):
    terms = F.array(F.col("p_brand"), F.lit("abc"), F.concat(F.lit(" a "), "p_size", F.lit(" ")))
    return _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(text.clean_terms(terms), "|").alias("terms"))


@query("select p_partkey as id, case p_size % 3 when 0 then lower(case p_size % 4 when 0 then 'LOW' when 1 then 'Medium' when 2 then 'high' else 'critical' end) else 'high' end as severity from part")
def clean_severities(spark, d):
    s = F.element_at(F.array(*[F.lit(x) for x in ("LOW", " Medium ", "high", "critical")]), F.col("p_size") % 4 + 1)
    return _t(spark, d, "part").select(
        F.col("p_partkey").alias("id"),
        text.severity(
            F.when(F.col("p_size") % 3 == 0, s).when(F.col("p_size") % 3 == 1, "urgent"), "high",
        ).alias("severity"),
    )


@query("select event_id as id, case event_id % 5 when 0 then 1 when 1 then 1 when 2 then 1 when 3 then least(5, greatest(0, value - 40)) else 0 end::double as salience from events")
def safe_saliences(spark, d):
    k = F.col("event_id") % 5
    raw = F.when(k == 0, "NaN").when(k == 1, "much").when(k == 2, "Infinity").when(k == 3, (F.col("value") - 40).cast("string")).otherwise("-3")
    return _t(spark, d, "events").select(F.col("event_id").alias("id"), text.safe_salience(raw).alias("salience"))


@query("select vec_id as id, case when vec_id % 4 = 0 then 64 end::int as n from embeddings")
def safe_embeddings(spark, d):
    v = F.col("embedding").cast("array<double>")
    k = F.col("vec_id") % 4
    raw = F.when(k == 0, v).when(
        k == 1, F.concat(v, F.array(F.lit(float("nan")))),
    ).when(k == 2, F.concat(v, F.array(F.lit(float("inf"))))).otherwise(F.array().cast("array<double>"))
    return _t(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), F.size(text.safe_embedding(raw)).alias("n"),
    ).withColumn("n", F.when(F.col("n") >= 0, F.col("n")))


@query("select event_id as id, case event_id % 3 when 0 then event_type when 1 then null else 'x' end as a from events")
def json_blocks(spark, d):
    """The object in a fenced reply, in none, and in plain words."""
    k = F.col("event_id") % 3
    raw = F.when(k == 0, F.concat(F.lit("```json\n{\"a\": \""), "event_type", F.lit("\"}\n```"))).when(k == 1, "nothing").otherwise('so: {"a": "x"}.')
    return _t(spark, d, "events").select(F.col("event_id").alias("id"), text.first_json(raw, "a string")["a"].alias("a"))


@query("select p_partkey as id, p_size % 4 in (0, 1) as personal from part")
def personal_hints(spark, d):
    """Corrections about personal data, by their words or their tags."""
    from ..operators import rules

    s = F.col("p_size") % 4
    c = _t(spark, d, "part").select(
        F.col("p_partkey").alias("id"),
        F.when(s == 0, "hide the IBAN").otherwise(F.col("p_name")).alias("reusable_rule"),
        F.lit("").alias("what_was_wrong"), F.lit(None).cast("string").alias("correct_behavior"),
        F.array(F.when(s == 1, "pii").otherwise("piision")).alias("tags"), F.lit("low").alias("severity"),
        F.array().cast("array<string>").alias("forbid_terms"),
    )
    return rules.compile_corrections(c).select("id", (F.col("rule_type") == "hard").alias("personal"))


@query(f"select doc_id as id, case when len({_ROOTS}) > 0 then sha1(array_to_string(list_sort(list_transform({_ROOTS}, lambda t: {_blind('t')})), ',')) end as hashes from documents")
def blind_terms(spark, d):
    t = _t(spark, d, "documents")
    hashes = retrieval.blind_roots(_KEY)(F.col("text"))
    return t.select(F.col("doc_id").alias("id"), F.when(F.size(hashes) > 0, F.sha1(F.array_join(F.array_sort(hashes), ","))).alias("hashes"))


@query("select item_id as id, item_id % 3 = 0 as kept, text is not null as filled from benchmark")
def term_backfill(spark, d):
    """Rows that have hashes keep them, the others get theirs."""
    b = _t(spark, d, "benchmark").withColumn("term_hashes", F.when(F.col("item_id") % 3 == 0, F.array(F.lit("old"))))
    out = retrieval.backfill(b, "text", _KEY)
    return out.select(F.col("item_id").alias("id"), F.array_contains("term_hashes", "old").alias("kept"), (F.size("term_hashes") > 0).alias("filled"))


@query(f"""with q as (select item_id as query_id, unnest({_ROOTS}) as root from benchmark), w as (select doc_id as id, unnest({_ROOTS}) as root from documents),
s as (select query_id, id, count(*) as overlap from q join w using (root) group by 1, 2), r as (select *, row_number() over (partition by query_id order by overlap desc, id) as rank from s)
select query_id, id, overlap, cast(rank as int) as rank from r where rank <= 5""")
def blind_candidates(spark, d):
    """The candidates of lexical_candidates, found without a root in sight."""
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.lit(None).cast("array<string>").alias("term_hashes"))
    queries = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.lexical_candidates(retrieval.backfill(docs, "text", _KEY), queries, 5, index=retrieval.blind_roots(_KEY))


@query("select doc_id as id, sha1(text) as opened, true as sealed, sha1(text) as plain from documents")
def sealed_round_trip(spark, d):
    """Texts sealed and opened; without a key they stay plain; another key leaves them sealed."""
    t = F.col("text")
    rows = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), t, text.encrypt(t, _KEY).alias("s"))
    return rows.select(
        "id", F.sha1(text.decrypt(F.col("s"), _KEY)).alias("opened"),
        (F.col("s").startswith(text.SEALED) & (text.decrypt(F.col("s"), "other") == F.col("s"))).alias("sealed"),
        F.sha1(text.encrypt(t, None)).alias("plain"),
    )


@query(f"select doc_id as id, sha1({_SCRUBBED}) as a, sha1({_SCRUBBED}) as b, sha1({_SCRUBBED}) as c, n_chars as n from documents")
def nested_scrub(spark, d):
    """A text in a list of structs, as a map's value, and in a list of lists."""
    t = F.col("text")
    rows = _t(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.array(F.struct(t.alias("x"), F.lit(1).alias("y"))).alias("a"),
        F.create_map(F.lit("k"), F.array(t)).alias("b"), F.array(F.array(t)).alias("c"), F.struct("n_chars").alias("n"),
    )
    out = bundles.scrubbed(rows)
    return out.select(
        "id", F.sha1(F.col("a")[0]["x"]).alias("a"), F.sha1(F.col("b")["k"][0]).alias("b"),
        F.sha1(F.col("c")[0][0]).alias("c"), F.col("n.n_chars").alias("n"),
    )


@query("select event_id as id, strftime(make_timestamp((1704067200 + event_id * 5000) * 1000000), '%Y-%m') as period from events")
def usage_periods(spark, d):
    return _t(spark, d, "events").select(F.col("event_id").alias("id"), usage.period(F.lit(1704067200) + F.col("event_id") * 5000).alias("period"))


@query("""select event_id as id, 'edg-' || substr(sha1('t1|e' || user_id || '|last_action|lit:' || event_type || '|' || (1700000000 + event_id)::varchar || case event_id % 4 when 0 then '.0' when 1 then '.25' when 2 then '.5' else '.75' end), 1, 16) as edge_id from events""")
def edge_ids(spark, d):
    at = F.lit(1700000000.0) + F.col("event_id") + (F.col("event_id") % 4) / 4
    subject, target = F.concat(F.lit("e"), "user_id"), F.concat(F.lit("lit:"), text.fold(F.upper("event_type")))
    return _t(spark, d, "events").select(
        F.col("event_id").alias("id"),
        graph.edge_id(F.lit("t1"), subject, F.lit("last_action"), target, at).alias("edge_id"),
    )


@query("select c_custkey as id, 'ent-' || substr(sha1('t1|' || lower(c_name)), 1, 16) as entity_id from customer")
def entity_ids(spark, d):
    return _t(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), graph.entity_id(F.lit("t1"), F.concat(F.lit(" "), "c_name")).alias("entity_id"),
    )


@query("select p_partkey as id, regexp_replace(lower(p_type), '\\s+', '_', 'g') as predicate from part")
def predicate_names(spark, d):
    return _t(spark, d, "part").select(
        F.col("p_partkey").alias("id"),
        text.predicate_name(F.concat(F.lit(" _"), F.upper("p_type"), F.lit(" "))).alias("predicate"),
    )


@query("select n_nationkey as id, 'tax-' || substr(sha1('t1|' || lower(n_name)), 1, 12) as node_id from nation")
def taxonomy_ids(spark, d):
    return _t(spark, d, "nation").select(
        F.col("n_nationkey").alias("id"),
        taxonomy.node_id("t1", F.concat(F.col("n_name"), F.lit(" "))).alias("node_id"),
    )


@query("select p_partkey as rule_id, greatest(1, length(p_name || ' ' || p_type || ' ' || p_brand || ' x ' || p_brand) // 4) + 6 as cost from part")
def rule_costs(spark, d):
    p = _t(spark, d, "part").select(
        F.col("p_partkey").alias("rule_id"), F.col("p_name").alias("message"), F.col("p_type").alias("rule"),
        F.array(F.col("p_brand"), F.lit("x")).alias("forbid"), F.array("p_brand").alias("require"),
    )
    return p.select("rule_id", packs.rule_tokens(p).alias("cost"))


_BUCKET = "(('0x' || substr(md5(t), 1, 4))::int % 16)"
_TOKENS = f"list_transform(list_filter(regexp_extract_all(substr({_SCRUBBED}, 1, 8000), '[\\p{{L}}\\p{{N}}_]+'), lambda t: length(t) > 2), lambda t: lower(trim(translate(t, 'İIı', 'iii'))))"


@query(f"""with c as (select doc_id as id, unnest({_TOKENS}) as t from documents), b as (select id, {_BUCKET} as b, sum(case when substr(md5(t), 5, 1) < '8' then 1 else -1 end) as v from c group by 1, 2),
v as (select id, unnest(range(0, 16)) as b from (select distinct id from c)), j as (select v.id, v.b, coalesce(b.v, 0) as v from v left join b using (id, b)),
s as (select id, string_agg(v::varchar, ',' order by b) as v from j group by 1)
select doc_id as id, s.v as embedding from documents left join s on id = doc_id""")
def embed_texts(spark, d):
    rows = model.embed(_t(spark, d, "documents"), "text")
    return rows.select(
        F.col("doc_id").alias("id"),
        F.array_join(F.transform("embedding", lambda x: x.cast("long").cast("string")), ",").alias("embedding"),
    )


@query("select item_id as id, case when item_id % 4 <> 0 then length(text)::double end as e from benchmark")
def embed_batches(spark, d):
    """A provider that gives a text's length; blank texts are not sent."""
    b = _t(spark, d, "benchmark").withColumn("text", F.when(F.col("item_id") % 4 != 0, F.col("text")).otherwise("  "))
    rows = model.embed(b, "text", lambda texts: [[float(len(t))] for t in texts])
    return rows.select(F.col("item_id").alias("id"), F.get("embedding", 0).alias("e"))


@query("select vec_id as id, array_to_string(list_transform(embedding[1:8], lambda x: case when x > 0 then '1' else '0' end), '') as bucket from embeddings")
def vector_buckets(spark, d):
    return retrieval.vector_index(_t(spark, d, "embeddings").withColumnRenamed("vec_id", "id"))


@query("select event_id as id, case event_id % 5 when 0 then 'card' when 1 then 'id' when 2 then 'iban' when 3 then 'phone' else '' end as found from events")
def forbidden_formats(spark, d):
    """The canonical patterns of personal data, in this order."""
    k = F.col("event_id") % 5
    said = F.when(k == 0, "pay 4111 1111 1111 1111 now").when(k == 1, "id 12345678901.").when(
        k == 2, "to TR12 3456 7890 1234 5678 9012 34",
    ).when(k == 3, "call 0532 123 45 67").otherwise("nothing 123")
    found = [F.when(said.rlike(p), n) for n, p in zip(("iban", "card", "phone", "id"), (pii.IBAN, pii.CARD, pii.PHONE, pii.NATIONAL_ID), strict=True)]
    return _t(spark, d, "events").select(F.col("event_id").alias("id"), F.coalesce(*found, F.lit("")).alias("found"))


@query("select c_custkey as id, case c_custkey % 4 when 0 then 'true' when 1 then '2.5' when 2 then 'a,b' else substr(repeat(c_name || ' ', 20), 1, 200) end as v from customer")
def front_matter_values(spark, d):
    """YAML scalars and lists, cut to their sizes."""
    k = F.col("c_custkey") % 4
    value = F.when(k == 0, "yes").when(k == 1, "2.5").when(k == 2, "\n  - a\n  - 'b'").otherwise(
        F.concat(F.lit("'"), F.repeat(F.concat("c_name", F.lit(" ")), 20), F.lit("'"))
    )
    block = F.concat(F.lit("---\nkey: "), value, F.lit("\nother: {x: 1}\n---\nbody"))
    c = spread(_t(spark, d, "customer").select("c_custkey", "c_name"), f"{d}/customer.parquet")
    return c.select(F.col("c_custkey").alias("id"), notes.front_matter(block)["key"].alias("v"))


@query("select event_id as id, '{\"event\": \"[REDACTED_SECRET]\", \"n\": ' || event_id || ', \"t\": \"a\\\\\"b\"}' as body from events")
def json_scrub(spark, d):
    raw = F.concat(
        F.lit('{"event": "AKIA'), F.lpad(F.col("event_id").cast("string"), 16, "0"), F.lit('", "n": '), "event_id",
        F.lit(', "t": "a\\\\"b"}'),
    )
    return _t(spark, d, "events").select(F.col("event_id").alias("id"), text.scrub_json(raw).alias("body"))
