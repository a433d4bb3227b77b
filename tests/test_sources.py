import pytest
from pyspark.sql import functions as F

from tamarack.operators import memory
from tamarack.sources import bundles, notes, store
from tamarack.sources.notes import read_notes
from tamarack.streaming.state import consume_stream, rate_limit_stream, usage_by_period


def test_notes(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.md").write_text("see [[b]] and [[b|again]] #tag/x")
    (tmp_path / "c.txt").write_text("no")
    (row,) = read_notes(spark, str(tmp_path)).collect()
    assert (row.title, row.links, row.tags) == ("a", ["b"], ["tag/x"])


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, v string, created int")
    new = spark.createDataFrame([(2, "c", 9), (3, "d", 9)], "id int, v string, created int")
    assert sorted(map(tuple, memory.upsert(old, new, ["id"], ["created"]).collect())) == [(1, "a", 1), (2, "c", 2), (3, "d", 9)]


def test_usage_stream(spark, tmp_path):
    spark.sql("select 1L as user, timestamp'2024-01-01 10:00:00' as ts union all select 1L, timestamp'2024-01-01 11:00:00'").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user long, ts timestamp").parquet(str(tmp_path / "in"))
    q = usage_by_period(stream, "user", "ts").writeStream.outputMode("complete").format("memory").queryName("usage_t").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r.ops for r in spark.sql("select ops from usage_t").collect()] == [2]


def test_front_matter_and_import(spark):
    text = "---\ntags: [x, 'y z']\nkind: doc\nrelated:\n  - 07/Foo\n  - Bar\nkind: last\n# note\n---\nBody [[A note]] #x #é\n"
    raw = spark.createDataFrame([("v/sub/A note.md", text), ("B.md", "Body [[A note]] #x #é"), ("v/C.md", " "), ("D.md", "---\nopen")], "path string, text string")
    n = {r.title: r for r in notes.parse_notes(raw).collect()}
    assert sorted(n) == ["A note", "B", "D"]
    a = n["A note"]
    assert (a.folder, a.content, a.links, a.tags) == ("v/sub", "Body [[A note]] #x #é", ["Foo", "Bar"], ["x", "y z"])
    assert a.props == {"kind": "last", "related": "07/Foo,Bar"} and n["D"].props == {}
    none = spark.createDataFrame([], "content_hash string")
    memories, entities, edges = notes.import_notes(notes.parse_notes(raw), "t", none)
    assert [r.title for r in memories.orderBy("title").collect()] == ["B", "D"]
    assert {r.name for r in entities.collect()} == {"A note", "B", "D", "Foo", "Bar", "x", "y z"}
    assert edges.count() == 6


def test_traps(spark):
    t = "# Case\nInput: say hi\n more\n\nExpected behavior:\npolite\n# aside\nOUTPUT: hello\nInput: again"
    raw = spark.createDataFrame([("x/one.md", t), ("two.md", "Output: only")], "path string, text string")
    assert [tuple(r) for r in notes.parse_traps(raw).collect()] == [("one", "say hi\nmore\nagain", "polite", "", "", "hello")]


def test_bundle(spark, tmp_path):
    ms = "id string, user_id string, content string, embedding array<double>, salience double, invalid_at double"
    rs = "rule_id string, rule_type string, severity string, patterns array<string>, status string, message string"
    schemas = {"tombstones": "content_hash string, embedding array<double>", "memories": ms, "rules": rs, "corrections": "id string, raw string"}
    empty = {n: spark.createDataFrame([], s) for n, s in schemas.items()}
    m = spark.createDataFrame([("a", "u", "token: abc", [1.0], 9.0, None), ("b", "u", "Gone", [2.0], 1.0, None), ("c", "u", " ", None, 1.0, None), ("d", "u", "ended", None, 1.0, 3.0)], ms)
    dead = m.where("id = 'b'").select(memory.content_hash(F.col("content")).alias("content_hash"), F.lit(None).cast("array<double>").alias("embedding"))
    r = spark.createDataFrame([("r", "soft", "low", ["x"], "active", "m")], rs)
    out = bundles.export(m, r, spark.createDataFrame([("k", "pwd=1 x")], "id string, raw string"), dead)
    bundles.write_bundle(out, str(tmp_path / "b"))
    back = bundles.read_bundle(spark, str(tmp_path / "b"), schemas)
    assert bundles.check_size(back) == {"tombstones": 1, "memories": 2, "rules": 1, "corrections": 1}
    with pytest.raises(ValueError):
        bundles.check_size(back, per_table=1)
    got = bundles.load(empty, back)
    assert [(x.id, x.content, x.salience) for x in got["memories"].collect()] == [("a", "[REDACTED_SECRET]", 5.0)]
    assert [(x.rule_id, x.rule_type) for x in got["rules"].collect()] == [("r", "hard")]
    assert [x.raw for x in got["corrections"].collect()] == ["[REDACTED_SECRET] x"] and got["tombstones"].count() == 1
    again = bundles.load({**empty, "tombstones": dead, "memories": m}, {**empty, "corrections": back["corrections"]}, "replace")
    assert again["memories"].count() == 0 and again["tombstones"].count() == 1
    with pytest.raises(ValueError):
        bundles.load(empty, back, "odd")


def test_store(spark):
    e = spark.createDataFrame([("t", "1", None, None), ("u", "2", None, None), ("t", "3", 5.0, None)], "tenant_id string, id string, invalid_at double, expired_at double")
    s = store.Store(spark, {"edges": e}, "t")
    assert [tuple(r) for r in s.counts().collect()] == [(0, 1)]
    assert s.purge()["edges"].count() == 1 and s.get("edges", "id", "2").count() == 0 and s.table("hooks").count() == 0
    assert store.current_edges(s.table("edges"), F.lit(6.0)).count() == 1
    assert s.append("edges", spark.createDataFrame([("9",)], "id string")).where("tenant_id = 't'").count() == 3
    for call in (lambda x: x.table("edges"), lambda x: x.purge(), lambda x: x.append("edges", e)):
        with pytest.raises(PermissionError):
            call(store.Store(spark, {"edges": e}, None))
    q = spark.createDataFrame([("k1",), ("k2",), ("k3",)], "key string")
    h = lambda k: F.sha2(F.lit(k), 256).alias("key_hash")
    keys = spark.range(1).select(h("k1"), F.lit("t").alias("tenant_id"), F.lit("member").alias("role"), F.lit(None).cast("double").alias("revoked_at"))
    owners = spark.range(1).select(h("k2"), F.lit("u").alias("tenant_id"))
    assert {r.key: (r.tenant_id, r.role) for r in store.resolve_keys(q, keys, owners).collect()} == {"k1": ("t", "member"), "k2": ("u", "owner"), "k3": (None, None)}
    hooks = spark.createDataFrame([("a", [], True), ("b", ["x"], True), ("c", ["y"], True), ("d", None, False)], "id string, events array<string>, active boolean")
    assert [r.id for r in store.hooks_for(hooks, "x").orderBy("id").collect()] == ["a", "b"]
    req = spark.createDataFrame([("GET", "/v1/rules/9", 200), ("GET", "/v1/rules/8", 200)], "method string, path string, status int")
    assert [r.line for r in store.prometheus(store.route_counts(req)).collect()] == ['http_requests_total{method="GET",path="/v1/rules/{id}",status="200"} 2']


@pytest.mark.parametrize("kind", ["quota", "rate"])
def test_stateful_streams(spark, tmp_path, kind):
    for i in range(2):  # two files, one micro-batch each
        spark.createDataFrame([("t", "p", 2 * i + j, 2.0, float(i * 10 + j)) for j in range(2)], "tenant_id string, period string, seq int, cost double, at double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("tenant_id string, period string, seq int, cost double, at double").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    out = consume_stream(stream, 5.0) if kind == "quota" else rate_limit_stream(stream, 1, 5.0)
    q = out.writeStream.outputMode("append").format("memory").queryName(f"state_{kind}").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    got = {r.seq: r.accepted for r in spark.sql(f"select * from state_{kind}").collect()}
    assert got == ({0: True, 1: True, 2: False, 3: False} if kind == "quota" else {0: True, 1: False, 2: True, 3: False})
