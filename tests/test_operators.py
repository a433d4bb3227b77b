"""Operators without SQL against brute force, and scalars on small rows."""

import hashlib
import json
import hmac
import zlib
from collections import defaultdict, deque

from pyspark.sql import functions as F

from tamarack.functions import pii, text
from tamarack.operators import enforcement, graph, memory, packs, retrieval, rules, usage


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def test_scalars(spark):
    c = F.col("s")
    assert one(spark, text.hmac_sha256("k" * 70, c), s="mesaj ı") == hmac.new(b"k" * 70, "mesaj ı".encode(), hashlib.sha256).hexdigest()
    assert one(spark, text.fold(c), s=" İIıA ") == "iiia"
    assert one(spark, text.predicate_name(c), s=" Works  At ") == "works_at"
    assert one(spark, text.scrub(c), s="x token: abc y") == "x [REDACTED_SECRET] y"
    assert one(spark, text.lexical_roots(c), s="The theory of the cats") == ["the", "theo", "cats"]
    assert one(spark, text.path_template(c), s="/v1/rules/abc") == "/v1/rules/{id}"
    assert one(spark, text.clean_terms(F.array(c, F.lit(" a b0"), F.lit("abc"))), s="a.bcd") == [r"a\.bcd", r"a\ b0"]
    assert [one(spark, text.safe_salience(c), s=s) for s in ("7", "-1", "x", "NaN", "2.5")] == [5.0, 0.0, 1.0, 1.0, 2.5]
    assert one(spark, text.clean_project(c), s=" Null ") is None
    assert one(spark, text.first_json(c, "a int").getField("a"), s="```json\n{\"a\": 3}\n```") == 3
    assert one(spark, text.severity(c, "high"), s="odd") == "high"


def test_personal_data(spark):
    rows = ["call 0532 123 45 67", "numaram 0532 123 45 67", "eşimin numarası 0532 123 45 67", "id 10000000146", "id 10000000147", "TR33 0006 1005 1978 6457 8413 26", "a@b.com", "müşteri a@b.com", "nothing", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").select("i", pii.detect(F.col("t")).alias("k"), pii.subject_party(F.col("t")).alias("p")).orderBy("i").collect()
    assert [r.k for r in got] == [["telefon"]] * 3 + [["tckn"], [], ["iban"], ["email"], ["email"], [], []]
    assert [r.p for r in got] == ["third_party", "self", "third_party", "third_party", "self", "third_party", "self", "third_party", "self", "self"]


def test_consume_and_rate(spark):
    rows = [(f"t{i % 3}", "p", i, float(zlib.crc32(b"%d" % i) % 7), float(i * 7 % 400)) for i in range(300)]
    df = spark.createDataFrame(rows, "tenant_id string, period string, seq int, cost double, at double").repartition(5)
    used, want = defaultdict(float), {}
    for t, _, i, cost, _ in rows:
        want[i] = used[t] + cost <= 50
        used[t] += cost * want[i]
    assert {r.seq: r.accepted for r in usage.consume(df, 50.0).collect()} == want
    recent, want = defaultdict(deque), {}
    for t, _, i, _, at in sorted(rows, key=lambda r: (r[4], r[2])):
        while recent[t] and at - recent[t][0] >= 60:
            recent[t].popleft()
        want[i] = len(recent[t]) < 4
        if want[i]:
            recent[t].append(at)
    assert {r.seq: r.accepted for r in usage.rate_limited(df.drop("period", "cost"), 4, 60.0).collect()} == want
    assert usage.consume(df.limit(0), 1.0).count() == 0


def test_ingest_and_forget(spark):
    m = spark.createDataFrame([(1, "u", "A b", [1.0, 0.0], None, None, 4.8, 0.0), (2, "u", "old", None, 5.0, None, 1.0, 0.0), (3, "v", "c", None, None, "third_party", 1.0, 0.0)], "id int, user_id string, content string, embedding array<double>, invalid_at double, subject_party string, salience double, updated_at double")
    facts = spark.createDataFrame([(1, "u", " a  B", [0.0, 1.0]), (2, "u", "new", [0.0, 1.0]), (3, "u", "NEW", [0.0, 1.0]), (4, "u", "near", [1.0, 0.01]), (5, "u", "plain", None), (6, "u", " ", [0.0, 1.0]), (7, "u", "dead", [0.0, 1.0])], "key int, user_id string, content string, embedding array<double>")
    dead = spark.createDataFrame([(hashlib.sha1(b"dead").hexdigest(), None), ("x", [1.0, 0.0])], "content_hash string, embedding array<double>")
    got = {r.key: r.outcome for r in memory.ingest(m, facts, dead).collect()}
    close = facts.where("key = 4")
    assert [tuple(r) for r in memory.ingest(m, close, dead.where("content_hash is null")).collect()] == [(4, "reinforced", "1")]
    assert got == {1: "reinforced", 2: "added", 3: "reinforced", 4: "blocked", 5: "blocked", 6: "skipped", 7: "blocked"}
    left, stones = memory.forget(m, spark.createDataFrame([(1,), (2,)], "id int"), F.lit(9.0))
    assert {(r.id, r.content, r.invalid_at) for r in left.collect()} == {(1, "", 9.0), (2, "old", 5.0), (3, "c", None)}
    assert stones.count() == 1
    up = memory.reinforce(m, spark.createDataFrame([(1,), (3,), (3,)], "id int"), F.lit(9.0))
    assert {r.id: r.salience for r in up.collect()} == {1: 5.0, 2: 1.0, 3: 2.0}
    assert [r.id for r in memory.of_subject(m, "self").collect()] == [1]


def test_rules_and_graph(spark):
    w = spark.createDataFrame([("r", "soft", "LOW", [], "active", "a", 1), ("r", "soft", "odd", ["x"], "disabled", "b", 2), ("r", "soft", "medium", ["y", "x"], "active", "c", 3)], "rule_id string, rule_type string, severity string, patterns array<string>, status string, message string, at int")
    (r,) = rules.merge_writes(w, F.col("at")).collect()
    assert (r.rule_type, r.severity, r.patterns, r.status, r.message, r.version) == ("hard", "high", ["x", "y"], "disabled", "c", 3)
    e = spark.createDataFrame([(1, None, None), (2, 3.0, None), (3, 9.0, None), (4, None, 1.0)], "edge_id int, invalid_at double, expired_at double")
    b = spark.createDataFrame([(i, 5.0) for i in range(1, 5)], "edge_id int, at double")
    assert {x.edge_id: x.invalid_at for x in graph.bound(e, b).collect()} == {1: 5.0, 2: 3.0, 3: 5.0, 4: None}
    c = spark.createDataFrame([("never show a TCKN", "", "", None, [], ["x"]), ("be kind", "", "", "LOW", [], ["two words"])], "reusable_rule string, what_was_wrong string, correct_behavior string, severity string, tags array<string>, forbid_terms array<string>")
    assert [(x.rule_type, x.severity, len(x.forbid)) for x in rules.compile_corrections(c).collect()] == [("hard", "high", 4), ("soft", "low", 1)]


def test_enforcement(spark):
    R = enforcement.PolicyRule
    texts = spark.createDataFrame([(1, "a DIL b"), (2, "clean"), (3, None)], "id int, text string")
    allowed = lambda rules, **k: {r.id: r.allow for r in enforcement.enforce(texts, rules, **k).collect()}
    assert allowed([R("r", "hard", "low", forbid=("dil",))]) == {1: False, 2: True, 3: False}
    assert allowed([R("r", "hard", "high", forbid=("(a+)+",))]) == {1: False, 2: False, 3: False}
    assert allowed([R("r", "hard", "low", forbid=("(a+)+",))]) == {1: True, 2: True, 3: False}
    assert allowed([R("r", "hard", "high", forbid=("(a+)+",))], fail_open=True) == {1: True, 2: True, 3: False}
    assert allowed([R("r", "soft", "high")], run_soft=False)[2] is False and allowed([R("r", "soft", "low")], run_soft=False)[2] is True
    must = [R(f"m{i}", "soft", "high") for i in range(3)] + [R("low", "soft", "low", "zebra")]
    (r,) = enforcement.enforce(texts.where("id = 2"), must, lambda t, rule: F.lit(False), max_blocking=2).collect()
    assert [(u.rule_id, u.reason) for u in r.unevaluated] == [("m2", "blocking_budget_exceeded")] and not r.allow and not r.deferred
    (r,) = enforcement.enforce(texts.where("id = 2"), must, lambda t, rule: F.lit(False), max_soft=3).collect()
    assert r.deferred == ["low"] and r.allow and r.checked == 3
    (r,) = enforcement.enforce(texts.where("id = 2"), [], None).collect()
    assert r.allow and r.checked == 0
    checks, found = enforcement.check_rows(enforcement.enforce(texts, [R("r", "hard", "low", forbid=("dil",))]))
    assert checks.count() == 3 and [x.evidence for x in found.collect()] == ["DIL"]
    votes = spark.createDataFrame([(1, "r", True), (1, "r", False), (2, "r", False)], "id int, rule_id string, violated boolean")
    assert {x.id: x.violated for x in enforcement.panel(votes).collect()} == {1: True, 2: False}


def test_prefix_bm25(spark):
    c = spark.createDataFrame([(1, 1, "raporlar hazır"), (1, 2, "başka bir şey"), (1, 3, None), (2, 1, "x")], "query_id int, id int, text string")
    q = spark.createDataFrame([(1, "rapor"), (2, "")], "query_id int, text string")
    docs = c.select("id", "text").dropDuplicates(["id"]).where("id != 1").union(spark.createDataFrame([(1, "raporlar hazır")], "id int, text string"))
    got = {(r.query_id, r.id): r.score for r in retrieval.bm25_candidates(c.select("query_id", "id"), docs, q).collect()}
    assert got[1, 1] > 0 and [got[k] for k in ((1, 2), (1, 3), (2, 1))] == [0, 0, 0]


def test_edge_search_names_anchors(spark):
    e = spark.createDataFrame([(1, 10, 11, "works at acme", [1.0, 0.0]), (2, 12, 11, "lives there", None)], "id int, subject_id int, object_id int, fact string, embedding array<double>")
    n = spark.createDataFrame([(10, "Ada", None), (11, "acme", [0.0, 1.0]), (12, "", None)], "id int, name string, embedding array<double>")
    q = spark.createDataFrame([(1, "Where does ADA work", [1.0, 0.1])], "query_id int, text string, query_vec array<double>")
    assert {tuple(r) for r in graph.anchors(q, n).collect()} == {(1, 10)}
    assert [(r.id, r.anchored, r.rank) for r in graph.search_edges(e, n, q, 5).orderBy("rank").collect()] == [(1, True, 1), (2, False, 2)]


def test_packs(spark):
    r = spark.createDataFrame([(f"r{i}", None, "soft", "high" if i == 2 else "low", "m" * 40, "", ["p"], [], "active") for i in range(4)], "rule_id string, project string, rule_type string, severity string, message string, rule string, forbid array<string>, require array<string>, status string")
    m = spark.createDataFrame([("u", 1, "a" * 400, 1.0, 1.0, None, None, "s"), ("u", 2, "token: abc", 2.0, 1.0, None, None, None), ("v", 3, "gone", 1.0, 1.0, 5.0, None, "s")], "user_id string, id int, content string, salience double, valid_at double, invalid_at double, subject_party string, source string")
    (p,) = packs.finish_packs(packs.build_packs(r, m, budget=40)).collect()
    assert [x.id for x in p.rules] == ["r2"] and [x.content for x in p.memories] == ["[REDACTED_SECRET]"] and p.truncated and p.rules_total == 4
    body = {"memories": [{"content": "[REDACTED_SECRET]", "salience": 2.0, "score": None, "source": ""}], "project": None, "rules": [{"forbid_patterns": ["p"], "id": "r2", "message": "m" * 40, "project": "", "require_patterns": [], "rule": "", "severity": "high", "type": "soft"}]}
    assert p.hash == hashlib.sha256(json.dumps(body, ensure_ascii=False, sort_keys=True).encode()).hexdigest()[:16]
    assert p.markdown.startswith("# Context Pack\n\n## Bilinen") and "    yasak: p" in p.markdown and p.token_estimate == len(p.markdown) // 4
