"""Postings, names in texts, rule tables, intervals, keyed tables and large quotas against brute force."""

import re

import numpy as np
import pytest

from tamarack.operators import containment, enforcement, intervals, postings, retrieval, usage
from tamarack.sources import keyed

W = [f"word{i}" for i in range(60)] + ["İstanbul", "ısı", "ab", "abc", "straße"]


def texts(n=150, seed=4):
    rng = np.random.default_rng(seed)
    weights = 1 / np.arange(1, len(W) + 1)
    return [" ".join(rng.choice(W, int(rng.integers(1, 60)), p=weights / weights.sum())) for _ in range(n)]


def test_postings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "RANGE_DOCS", 8)
    rows = [*enumerate(texts()), (500, None), (501, ""), (502, "x y")]
    docs = spark.createDataFrame(rows, "id long, text string")
    q = spark.createDataFrame([(1, "word0 word40 word59"), (2, "word3"), (3, "nothing"), (4, None), (5, "word0 word1")], "query_id long, text string")
    path = str(tmp_path / "a")
    for lo, hi in ((0, 60), (60, 61), (61, 1000)):
        before = files(tmp_path / "a" / "postings")
        assert postings.append(docs.where((docs.id >= lo) & (docs.id < hi)), path) == {0: 0, 60: 1, 61: 2}[lo]
        after = files(tmp_path / "a" / "postings")
        assert before.items() <= after.items()
    want = {(r.query_id, r.rank): (r.id, r.score) for r in retrieval.bm25(docs, q, 5).collect()}
    got = postings.search(spark, path, q, 5)
    assert {(r.query_id, r.rank): (r.id, r.score) for r in got.collect()} == want and len(want) > 12
    assert "text" not in got._jdf.queryExecution().optimizedPlan().toString().replace("text#", "")
    gone = [want[1, 1][0], want[2, 1][0]]
    postings.remove(spark.createDataFrame([(i,) for i in gone], "id long"), path)
    left = {r.id for r in postings.search(spark, path, q, 500).collect()}
    assert not left & set(gone) and len(left) > 100
    postings.compact(spark, path, str(tmp_path / "b"))
    rest = docs.where(~docs.id.isin(*gone, 500, 501, 502))
    want = {(r.query_id, r.rank): (r.id, r.score) for r in retrieval.bm25(rest, q, 5).collect()}
    assert {(r.query_id, r.rank): (r.id, r.score) for r in postings.search(spark, str(tmp_path / "b"), q, 5).collect()} == want


def files(top):
    return {str(p): p.stat().st_mtime_ns for p in top.rglob("*.parquet")} if top.exists() else {}


def test_fewer_ranges_are_opened(spark, tmp_path, monkeypatch):
    """A rare word's ranges are read, most others are not."""
    monkeypatch.setattr(postings, "RANGE_DOCS", 4)
    rows = [(i, "common words here " * 3 + ("rare" if i % 100 == 7 else "")) for i in range(800)]
    path = str(tmp_path / "a")
    postings.append(spark.createDataFrame(rows, "id long, text string"), path)
    q = spark.createDataFrame([(1, "rare common")], "query_id long, text string")
    seen = []
    real = postings.keep
    monkeypatch.setattr(postings, "keep", lambda df, name: seen.append((name, out := real(df, name))) or out)
    got = postings.search(spark, path, q, 5, first_ranges=8).orderBy("rank").collect()
    assert [r.id for r in got] == [7, 107, 207, 307, 407]
    units = [out.select("range").distinct().count() for name, out in seen if name == "postings-open"]
    assert max(units) <= 10 < spark.read.parquet(f"{path}/postings").select("range").distinct().count()


@pytest.mark.parametrize("most", [2, 50_000])
def test_names_in_texts(spark, most):
    rows = [*enumerate(texts(60)), (90, None), (91, ""), (92, "xabcx")]
    names = ["ab", "abc", "bc", "word1", "word1 word", "İ", "", None, "word1", "nowhere"]
    got = containment.contained(spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame([(n,) for n in names], "name string"), most)
    want = {(i, n) for i, t in rows for n in names if n and t and n in t}
    assert sorted((r.id, r.name) for r in got.collect()) == sorted(want) and len(want) > 20
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert containment.contained(spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame([], "name string")).count() == 0


PATTERNS = [
    r"word1\b", r"WORD2?3", r"word[12]x|word7", r"(word1|word2) word", r"istanbul", r"ISI", r"\bkk+", r"a{2}b", r"wor(d5)+", r"word5+", r"\d{2}$",
    r"(?x) w ord1", r"[", r"(a+)+b", r"wo\.rd", r"word\d\sword\d", r"^word", r"[]a]bc", r"s", r"straSSe", "ſtra", "x(?=y)",
]


def test_literals_are_in_every_match():
    have = [*texts(80), "kk KK abbc aab wo.rd İSTANBUL ISI xy word33 ]bc STRASSE stra"]
    for p in filter(enforcement.usable, PATTERNS):
        own = containment.literal(p)
        for t in have:
            for m in re.finditer(p, t, re.IGNORECASE):
                assert own in m[0].translate(str.maketrans(*containment.LIKE_ASCII)).lower(), (p, own, m[0])
    assert containment.literal(r"word1\b") == "word1" and containment.literal(r"ab?c") == "" and containment.literal(r"colou?red of") == "red of"
    assert containment.literal(r"a\.b\-c\d+xyz12") == "xyz12" and containment.literal(r"(abc)def") == "def" and containment.literal(r"abc|def") == ""


def test_rule_tables_equal_rules_in_the_plan(spark):
    from pyspark.sql import functions as F

    rows = [*enumerate(texts(40)), (90, None), (91, ""), (92, "İSTANBUL ISI ısı xy KK aab " + "y" * 10_000 + " word1")]
    t = spark.createDataFrame(rows, "id long, text string")
    rules = [(f"r{i}", ["low", "HIGH", None, "odd"][i % 4], [p] if i % 3 else [], [] if i % 3 else [p, "word1"]) for i, p in enumerate(PATTERNS)]
    got = containment.check(t, spark.createDataFrame(rules, "rule_id string, severity string, forbid array<string>, require array<string>"))
    want = []
    for r in rules:
        found = t.select("id", F.inline(enforcement.findings(F.substring(F.coalesce("text", F.lit("")), 1, 10_000), enforcement.PolicyRule(r[0], "hard", r[1], "", r[2], r[3]))))
        want += [tuple(x) for x in found.collect()]
    assert sorted(map(tuple, got.select("id", "rule_id", "severity", "evidence").collect())) == sorted(want) and len(want) > 100


def test_plan_of_5000_rules_is_small(spark):
    t = spark.createDataFrame([*enumerate(texts(30))], "id long, text string")
    book = lambda n: spark.createDataFrame([(f"r{i}", "low", [rf"word{i}\b"], []) for i in range(n)], "rule_id string, severity string, forbid array<string>, require array<string>")
    few, many = containment.check(t, book(5)), containment.check(t, book(5000))
    size = lambda df: len(re.sub(r"#\d+L?|\d+", "", df._jdf.queryExecution().executedPlan().toString()))
    assert size(many) < 1.2 * size(few)
    want = {(i, f"r{k}") for i, x in enumerate(texts(30)) for k in range(60) if re.search(rf"word{k}\b", x)}
    assert {(r.id, r.rule_id) for r in many.collect()} == want


@pytest.mark.parametrize("depth", [3, 15])
def test_points_in_intervals(spark, depth):
    rng = np.random.default_rng(9)
    points = [(i, "ab"[i % 2], float(x)) for i, x in enumerate(rng.integers(0, 100, 80))] + [(99, "a", None), (98, None, 5.0)]
    spans = [(i, "ab"[i % 2], float(a), None if i % 5 == 0 else float(a + b)) for i, (a, b) in enumerate(zip(rng.integers(-50, 150, 90), rng.integers(-3, 60, 90), strict=True))]
    spans += [(200, "a", None, 5.0), (201, "a", -1e9, 1e9), (202, "b", 7.0, 7.0)]
    p, s = spark.createDataFrame(points, "pid int, k string, at double"), spark.createDataFrame(spans, "sid int, k string, valid_at double, invalid_at double")
    want = sorted((i, j) for i, k, t in points for j, k2, a, b in spans if t is not None and a is not None and k == k2 and a <= t and (b is None or t < b))
    got = intervals.points_in_intervals(p, s, ["k"], depth)
    assert sorted((r.pid, r.sid) for r in got.collect()) == want and len(want) > 300
    assert intervals.points_in_intervals(p.limit(0), s, ["k"], depth).count() == 0 == intervals.points_in_intervals(p, s.limit(0), ["k"], depth).count()
    one = intervals.points_in_intervals(p.select("pid", "at").limit(5), s.drop("k"), None, depth)
    assert one.count() > 0


def test_keyed_tables_keep_untouched_files(spark, tmp_path):
    path = str(tmp_path / "k")
    keyed.write_keyed(spark.createDataFrame([(i, i) for i in range(500)], "id long, v long"), path, ["id"], 16)
    before = files(tmp_path / "k")
    new = spark.createDataFrame([(3, -1), (1000, -2)], "id long, v long")
    merge = lambda old, new: old.join(new, "id", "left_anti").unionByName(new)
    touched = keyed.upsert_keyed(new, path, ["id"], merge, 16)
    after = files(tmp_path / "k")
    same = {p for p in before if after.get(p) == before[p]}
    assert len(touched) <= 2 and {p for p in before if not any(f"{keyed.BUCKET}={b}/" in p for b in touched)} == same and len(same) >= 14
    got = {r.id: r.v for r in keyed.read_keyed(spark, path).collect()}
    assert got == {**{i: i for i in range(500)}, 3: -1, 1000: -2}
    assert [r.v for r in keyed.lookup(spark, path, spark.createDataFrame([(1000,), (7777,)], "id long"), ["id"], 16).collect()] == [-2]
    assert keyed.upsert_keyed(new.limit(0), path, ["id"], merge, 16) == []


@pytest.mark.parametrize(("limit", "costs"), [(700.0, (1.0, 5.0, 0.5)), (60.0, (0.2, 0.1, 7.3)), (0.0, (0.0, 1.0, 2.0)), (20.0, (0.2, 0.2, 0.2))])
def test_large_quotas(spark, limit, costs):
    """Prefix sums over ranges say what a fold in order says, also where only rounding decides."""
    rng = np.random.default_rng(1)
    rows = [("t" if i % 10 else f"u{i % 7}", None if i % 2 else "p", i, None if i % 97 == 0 else float(rng.choice(costs))) for i in range(2000)]
    df = spark.createDataFrame(rows, "tenant_id string, period string, seq long, cost double").repartition(7)
    key = lambda r: (r.tenant_id, r.period, r.seq)
    want = {key(r): r.accepted for r in usage.consume(df, limit, fold_rows=10**9).collect()}
    assert {key(r): r.accepted for r in usage.consume(df, limit, fold_rows=100).collect()} == want
    assert len(set(want.values())) == 2


def test_kept_tables_can_be_dropped(spark, tmp_path, monkeypatch):
    from tamarack.sources import tables

    monkeypatch.setattr(tables, "shared_dir", lambda _: f"file://{tmp_path}")
    assert tables.keep(spark.range(5), "x").count() == 5 == tables.keep(spark.range(5), "x").count()
    assert tables.drop_kept(spark) == 2 and tables.drop_kept(spark) == 0


def test_ranks_by_ranges_equal_ranks_by_windows(spark):
    rng = np.random.default_rng(6)
    rows = [(int(q), i, float(a), float(b)) for i, (q, a, b) in enumerate(zip(rng.integers(0, 3, 600), rng.integers(-2, 9, 600), rng.random(600), strict=True))]
    items = spark.createDataFrame(rows, "query_id int, id long, a double, b double").repartition(6)
    got = [sorted((r.query_id, r.id, r.rrf) for r in retrieval.reciprocal_rank(items, "query_id", "id", {"a": 1.0, "b": 0.5}, spread=x).collect()) for x in (False, True)]
    assert got[0] == got[1] and len(got[0]) == 600
