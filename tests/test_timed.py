"""Stateful streams whose state ends, over several micro-batches and a restart."""

import datetime

import numpy as np
import pytest

from tamarack.operators import transcripts, usage
from tamarack.streaming import timed


@pytest.fixture
def rocks(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    timed.use_rocksdb(spark)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def run(spark, schema, make, batches, path):
    """Each batch is a file and a run of its own, from one checkpoint: the last state metrics, and all rows."""
    kept = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{path}/in")
        stream = make(spark.readStream.schema(schema).json(f"{path}/in"))
        q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start()
        q.awaitTermination()
        kept += [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]][-1:]
    return kept, spark.read.parquet(f"{path}/out").collect()


def test_rate_limits_forget_idle_tenants(rocks, tmp_path):
    rng = np.random.default_rng(2)
    at = np.cumsum(rng.integers(0, 4, 120)).astype(float)
    rows = [(["a", "b", "c"][int(k)], float(t), i) for i, (t, k) in enumerate(zip(at, rng.integers(0, 3, 120), strict=True))]
    batches = [rows[:50], rows[50:90], rows[90:], [("z", 1e5, 1000)], [("z", 2e5, 1001)]]
    schema = "tenant_id string, at double, seq long"
    kept, got = run(rocks, schema, lambda s: timed.rate_limit_stream(s, 3, 20.0, "5 seconds"), batches, str(tmp_path))
    want = usage.rate_limited(rocks.createDataFrame(sum(batches, []), schema), 3, 20.0).collect()
    assert sorted((r.tenant_id, r.seq, r.accepted) for r in got) == sorted((r.tenant_id, r.seq, r.accepted) for r in want)
    assert {r.accepted for r in got} == {True, False} and kept[-1] < kept[0], kept


def test_quotas_end_with_their_period(rocks, tmp_path):
    rows = [("a" if i % 3 else "b", f"p{i // 40}", i, float(1 + i % 4), f"2024-01-0{1 + i // 40} 10:00:{i % 40:02d}", f"2024-01-0{2 + i // 40} 00:00:00") for i in range(120)]
    batches = [rows[:30], rows[30:70], rows[70:], [("z", "p9", 999, 1.0, "2024-02-01 00:00:00", "2024-02-02 00:00:00")]]
    schema = "tenant_id string, period string, seq long, cost double, ts timestamp, ends timestamp"
    parse = lambda b: [(*r[:4], *(datetime.datetime.fromisoformat(x) for x in r[4:])) for r in b]
    batches = [parse(b) for b in batches]
    kept, got = run(rocks, schema, lambda s: timed.consume_stream(s, 25.0), batches, str(tmp_path))
    want = usage.consume(rocks.createDataFrame(sum(batches, []), schema), 25.0).collect()
    assert sorted((r.tenant_id, r.seq, r.accepted) for r in got) == sorted((r.tenant_id, r.seq, r.accepted) for r in want) and {r.accepted for r in got} == {True, False}
    assert kept[-1] < max(kept), kept


@pytest.mark.parametrize("seed", [1, 2])
def test_transcripts_over_any_split(rocks, tmp_path, seed):

    rng = np.random.default_rng(seed)
    say = ["no, that's wrong", "fine", None, "again: never do that", "thanks"]
    start = datetime.datetime(2024, 1, 1)
    rows = [(c, t, ["user", "assistant", "user", "system"][int(rng.integers(4))], say[int(rng.integers(5))], start + datetime.timedelta(seconds=20 * c + t)) for c in range(12) for t in range(8)]
    order = sorted(range(len(rows)), key=lambda i: rows[i][4].timestamp() + rng.uniform(0, 60))
    rows_in = [rows[i] for i in order]
    cuts = sorted(rng.integers(1, len(rows), 3).tolist())
    batches = [rows_in[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)] + [[(99, 0, "user", "x", start + datetime.timedelta(days=1))], [(98, 0, "user", "y", start + datetime.timedelta(days=2))]]
    schema = "conv_id long, turn long, role string, text string, ts timestamp"
    _, got = run(rocks, schema, lambda s: timed.scan_stream(s, "3 minutes", "3 minutes"), [b for b in batches if b], str(tmp_path))
    want = transcripts.scan(rocks.createDataFrame(rows, schema)).collect()
    key = lambda r: (r.conv_id, r.turn, r.text, r.previous, tuple(r.signals), r.score, r.correction)
    assert sorted(map(key, (r for r in got if r.conv_id < 50)), key=str) == sorted(map(key, want), key=str) and want
