"""The vector index and the cosine-threshold join against all pairs."""

import math

import numpy as np
import pytest

from tamarack.operators import graph, similarity


def clustered(seed=3, clusters=12, each=40, d=24, noise=0.05):
    """Unit vectors around centres; in each cluster some equal ones."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, d))
    centres /= np.sqrt((centres**2).sum(1))[:, None]
    x = np.repeat(centres, each, 0) + noise * rng.normal(size=(clusters * each, d))
    x[5::each] = x[4::each]
    return np.round(x, 3)


def cos(a, b):
    if not a or not b or len(a) != len(b) or any(v != v for v in [*a, *b]):
        return 0.0
    a, b = [float(np.float32(v)) for v in a], [float(np.float32(v)) for v in b]
    na, nb = math.sqrt(sum(v * v for v in a)), math.sqrt(sum(v * v for v in b))
    return round(sum(x * y for x, y in zip(a, b, strict=True)) / (na * nb), 6) if na and nb else 0.0


ODD = [None, [], [0.0] * 24, [1.0, 2.0], [2.0, 4.0], [float("nan")] * 24]


def frame(spark, vectors, name, users=3):
    kinds = ["", "a", "b"]
    rows = [(i, kinds[i % 3], f"u{0 if i % 2 else i % users}", None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, f"{name} long, kind string, user string, embedding array<float>").repartition(5), rows


@pytest.mark.parametrize(("threshold", "by", "pack"), [(0.95, [], 1 << 20), (0.9, ["user"], 1 << 12), (0.3, [], 1 << 12)])
def test_join_equals_all_pairs(spark, monkeypatch, threshold, by, pack):
    monkeypatch.setattr(similarity, "PACK_BYTES", pack)
    left, lrows = frame(spark, [*clustered()[::3].tolist(), *ODD], "key")
    right, rrows = frame(spark, [*clustered()[::2].tolist(), *ODD], "id")
    want = {}
    for k, kind, user, v in lrows:
        for i, other, user2, w in rrows:
            if (not by or user == user2) and (not kind or not other or kind == other) and (s := cos(v, w)) >= threshold:
                want[k, i] = s
    got = {(r.key, r.id): r.score for r in similarity.cosine_join(left, right, threshold, by).collect()}
    assert got == pytest.approx(want, abs=1.1e-6) and len(want) > 100
    best = {}
    for (k, i), s in sorted(want.items()):
        if k not in best or s > best[k][1] + 5e-7:
            best[k] = (i, s)
    found = {r.key: (r.id, r.score) for r in similarity.cosine_join(left, right, threshold, by, best=True).collect()}
    assert found.keys() == best.keys() and all(abs(found[k][1] - best[k][1]) < 2e-6 and want[k, found[k][0]] >= best[k][1] - 2e-6 for k in best)


def test_few_pairs_are_compared(spark):
    """Over vectors in clusters, far fewer than all pairs are compared, and their share falls with the number of clusters."""
    shares = []
    for clusters in (12, 48):
        x = clustered(clusters=clusters).tolist()
        left, right = frame(spark, x, "key")[0], frame(spark, x, "id")[0]
        packs = similarity.compared_packs(left, right, 0.95, [])
        shares.append(packs.selectExpr("sum(size(l) * size(r))").first()[0] / len(x) ** 2)
    assert shares[0] < 0.3 and shares[1] < 0.4 * shares[0]


def test_empty_sides(spark):
    left, right = frame(spark, clustered().tolist(), "key")[0], frame(spark, [], "id")[0]
    assert similarity.cosine_join(left, right, 0.9).count() == 0
    assert similarity.cosine_join(left.limit(0), left.withColumnRenamed("key", "id"), 0.9, ["user"], best=True).count() == 0
    with pytest.raises(ValueError, match="threshold"):
        similarity.cosine_join(left, right, 0.0)


def in_order(rows, threshold):
    """The leader of each row that follows: taken one by one."""
    led, out = [], {}
    for k, kind, _, v in rows:
        near = [(-cos(v, w), j) for j, other, w in led if (not kind or not other or kind == other) and cos(v, w) >= threshold]
        if near:
            out[k] = min(near)[1]
        elif v is not None:
            led.append((k, kind, v))
    return out


def test_followers(spark):
    x = clustered(clusters=4, each=20, noise=0.12)
    x[7::10] = x[3]  # many equal ones
    df, rows = frame(spark, [*x.tolist(), *ODD], "key")
    for threshold in (0.97, 0.9, 0.7):
        want = in_order(rows, threshold)
        assert {r.later: r.leader for r in similarity.followers(df, threshold).collect()} == want and want


def test_resolution_of_equal_vectors(spark):
    e = spark.createDataFrame([(1, "One", "k", [1.0, 0.0]), (2, "Two", "K ", [1.0, 0.0])], "id long, name string, kind string, embedding array<float>")
    m = spark.createDataFrame([(1, "x", "k", [1.0, 0.0]), (2, "y", "", [0.0, 1.0]), (3, "z", None, [0.0, 1.0]), (4, "w", "q", [0.0, 0.0]), (5, "v", "q", [0.0, 0.0])], "key long, name string, kind string, embedding array<float>")
    got = {r.key: (r.entity_id, r.how) for r in graph.resolve(m, e).collect()}
    assert got[1] == ("1", "vector") and got[2][1] == "new" and got[3] == (got[2][0], "batch") and got[4][1] == got[5][1] == "new"


def test_index(spark, tmp_path):
    x = clustered(clusters=30)
    v = frame(spark, [*x.tolist(), *ODD], "id")[0]
    facts = similarity.write_index(v, str(tmp_path / "i"))
    q = v.where("id % 20 = 0").selectExpr("id as query_id", "embedding as query_vec")
    exact = similarity.search_index(spark, str(tmp_path / "i"), q, 10, exact=True).collect()
    found = similarity.search_index(spark, str(tmp_path / "i"), q, 10)
    want = {}
    for i in range(0, len(x), 20):
        want[i] = sorted(((-cos(x[i].tolist(), w), j) for j, w in enumerate(x.tolist())))[:10]
    for i, w in want.items():
        assert [s for _, s in sorted((r.rank, r.score) for r in exact if r.query_id == i)] == pytest.approx([-s for s, _ in w], abs=2e-6)
    truth = spark.createDataFrame([(i, j) for i, w in want.items() for _, j in w], "query_id long, id long")
    assert similarity.index_recall(found, truth).first().recall >= 0.9 and 1 <= facts["probes"] < facts["cells"] / 2
    cells = {p.name for p in (tmp_path / "i" / "cells").iterdir() if p.name.startswith("cell=")}
    assert len(cells) >= facts["cells"]


def test_index_of_nothing(spark, tmp_path):
    v = frame(spark, ODD[:3], "id")[0]
    similarity.write_index(v, str(tmp_path / "i"))
    q = v.selectExpr("id as query_id", "array(1f, 2f) as query_vec")
    assert similarity.search_index(spark, str(tmp_path / "i"), q, 3).count() == 0
