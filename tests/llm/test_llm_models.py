"""The trained models against scalar references: gradients by differences, a forward pass in plain floats, an exact posterior."""

import math
import re

import numpy as np
import pytest

W = [f"w{i}" for i in range(300)]


@pytest.fixture
def tiny(monkeypatch):
    """The recurrent network with 4 hidden units, in double precision."""
    from tamarack.llm import langid

    monkeypatch.setattr(langid, "f4", np.float64)
    monkeypatch.setattr(langid, "HIDDEN", 4)
    rng = np.random.default_rng(0)
    p = {"out": rng.normal(size=(9, 3))}
    for d in "fb":
        p |= {"in" + d: rng.normal(size=(256, 12)), "u" + d: rng.normal(size=(4, 8)), "c" + d: rng.normal(size=(4, 4))}
    return langid, p, rng


def test_backpropagation_through_time(tiny):
    langid, p, rng = tiny
    x = rng.integers(0, 5, (6, 3))
    ds = rng.normal(size=(6, 3, 4))
    grad = {k: np.zeros_like(a) for k, a in p.items()}
    _, saved = langid.gru_forward(p, "f", x)
    langid.gru_backward(p, "f", x, saved, ds, grad)
    loss = lambda: float((langid.gru_forward(p, "f", x)[0] * ds).sum())
    for name in ("inf", "uf", "cf"):
        flat, found = p[name].reshape(-1), grad[name].reshape(-1)
        at = [i for i in rng.permutation(len(flat)) if name != "inf" or i // 12 < 5][:40]
        for i in at:
            old, e = flat[i], 1e-5
            flat[i] = old + e
            up = loss()
            flat[i] = old - e
            down = loss()
            flat[i] = old
            assert found[i] == pytest.approx((up - down) / (2 * e), rel=1e-5, abs=1e-7)
    assert not grad["inf"][5:].any() and not grad["ub"].any()


def scalar_states(p, d, data):
    s = lambda v: 1 / (1 + math.exp(-v))
    h, out = [0.0] * 4, []
    for byte in data:
        g = p["in" + d][byte]
        z = [s(g[k] + sum(h[j] * p["u" + d][j][k] for j in range(4))) for k in range(4)]
        r = [s(g[4 + k] + sum(h[j] * p["u" + d][j][4 + k] for j in range(4))) for k in range(4)]
        c = [math.tanh(g[8 + k] + sum(r[j] * h[j] * p["c" + d][j][k] for j in range(4))) for k in range(4)]
        h = [h[k] + z[k] * (c[k] - h[k]) for k in range(4)]
        out.append(h)
    return out


def test_positions_and_pooling(tiny):
    """Every position's probabilities in plain floats; a document's are their mean over windows of its bytes."""
    import pyarrow as pa

    langid, p, _ = tiny
    net = langid.Network(["a", "b", "c"], p)
    texts = ["", "abc", "é and so on " * 30, None]
    want = []
    for t in texts:
        data, total = (t or "").encode(), np.zeros(3)
        for lo in range(0, len(data), langid.WINDOW):
            window = data[lo : lo + langid.WINDOW]
            padded = window + bytes(langid.WINDOW - len(window))
            f, b = scalar_states(p, "f", padded), scalar_states(p, "b", padded[::-1])[::-1]
            for i in range(len(window)):
                v = [sum(x * p["out"][j][k] for j, x in enumerate([*f[i], *b[i], 1.0])) for k in range(3)]
                e = np.exp(np.array(v) - max(v))
                total += e / e.sum()
        want.append(total / max(1, len(data)))
    assert np.allclose(net.pooled(pa.array(texts)), want, atol=1e-6)


def test_posterior_of_the_label_model():
    """Bayes' rule over each row's votes, each given the class and its parent's vote."""
    from tamarack.llm.toxicity import LabelModel

    rng = np.random.default_rng(3)
    y = rng.random(4000) < 0.3
    v = np.stack([np.where(rng.random(4000) < a, np.where(y, 1, -1), rng.integers(-1, 2, 4000)) for a in (0.8, 0.6, 0.5, 0.4)], 1).astype(np.int8)
    v = np.concatenate([v, np.where(rng.random(4000) < 0.9, v[:, 0], 0)[:, None]], 1)  # leans on the first voter
    m = LabelModel.fit(v, 0.3)
    assert m.parent[4] == 0 or m.parent[0] == 4
    table = np.exp(m.table)
    assert np.allclose(table.sum(2), 1)
    for i in range(0, 4000, 200):
        like = [1 - m.prior, m.prior]
        for c in (0, 1):
            for k in range(5):
                other = v[i, m.parent[k]] if m.parent[k] >= 0 else 0
                like[c] *= table[c, k, v[i, k] + 1, other + 1]
        assert m.posterior(v[i : i + 1])[0] == pytest.approx(like[1] / sum(like), abs=1e-6)
    # Without labels the model finds the classes, and the accuracies of the voters that stand alone.
    p = m.posterior(v)
    assert ((p > 0.5) == y).mean() > 0.93
    for k, a in ((1, 0.6), (2, 0.5), (3, 0.4)):
        if m.parent[k] < 0:
            assert np.exp(m.table[1, k, 2, 1]) == pytest.approx(a + (1 - a) / 3, abs=0.06)


def test_logistic_fit():
    """At the optimum the gradient of the penalized loss is zero, and moving away costs."""
    from tamarack.llm.toxicity import logistic

    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(200, 3)), rng.random(200)
    w = logistic(x, y)

    def loss(w):
        total = 0.0
        for row, t in zip(x, y, strict=True):
            z = sum(a * b for a, b in zip(row, w[:-1], strict=True)) + w[-1]
            total += math.log1p(math.exp(z)) - t * z
        return total / len(x) + 1e-3 / 2 * sum(a * a for a in w)

    for i in range(4):
        for e in (1e-3, -1e-3):
            other = w.copy()
            other[i] += e
            assert loss(other) > loss(w)


def test_scores_of_the_query(spark, tmp_path):
    """Every document's score from the trained weights, with features counted word by word."""
    from tamarack.llm import toxicity as T

    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(W, int(rng.integers(5, 80)))) + (" you awful, AWFUL moron!!" if i % 6 == 1 else "")) for i in range(500)] + [(600, None), (601, ""), (602, "MORON! " * 50)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 == 1)) for i in range(500)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen, lexicon = [], []
    real, learn = T.train, T.learn_lexicon
    T.train = lambda *a: seen.append(real(*a)) or seen[-1]
    T.learn_lexicon = lambda *a: lexicon.append(learn(*a)) or lexicon[-1]
    try:
        got = {r.doc_id: r for r in T.op8_toxicity(spark, str(tmp_path)).collect()}
    finally:
        T.train, T.learn_lexicon = real, learn
    w, names = seen[0].weights, lexicon[0]
    assert names and w is not None
    breaks = re.compile(b"[" + re.escape(bytes(np.flatnonzero(T.BREAKS).astype(np.uint8))) + b"]+")
    for i, t in rows:
        data = (t or "").encode()
        tokens = [x.lower() for x in breaks.split(data) if x]
        hits = [tokens.count(k.encode()) for k in names]
        n, kinds = sum(hits), sum(h > 0 for h in hits)
        size = max(1, len(data))
        own = [*(min(h, 3) for h in hits), math.log1p(n), math.log1p(kinds), min(1, 20 * n / max(1, len(tokens))), n == 0, sum(65 <= b <= 90 for b in data) / size, data.count(b"!") / size]
        z = sum(a * b for a, b in zip(own, w[:-1], strict=True)) + w[-1]
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-5)
        assert got[i].predicted == (got[i].score >= 0.5)
    assert sum(got[i].predicted != (i % 6 == 1) for i in range(500)) <= 5
