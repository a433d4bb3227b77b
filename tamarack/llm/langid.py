"""Language identification by a bidirectional gated recurrent network over bytes (operator 10).

A text's bytes are cut into windows of WINDOW bytes (all of them, the last padded and masked). Two GRUs read each window,
one from either end; a linear layer labels every position from both states, and a document's probabilities are the mean
over all its positions. The network is trained here, in numpy, by backpropagation through time and Adam, on PER_DOC
windows of each of about TRAIN_DOCS documents: of every language as many, at least one, those of the smallest hash of
doc_id and text. The windows are cut on the executors.

Defined cases: a null text, or one without any letter, is `und` with score 0; without training rows everything is `und`;
repeated rows and null doc_id are predicted alike (a null is not held out); an empty table gives an empty result; extra
columns are ignored. Only text and non-null lang of training rows are learned from.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, documents, materialize, remove, small, table
from .textkit import text_buffer

WINDOW, HIDDEN = 32, 8
TRAIN_DOCS, PER_DOC, STEPS, BATCH = 1500, 48, 400, 256
#: Windows that are labelled at once.
AT_ONCE = 8192
_WORDLIKE = re.compile(r"[^\W\d_]")
f4 = np.float32


def has_letter(text: str | None) -> bool:
    """Whether some character is a letter; number signs such as a half or a superscript are none."""
    return text is not None and any(m[0].isalpha() for m in _WORDLIKE.finditer(text))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return f4(0.5) * np.tanh(f4(0.5) * x) + f4(0.5)


def gru_forward(p: dict, d: str, x: np.ndarray, keep: bool = True) -> tuple[np.ndarray, list]:
    """x: bytes (T, N), in reading order. States (T, N, H), and what the backward pass needs."""
    t, n = x.shape
    h = np.zeros((n, HIDDEN), f4)
    states, saved = np.empty((t, n, HIDDEN), f4), []
    table, u, uc = p["in" + d], p["u" + d], p["c" + d]
    for i in range(t):
        g = table[x[i]]
        zr = sigmoid(g[:, : 2 * HIDDEN] + h @ u)
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        rh = r * h
        c = np.tanh(g[:, 2 * HIDDEN :] + rh @ uc)
        new = h + z * (c - h)
        if keep:
            saved.append((h, z, r, rh, c))
        h = new
        states[i] = h
    return states, saved


def gru_backward(p: dict, d: str, x: np.ndarray, saved: list, ds: np.ndarray, grad: dict) -> None:
    """ds: the loss's gradient by each state."""
    dh = np.zeros_like(ds[0])
    for i in range(len(x) - 1, -1, -1):
        h, z, r, rh, c = saved[i]
        dh = dh + ds[i]
        dc = dh * z * (1 - c * c)
        drh = dc @ p["c" + d].T
        dz = dh * (c - h) * z * (1 - z)
        dr = drh * h * r * (1 - r)
        zr = np.concatenate([dz, dr], 1)
        grad["c" + d] += rh.T @ dc
        grad["u" + d] += h.T @ zr
        np.add.at(grad["in" + d], x[i], np.concatenate([zr, dc], 1))
        dh = dh * (1 - z) + drh * r + zr @ p["u" + d].T


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


@dataclass
class Network:
    langs: list[str]
    p: dict

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (T, N, languages) of windows x (T, N)."""
        f, _ = gru_forward(self.p, "f", x, keep=False)
        b, _ = gru_forward(self.p, "b", x[::-1], keep=False)
        w = self.p["out"]
        return softmax(f @ w[:HIDDEN] + b[::-1] @ w[HIDDEN : 2 * HIDDEN] + w[2 * HIDDEN])

    def pooled(self, column: pa.Array) -> np.ndarray:
        """Mean probabilities (texts, languages) over all positions; zeros for an empty text."""
        data, off = text_buffer(column)
        size = np.diff(off)
        n = -(-size // WINDOW)
        doc = np.repeat(np.arange(len(size)), n)
        first = np.cumsum(n) - n
        start = off[doc] + (np.arange(len(doc)) - first[doc]) * WINDOW
        out = np.zeros((len(size), len(self.langs)))
        for lo in range(0, len(doc), AT_ONCE):
            s, d = start[lo : lo + AT_ONCE], doc[lo : lo + AT_ONCE]
            at = s[None, :] + np.arange(WINDOW)[:, None]
            real = at < off[d + 1][None, :]
            x = np.where(real, data[np.minimum(at, len(data) - 1)], 0)
            q = np.einsum("tnl,tn->nl", self.positions(x), real.astype(f4))
            for j in range(len(self.langs)):
                out[:, j] += np.bincount(d, q[:, j], len(size))
        return out / np.maximum(1, size)[:, None]


def cut(text: str, key: int) -> list[bytes]:
    """PER_DOC windows of a text at places drawn by `key`, shorter ones of a shorter text."""
    data = text.encode()
    starts = np.random.default_rng(key & 0xFFFFFFFFFFFFFFFF).integers(max(1, len(data) - WINDOW + 1), size=PER_DOC)
    return [data[s : s + WINDOW] for s in starts]


def train(rows: list[tuple[str, list[bytes]]], steps: int = STEPS, seed: int = 7) -> Network:
    """rows: each training document's language and windows."""
    names = sorted({lang for lang, _ in rows})
    rng = np.random.default_rng(seed)
    by = [[w for lang, cuts in rows if lang == k for w in cuts if w] for k in names]
    full = [k for k in range(len(names)) if by[k]]
    p: dict = {"out": (rng.normal(size=(2 * HIDDEN + 1, len(names))) * 0.1).astype(f4)}
    for d in "fb":
        p |= {
            "in" + d: (rng.normal(size=(256, 3 * HIDDEN)) * 0.3).astype(f4),
            "u" + d: (rng.normal(size=(HIDDEN, 2 * HIDDEN)) * 0.3).astype(f4),
            "c" + d: (rng.normal(size=(HIDDEN, HIDDEN)) * 0.3).astype(f4),
        }
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    for step in range(1, steps + 1 if len(full) > 1 else 1):
        y = rng.choice(full, BATCH)
        x = np.zeros((WINDOW, BATCH), np.int64)
        real = np.zeros((WINDOW, BATCH), f4)
        for i, k in enumerate(y):
            piece = np.frombuffer(by[k][rng.integers(len(by[k]))], np.uint8)
            x[: len(piece), i], real[: len(piece), i] = piece, 1
        hf, sf = gru_forward(p, "f", x)
        hb, sb = gru_forward(p, "b", x[::-1])
        both = np.concatenate([hf, hb[::-1], np.ones((*x.shape, 1), f4)], 2)
        q = softmax(both @ p["out"])
        q[:, np.arange(BATCH), y] -= 1
        q *= (real / real.sum())[..., None]
        grad = {k: np.zeros_like(a) for k, a in p.items()}
        grad["out"] = np.einsum("tnh,tnl->hl", both, q)
        ds = q @ p["out"][: 2 * HIDDEN].T
        gru_backward(p, "f", x, sf, ds[..., :HIDDEN], grad)
        gru_backward(p, "b", x[::-1], sb, ds[::-1, :, HIDDEN:], grad)
        rate = f4(0.02 if step < 0.7 * steps else 0.004)
        for k in p:
            m[k] = f4(0.9) * m[k] + f4(0.1) * grad[k]
            v[k] = f4(0.99) * v[k] + f4(0.01) * grad[k] ** 2
            p[k] = (p[k] - rate * (m[k] / f4(1 - 0.9**step)) / (np.sqrt(v[k] / f4(1 - 0.99**step)) + f4(1e-8))).astype(f4)
    return Network(names, p)


def predict_language(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred, score."""

    def fn(b: pa.RecordBatch) -> dict:
        texts = b.column(1)
        some = np.array([has_letter(t) for t in texts.to_pylist()], bool)
        if net is None or not some.any():
            return {"doc_id": b.column(0), "lang_pred": ["und"] * len(texts), "score": np.zeros(len(texts))}
        q = net.pooled(texts)
        best = q.argmax(1)
        return {
            "doc_id": b.column(0), "lang_pred": [net.langs[k] if s else "und" for k, s in zip(best, some, strict=True)],
            "score": np.where(some, np.minimum(1.0, q.max(1)), 0.0),
        }

    return arrow_map(documents(docs), fn, "doc_id long, lang_pred string, score double")


def training_rows(docs: DataFrame, bound: int) -> list[tuple[str, list[bytes]]]:
    """Language and windows of the sampled documents, in a fixed order."""
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    known = documents(docs, F.col("lang").cast("string").alias("known")).where((part != 2) & F.col("known").isNotNull())
    known = known.select("known", "text", F.xxhash64("doc_id", "text").alias("key"))
    count = materialize(known.groupBy("known").agg(F.count_distinct("key").alias("count")), "language-counts")
    quota = max(1, bound // max(1, count.count()))
    # Twice the quota by hash in expectation, then exactly the quota: few rows meet in the ranking, however large a language is.
    draw = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < F.lit(quota * 2.0 + 50) / F.col("count") * (1 << 30)
    drawn = known.join(small(count), "known").where(draw).select("known", "text", "key")

    def fn(b: pa.RecordBatch) -> dict:
        texts, keys = b.column(1).to_pylist(), b.column(2).to_pylist()
        return {"known": b.column(0), "key": b.column(2), "cuts": [cut(t or "", k) for t, k in zip(texts, keys, strict=True)]}

    cuts = arrow_map(drawn, fn, "known string, key long, cuts array<binary>").dropDuplicates(["known", "key"])
    order = Window.partitionBy("known").orderBy(F.xxhash64("key"), "key")
    got = cuts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= quota).collect()
    remove(count)
    return [(r.known, [bytes(x) for x in r.cuts]) for r in sorted(got, key=lambda r: (r.known, r.key))]


def language_id(docs: DataFrame, bound: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score. Held-out rows (fold 2 of 4) are not learned from."""
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    rows = training_rows(docs, bound)
    net = train(rows) if rows else None
    return predict_language(docs, net).select("doc_id", F.coalesce(part == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))
