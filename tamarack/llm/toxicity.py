"""Toxicity by weak supervision (operator 8).

1. From at most TRAIN_DOCS labelled training documents (those of the smallest hash of doc_id) a lexicon is taken: words
   with which the odds of toxic are over twice as high, significantly. Each lexicon word is a voter for toxic; further voters are its
   families (any, two, or many hits, density) and patterns (shouting, symbols), and an empty-handed voter for not toxic.
   With an empty lexicon the patterns that pass the words' test vote alone. Words and votes are counted on the executors.
2. A generative label model over the votes, fitted by expectation-maximization that starts from the sample's labels:
   each voter's propensities and accuracy given the class, and the correlations of voters as pairwise factors, P(vote |
   class, vote of the voter that it depends on most), along a maximum spanning forest of their mutual information given
   the class.
3. A linear classifier (logistic regression) is trained on the model's posterior labels over the same documents, and
   scores every whole text.

A document's label, lang, source and doc_id are no inputs of its score. Defined cases: null text is empty; an empty text
gets the score of one without any hit; without training labels of both classes, or with neither a word nor a pattern
that passes, the score is the share of toxic labels (0 without labels); repeated rows and null doc_id are scored alike (a null is not held out); an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, bounded_sample, documents, materialize, remove, table
from .textkit import Words

TRAIN_DOCS = 6000
LEXICON = 256
#: Letters, and all bytes of characters beyond ASCII, make up words here.
BREAKS = np.ones(256, bool)
BREAKS[65:91] = BREAKS[97:123] = BREAKS[128:] = False
#: The words of BREAKS, for Java's regular expressions, after A-Z are lower-cased.
_WORD = "[a-z\\x{80}-\\x{10ffff}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The least log-likelihood ratio that counts as significant.
LEAST_GAIN = 8.0


def raised(k: int, n: int, prior: float) -> float:
    """The log-likelihood ratio of k toxic ones among n, or 0 if the odds are not over twice the prior's or the ratio is not significant."""
    share = k / n if n else 0.0
    if k < 3 or share * (1 - prior) <= 2 * prior * (1 - share):
        return 0.0
    gain = k * math.log(share / prior) + (n - k) * (math.log((1 - share) / (1 - prior)) if k < n else 0)
    return gain if gain > LEAST_GAIN else 0.0


def learn_lexicon(sample: DataFrame, prior: float, size: int = LEXICON) -> list[str]:
    """Words that stand in at least three toxic documents of the sample (text, y), ranked by the log-likelihood ratio of their raised share."""
    words = F.array_distinct(F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(_WORD), F.lit(0)))
    each = sample.select("y", F.explode(words).alias("word")).groupBy("word").agg(F.sum("y").alias("k"), F.count("*").alias("n")).where("k >= 3")
    share, rest = F.col("k") / F.col("n"), F.col("n") - F.col("k")
    gain = F.col("k") * F.log(share / prior) + F.when(rest > 0, rest * F.log((1 - share) / (1 - prior))).otherwise(0.0)
    found = each.where(share * (1 - prior) > 2 * prior * (1 - share)).withColumn("gain", gain).where(F.col("gain") > LEAST_GAIN)
    return [r.word for r in found.orderBy(F.desc("gain"), "word").limit(size).collect()]


def counts(column: pa.Array, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lexicon hits per text and word, words per text, further signals per text)."""
    w = Words(column, lower=True, breaks=BREAKS)
    order = np.argsort(hashes)
    out = np.zeros((len(w), len(hashes)), np.float32)
    if len(hashes) and len(w.starts):
        s = hashes[order]
        at = np.minimum(np.searchsorted(s, w.hash), len(s) - 1)
        ok = s[at] == w.hash
        np.add.at(out, (w.doc_of()[ok], order[at[ok]]), 1)
    total = lambda x: np.add.reduceat(np.concatenate([x, [0]]).astype(np.int64), w.offsets[:-1]) * (np.diff(w.offsets) > 0) if len(w) else np.zeros(0)
    upper, bang = total((w.data >= 65) & (w.data <= 90)), total(w.data == 33)
    size = np.maximum(1, np.diff(w.offsets))
    return out, w.counts, np.stack([upper / size, bang / size], 1)


def patterns(other: np.ndarray) -> np.ndarray:
    """Shouting, symbols."""
    return np.stack([other[:, 0] > 0.5, other[:, 1] > 0.02], 1)


def votes(hits: np.ndarray, words: np.ndarray, other: np.ndarray, alone: list[int]) -> np.ndarray:
    """1 toxic, -1 not toxic, 0 abstains; one column per voter. `alone`: the patterns that vote if there is no lexicon."""
    if not hits.shape[1]:
        plus = patterns(other)[:, alone].astype(np.int8)
        return np.concatenate([plus, -(plus.sum(1, keepdims=True) == 0).astype(np.int8)], 1)
    per = (hits > 0).astype(np.int8)
    kinds, n = per.sum(1), hits.sum(1)
    density = n / np.maximum(1, words)
    plus = [kinds >= 1, kinds >= 2, n >= 3, density > 0.005, density > 0.02, *(patterns(other) & (n > 0)[:, None]).T]
    minus = [n == 0, density < 0.0005, (kinds <= 1) & (words > 500)]
    return np.concatenate([per, np.stack(plus, 1).astype(np.int8), -np.stack(minus, 1).astype(np.int8)], 1)


def dependences(joint: np.ndarray, n: int) -> np.ndarray:
    """Each voter's parent (-1: none) in a maximum spanning forest of mutual information given the class. joint: classes, voters, votes, voters, votes."""
    p = joint / n
    own = np.einsum("cvava->cva", p)
    weight = own.sum(2)[:, :1, None, None, None]
    ratio = np.where(p > 0, p * weight / np.maximum(1e-300, own[:, :, :, None, None] * own[:, None, None, :, :]), 1)
    info = (p * np.log(ratio)).sum((0, 2, 4))
    parent, best, tied, inside = np.full(len(info), -1), np.zeros(len(info)), np.full(len(info), -1), np.zeros(len(info), bool)
    for _ in range(len(info)):
        i = int(np.argmax(np.where(inside, -1, best)))
        inside[i] = True
        # Twice n times the information is about chi-square with 8 degrees of freedom without a dependence; 40 is far out.
        parent[i] = tied[i] if 2 * n * best[i] > 40 else -1
        closer = ~inside & (info[i] > best)
        best[closer], tied[closer] = info[i][closer], i
    return parent


@dataclass
class LabelModel:
    prior: float
    parent: np.ndarray
    #: log P(vote | class, the parent's vote): classes, voters, votes (-1, 0, 1), votes of the parent.
    table: np.ndarray

    @staticmethod
    def fit(v: np.ndarray, prior: float, known: np.ndarray | None = None, rounds: int = 20) -> LabelModel:
        """`known`: what labels say of the rows (0..1); each round's classes are half theirs. Without it the first classes come
        from the votes, copies of a voter counting once together."""
        n, voters = v.shape
        one = np.stack([(v == x) for x in (-1, 0, 1)], 2).astype(float).reshape(n, 3 * voters)
        if known is None:
            r = v - v.mean(0)
            sd = np.maximum(1e-9, r.std(0))
            alike = np.abs(r.T @ r / n / np.outer(sd, sd))
            p = np.clip(prior + 0.4 * np.sign(v @ (1 / np.maximum(1, alike.sum(1)))), 0.02, 0.98)
        else:
            p = np.clip(known, 0.02, 0.98)
        parent = np.full(voters, -1)
        for i in range(rounds):
            joint = np.stack([(one * q[:, None]).T @ one for q in (1 - p, p)]).reshape(2, voters, 3, voters, 3)
            own = np.einsum("cvava->cva", joint)
            alone = (own + 0.1) / (own.sum(2, keepdims=True) + 0.3)
            if i % 5 == 0:
                parent = dependences(joint, n)
            # joint[c, u, b, v, a] of each voter v and its parent u, shrunk towards the voter alone.
            pair = joint[:, np.maximum(parent, 0), :, np.arange(voters), :].transpose(1, 0, 3, 2)
            given = (pair + alone[..., None]) / (pair.sum(2, keepdims=True) + 1)
            table = np.where((parent >= 0)[None, :, None, None], given, alone[..., None])
            model = LabelModel(prior, parent, np.log(table))
            p = model.posterior(v)
            if known is not None:
                p = (p + known) / 2
        return model

    def posterior(self, v: np.ndarray) -> np.ndarray:
        at = np.arange(v.shape[1])
        other = np.where(self.parent >= 0, v[:, np.maximum(self.parent, 0)], 0)
        t = self.table[:, at, v + 1, other + 1].sum(2)
        z = t[1] - t[0] + math.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def features(hits: np.ndarray, words: np.ndarray, other: np.ndarray) -> np.ndarray:
    if not hits.shape[1]:
        return np.concatenate([patterns(other), other], 1)
    n, kinds = hits.sum(1), (hits > 0).sum(1)
    return np.concatenate(
        [
            np.minimum(hits, 3),
            np.stack([np.log1p(n), np.log1p(kinds), np.minimum(1, 20 * n / np.maximum(1, words)), n == 0], 1), other,
        ],
        1,
    )


def logistic(x: np.ndarray, y: np.ndarray, decay: float = 1e-3, rounds: int = 40) -> np.ndarray:
    """Weights and bias by Newton's method on soft labels."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) / len(x) + decay * w
        h = (x * (p * (1 - p))[:, None]).T @ x / len(x) + decay * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    hashes: np.ndarray
    weights: np.ndarray | None
    constant: float

    def score(self, column: pa.Array) -> np.ndarray:
        if self.weights is None:
            return np.full(len(column), self.constant)
        x = features(*counts(column, self.hashes))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def train(sample: DataFrame, share: float, n: int) -> Model:
    """sample: text, y (0 or 1) and key, which orders the rows; the share of y among its n rows."""
    if not 0 < share < 1:
        return Model(np.zeros(0, np.uint64), None, share)
    prior = (share * n + 1) / (n + 2)
    lexicon = learn_lexicon(sample, prior)
    hashes = Words(pa.array(lexicon, pa.string()), lower=True, breaks=BREAKS).hash if lexicon else np.zeros(0, np.uint64)

    def fn(b: pa.RecordBatch) -> dict:
        hits, words, other = counts(b.column(0), hashes)
        return {"key": b.column(2), "y": b.column(1), "hits": list(hits), "words": words, "other": list(other)}

    rows = arrow_map(sample.select("text", "y", "key"), fn, "key long, y int, hits array<float>, words long, other array<double>").collect()
    rows.sort(key=lambda r: r.key)
    got = np.array(
        [r.hits for r in rows], np.float32,
    ).reshape(len(rows), len(hashes)), np.array([r.words for r in rows]), np.array([r.other for r in rows])
    toxic, found = np.array([r.y for r in rows], bool), patterns(got[2])
    alone = [j for j in range(found.shape[1]) if raised(int(found[toxic, j].sum()), int(found[:, j].sum()), prior)]
    if not lexicon and not alone:
        return Model(hashes, None, share)
    v = votes(*got, alone)
    posterior = LabelModel.fit(v, min(0.95, max(0.05, share)), toxic.astype(float)).posterior(v)
    return Model(hashes, logistic(features(*got), posterior), share)


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score."""
    return arrow_map(documents(docs), lambda b: {"doc_id": b.column(0), "score": model.score(b.column(1))}, "doc_id long, score double")


def fold(column: str, n: int) -> F.Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def toxicity(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, score, predicted. Labels of held-out rows (fold 0 of 5) are not read."""
    lab = labels.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y"),
    ).where((fold("doc_id", 5) != 0) & F.col("y").isin(0, 1)).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = bounded_sample(lab, "doc_id", bound)
    keyed = documents(docs).join(F.broadcast(chosen), "doc_id").select(
        F.coalesce("text", F.lit("")).alias("text"), "y", F.xxhash64("doc_id", "text").alias("key"),
    )
    keys = bounded_sample(keyed.select("key").distinct(), "key", 2 * bound)
    sample = materialize(keyed.join(F.broadcast(keys), "key").dropDuplicates(["key"]), "toxicity-sample")
    size = sample.agg(F.count("*").alias("n"), F.avg("y").alias("share")).first()
    model = train(sample, float(size.share or 0), size.n)
    remove(sample)
    s = score_toxicity(docs, model)
    return s.select(
        "doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
