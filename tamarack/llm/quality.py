"""Quality rules with risk-controlled thresholds (operator 9).

Every document gets text statistics. Base rules reject the hopeless ones. Beyond those, one-sided cutoffs on derived
signals are chosen per stratum (default: lang) on all labelled documents: a cutoff may be used only if the exact
(Clopper-Pearson) upper bound of its false-rejection rate among documents labelled good is at most risk / n_signals, so
the union of a stratum's rules stays within `risk`. Multiple testing: the error budget `delta` is divided evenly over
strata x signals (Bonferroni); along one signal the cutoffs are nested and tested from the most lenient on, stopping at
the first that fails (fixed-sequence testing, which needs no further division). Among the valid cutoffs of a signal, the
one with the largest share of bad documents rejected, less GOOD_WEIGHT times the share of good ones, is taken, the more
lenient at a tie, and none if that is not positive.

Labelled counts come from an aggregation over all labelled rows to a table of at most
2 x strata x signals x (GRID + 1) rows. Each stratum's cutoffs are chosen from it by a task and joined back, at any
number of strata; a stratum with too few labels for the bound gets no cutoff.

Defined cases: null text has no words, so it fails the base rules; a null stratum value is a stratum of its own; labels
rows with null doc_id or quality are ignored, and conflicting labels of one document count as good; repeated rows are
judged one by one; an empty table gives an empty result; without labels only the base rules apply.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, documents, materialize, small, table
from .textkit import Words, mix

SYMBOLS = b"#*$%&|<>"
#: Cutoffs that are tried per signal: i / GRID.
GRID = 64
#: What rejecting a good document costs against missing a bad one.
GOOD_WEIGHT = 10
#: Each lies in 0..1, higher is worse.
SIGNALS = ("symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio")

_SYM = np.zeros(256, bool)
_SYM[list(SYMBOLS)] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = True
_ALPHA[97:123] = True

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_alpha long"


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def text_stats(column: pa.Array) -> dict[str, np.ndarray]:
    w = Words(column)
    data, off = w.data, w.offsets
    n_lines, n_dup = [], []
    for d in range(len(w)):
        lines = [x for x in w.bytes_of(d).split(b"\n") if x.strip()]
        n_lines.append(len(lines))
        n_dup.append(len(lines) - len(set(lines)))
    g, at = w.grams(3)
    repeat = np.zeros(len(w), np.int64)
    if len(g):
        doc = w.doc_of()
        key = mix(g ^ (doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        order = np.argsort(key, kind="stable")
        s = key[order]
        same = np.zeros(len(s), bool)
        same[1:] = s[1:] == s[:-1]
        same[:-1] |= s[1:] == s[:-1]
        hit = at[order[same]]
        covered = np.zeros(len(w.starts), bool)
        for j in range(3):
            covered[hit + j] = True
        repeat = _per_text(covered, w.first)
    return {
        "n_words": w.counts, "word_chars": _per_text(
            w.inside & ((data & 0xC0) != 0x80), off,
        ), "n_symbols": _per_text(_SYM[data], off), "n_dup_lines": np.array(n_dup, np.int64), "n_repeat_words": repeat,
        "n_lines": np.array(n_lines, np.int64), "n_upper": _per_text(_UPPER[data], off), "n_alpha": _per_text(_ALPHA[data], off),
    }


def with_stats(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id, the given columns and the statistics of each whole text."""
    d = documents(docs, *columns)
    carried = [(f.name, f.dataType.simpleString()) for f in d.schema if f.name != "text"]

    def fn(batch: pa.RecordBatch) -> dict:
        return {c: batch.column(batch.schema.get_field_index(c)) for c, _ in carried} | text_stats(batch.column(batch.schema.get_field_index("text")))

    return arrow_map(d, fn, ", ".join(f"`{c}` {t}" for c, t in carried) + ", " + STATS)


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def signals() -> dict[str, F.Column]:
    ratio = lambda a, b: F.when(F.col(b) > 0, F.least(F.lit(1.0), F.col(a) / F.col(b))).otherwise(F.lit(0.0))
    return {
        "symbol_ratio": ratio("n_symbols", "word_chars"), "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "repeat_ratio": ratio("n_repeat_words", "n_words"), "upper_ratio": ratio("n_upper", "n_alpha"),
    }


def log_binom_cdf(k: int, n: int, p: float) -> float:
    """log P(X <= k), X binomial(n, p), 0 < p < 1."""
    i = np.arange(k + 1, dtype=float)
    lg = np.array([math.lgamma(x + 1) for x in i])
    rest = np.array([math.lgamma(n - x + 1) for x in i])
    t = math.lgamma(n + 1) - lg - rest + i * math.log(p) + (n - i) * math.log1p(-p)
    top = t.max()
    return float(top + math.log(np.exp(t - top).sum()))


def allowed_rejections(n: int, risk: float, alpha: float) -> int:
    """The most rejected of n good ones for which the exact upper confidence bound (level 1 - alpha) is at most `risk`; -1: not even none."""
    if n <= 0 or n * math.log1p(-risk) > math.log(alpha):
        return -1
    lo, hi = 0, int(n * risk)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if log_binom_cdf(mid, n, risk) <= math.log(alpha):
            lo = mid
        else:
            hi = mid - 1
    return lo


def choose_cutoffs(counts: dict[tuple[str, str], np.ndarray], risk: float, delta: float, tests: int | None = None) -> dict[tuple[str, str], float]:
    """counts[stratum, signal]: (2, GRID + 1) documents by label and bin. Reject where the signal is >= the cutoff. `tests`: among how many `delta` is divided, if not only these."""
    if not counts:
        return {}
    each, alpha = risk / len(SIGNALS), delta / (tests or len(counts))
    out = {}
    for key, c in sorted(counts.items()):
        bad, good = c[0][::-1].cumsum()[::-1], c[1][::-1].cumsum()[::-1]
        most, best = allowed_rejections(int(good[0]), each, alpha), 0.0
        for i in range(GRID, 0, -1):
            if good[i] > most:
                break
            gain = bad[i] / max(1, bad[0]) - GOOD_WEIGHT * good[i] / max(1, good[0])
            if gain > best:
                out[key], best = i / GRID, gain
    return out


def _stratum(stratum: str) -> F.Column:
    return F.coalesce(F.col(stratum).cast("string"), F.lit(""))


def learn_cutoffs(stats: DataFrame, labels: DataFrame, stratum: str, risk: float, delta: float) -> DataFrame:
    """s, and for each signal the bin from which on documents of that stratum are rejected (null: none)."""
    lab = labels.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("q"),
    ).where("doc_id is not null and q in (0, 1)").groupBy("doc_id").agg(F.max("q").alias("q"))
    rows = stats.where(~base_failed()).join(lab, "doc_id").select(_stratum(stratum).alias("s"), "q", F.explode(F.array(*[F.struct(F.lit(k).alias("signal"), F.floor(v * GRID).cast("int").alias("bin")) for k, v in signals().items()])).alias("x"))
    got = materialize(rows.groupBy("s", "q", "x.signal", "x.bin").count(), "quality-counts")
    tests = got.select("s", "signal").distinct().count()
    each = got.groupBy("s", "signal").agg(F.collect_list(F.struct("q", "bin", "count")).alias("counts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: dict[tuple[str, str], np.ndarray] = {}
            for s, signal, listed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                c = counts[s, signal] = np.zeros((2, GRID + 1), np.int64)
                for x in listed:
                    c[x["q"], min(GRID, x["bin"])] += x["count"]
            found = choose_cutoffs(counts, risk, delta, tests)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()),
                    pa.array([round(c * GRID) for c in found.values()], pa.int32())
                ],
                names=["s", "signal", "cut"],
            )

    cuts = each.select("s", "signal", "counts").mapInArrow(run, "s string, signal string, cut int")
    return materialize(
        cuts.groupBy("s").agg(*[F.max(F.when(F.col("signal") == k, F.col("cut"))).alias(f"_cut_{k}") for k in SIGNALS]),
        "quality-cutoffs",
    )


def judge(stats: DataFrame, cutoffs: DataFrame, stratum: str) -> DataFrame:
    """Adds base_failed, failed_rules and kept."""
    sig = signals()
    both = stats.withColumn("_s", _stratum(stratum)).join(small(cutoffs.withColumnRenamed("s", "_s")), "_s", "left")
    failed = F.array_compact(F.array(*[F.when(F.floor(sig[k] * GRID) >= F.col(f"_cut_{k}"), F.lit(k)) for k in sorted(SIGNALS)]))
    both = both.withColumn("base_failed", base_failed()).withColumn("failed_rules", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed_rules") == 0),
    )
    return both.select(*stats.columns, "base_failed", "failed_rules", "kept")


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.05, delta: float = 0.05, th: bool = False) -> DataFrame:
    """One row per document: doc_id, the stratum, the statistics, base_failed, failed_rules and kept; with `th` also a hash of its text."""
    stats = materialize(with_stats(docs, stratum, *[F.xxhash64(F.col("text").cast("string")).alias("th")] * th), "quality")
    return judge(stats, learn_cutoffs(stats, labels, stratum, risk, delta), stratum)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.array_join("failed_rules", ",").alias("failed_rules"),
    )


OP9_SQL = r"""
with d as (select doc_id, coalesce(lang, '') as s, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
line as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
word as (select doc_id, unnest(range(1, len(w) + 1)) as pos, unnest(w) as word from d),
gram as (select doc_id, pos, word, lead(word) over o as b, lead(word, 2) over o as c from word window o as (partition by doc_id order by pos)),
often as (select doc_id, pos, case when c is not null and count(*) over (partition by doc_id, word, b, c) > 1 then 1 else 0 end as hit from gram),
cover as (select doc_id, max(hit) over (partition by doc_id order by pos rows between 2 preceding and current row) as hit from often),
rep as (select doc_id, sum(hit) as n from cover group by doc_id),
t as (select doc_id, s, cast(len(w) as bigint) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
  cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols, cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines,
  cast(coalesce(rep.n, 0) as bigint) as n_repeat_words, len(l) as n_lines, len(regexp_extract_all(text, '[A-Z]')) as n_upper, len(regexp_extract_all(text, '[A-Za-z]')) as n_alpha
  from d join line using (doc_id) left join rep using (doc_id)),
v as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  [{'k': 'symbol_ratio', 'a': n_symbols, 'b': word_chars}, {'k': 'dup_line_ratio', 'a': n_dup_lines, 'b': n_lines},
   {'k': 'repeat_ratio', 'a': n_repeat_words, 'b': n_words}, {'k': 'upper_ratio', 'a': n_upper, 'b': n_alpha}] as x from t),
bin as (select doc_id, s, base_failed, x.k as k, case when x.b > 0 then floor(least(1.0::double, x.a / x.b) * 64) else 0 end as bin
  from (select doc_id, s, base_failed, unnest(x) as x from v)),
lab as (select doc_id, max(quality) as q from labels where quality in (0, 1) group by doc_id),
c as (select s, k, q, bin, count(*) as n from bin join lab using (doc_id) where not base_failed group by all),
tot as (select s, k, coalesce(sum(n) filter (where q = 1), 0) as good0, coalesce(sum(n) filter (where q = 0), 0) as bad0 from c group by s, k),
cut as (select s, k, i, good0, bad0, (select coalesce(sum(n), 0) from c where c.s = tot.s and c.k = tot.k and q = 1 and bin >= i) as good,
  (select coalesce(sum(n), 0) from c where c.s = tot.s and c.k = tot.k and q = 0 and bin >= i) as bad
  from tot, (select unnest(range(1, 65)) as i)),
term as (select s, k, i, sum(exp(lgamma(good0 + 1) - lgamma(j + 1) - lgamma(good0 - j + 1) + j * ln(0.05 / 4) + (good0 - j) * ln(1 - 0.05 / 4))) as cdf
  from (select *, unnest(range(0, cast(good as bigint) + 1)) as j from cut where good <= floor(good0 * 0.05 / 4)) group by s, k, i),
gain as (select s, k, i, bad / greatest(1, bad0) - 10 * good / greatest(1, good0) as gain from cut join term using (s, k, i)
  where good0 > 0 and cdf <= 0.05 / (select count(*) from tot)),
best as (select s, k, max(struct_pack(gain := gain, i := i)).i as i from gain where gain > 0 group by s, k),
bad as (select doc_id, array_to_string(list_sort(list(bin.k)), ',') as failed_rules from bin join best on bin.s = best.s and bin.k = best.k and bin >= best.i group by doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and failed_rules is null as kept, coalesce(failed_rules, '') as failed_rules
from v left join bad using (doc_id)
"""
