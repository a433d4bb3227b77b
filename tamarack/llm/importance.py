"""Importance resampling towards a target distribution, scored without exploding rows (operator 11).

Features are all runs of 1 to `runs` consecutive words, hashed into BUCKETS buckets. Higher-order functions make each
document's array of buckets, which is written once. Its counts over all documents and over the target give each bucket a
gain, the logarithm of target share over corpus share (add-one smoothing) in thousandths. The gains are one literal array
of BUCKETS entries in the plan; a document's weight is the floored mean of element_at of it over its buckets. Only bucket
totals are shuffled for the weights, at most BUCKETS rows a task.

Documents are drawn without replacement: each score is the weight plus Gumbel noise from a hash of doc_id, and the
highest scores win. Ranks are places within sorted ranges of scores, offset by the ranges' sizes, so no task sorts alone.

Defined cases: a null or empty text has no features and weight 0; documents of fewer than `least_words` words are scored,
but never drawn; a null doc_id is hashed as an empty string and comes last among equal scores; repeated rows are scored
and drawn as rows of their own; extra columns are ignored; an empty target gives smoothed gains; an empty corpus gives an
empty result.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, offsets, ordered, remove, table
from .textkit import CRC_SQL, CRC_TABLE_SQL

#: Words after lower-casing: maximal runs of a-z, 0-9 and characters beyond ASCII.
FEATURE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
SEED = 7


def words(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase)
    return F.regexp_extract_all(low, F.lit(FEATURE_WORD), F.lit(0))


def bucket_array(w: Column, runs: int = 2, buckets: int = BUCKETS) -> Column:
    """The bucket of every run of 1 to `runs` consecutive words of the array w, repeats included."""
    bucket = lambda x: (F.crc32(x) % buckets).cast("smallint" if buckets < 1 << 15 else "int")
    grams, found = w, [F.transform(w, bucket)]
    for k in range(2, runs + 1):
        left = F.greatest(F.size(w) - (k - 1), F.lit(0))
        grams = F.zip_with(F.slice(grams, F.lit(1), left), F.slice(w, F.lit(k), left), lambda a, b: F.concat(a, F.lit(" "), b))
        found.append(F.transform(grams, bucket))
    return F.concat(*found)


def bucketed(df: DataFrame, name: str, *columns: str, runs: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """columns, n_words and buckets of df (text), written once."""
    w = df.select(*columns, words(F.col("text")).alias("w"))
    return materialize(w.select(*columns, F.size("w").alias("n_words"), bucket_array(F.col("w"), runs, buckets).alias("buckets")), name)


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket; corpus and target have buckets. Totals alone are shuffled, and `buckets` rows reach the driver."""
    count = lambda df, name: df.select(F.explode("buckets").alias("b")).groupBy("b").agg(F.count("*").alias(name))
    both = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b")).join(
        F.broadcast(count(corpus, "s")), "b", "left",
    ).join(F.broadcast(count(target, "t")), "b", "left").fillna(0, ["s", "t"])
    totals = both.agg(F.sum("s").alias("s_all"), F.sum("t").alias("t_all"))  # one row
    share = F.expr(f"((t + 1D) * (s_all + {buckets}D)) / ((s + 1D) * (t_all + {buckets}D))")
    rows = both.crossJoin(F.broadcast(totals)).withColumn("gain", F.floor(F.lit(1000.0) * F.log(share)))
    return [r.gain for r in sorted(rows.select("b", "gain").collect())]


def scored(rows: DataFrame, gains: list[int], seed: int = SEED) -> DataFrame:
    """Adds n_features, weight and score to rows (doc_id, buckets)."""
    literal = F.split(F.lit(",".join(map(str, gains))), ",").cast("array<bigint>")  # folded to one literal array
    n = F.size("buckets").cast("long")
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda acc, b: acc + F.element_at(literal, b.cast("int") + 1))
    weight = F.when(n > 0, F.floor(total / n)).otherwise(F.lit(0)).cast("long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    out = rows.withColumn("n_features", n).withColumn("weight", weight)
    return out.withColumn("score", F.col("weight") + noise.cast("long"))


def importance_resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, runs: int = 2, buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """docs: doc_id, text; target: text. All documents: doc_id, n_words, n_features, weight, score, rank (null: not drawn).
    percent of the documents with `least_words` words are drawn."""
    corpus = bucketed(documents(docs), "importance-buckets", "doc_id", runs=runs, buckets=buckets)
    aim = bucketed(target.select(F.col("text").cast("string").alias("text")), "importance-target", runs=runs, buckets=buckets)
    gains = bucket_gains(corpus, aim, buckets)
    rows = materialize(scored(corpus, gains, seed).select("doc_id", "n_words", "n_features", "weight", "score"), "importance-scores")
    remove(corpus, aim)
    able = rows.where(F.col("n_words") >= least_words)
    order = able.withColumn("down", -F.col("score")).withColumn("anonymous", F.col("doc_id").isNull())
    placed = ordered(order, "importance-order", "down", "anonymous", "doc_id").drop("down", "anonymous")
    sizes = materialize(placed.groupBy("part").agg(F.count("*").alias("n")), "importance-ranges")
    n = sizes.agg(F.sum("n")).first()[0] or 0
    rank = F.col("base") + F.col("at") + 1
    ranked = placed.join(F.broadcast(offsets(sizes).select("part", "base")), "part").select(
        "doc_id", "n_words", "n_features", "weight", "score", F.when(rank <= n * percent // 100, rank).alias("rank"),
    )
    return ranked.unionByName(rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return r.select("doc_id", "n_features", "weight", "score", "rank")


OP11_SQL = rf"""
with rows_ as (
  select 0 as aim, doc_id, row_number() over () as row_id, text from documents
  union all select 1, null, row_number() over (), text from benchmark),
w as (
  select aim, doc_id, row_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from rows_),
f as (
  select aim, row_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from w),
b as (
  select f, {CRC_SQL.format(x='f')} % 10000 as b from (select distinct f from f), {CRC_TABLE_SQL}),
fb as (select aim, row_id, b from f join b using (f)),
n as (select b, count(*) filter (aim = 0) as s, count(*) filter (aim = 1) as t from fb group by b),
total as (select count(*) filter (aim = 0) as s_all, count(*) filter (aim = 1) as t_all from fb),
g as (
  select b, cast(floor(1000 * ln((t + 1)::double * (s_all + 10000)::double / ((s + 1)::double * (t_all + 10000)::double))) as bigint) as gain
  from n, total),
weight as (
  select row_id, count(*) as n, cast(floor(sum(gain)::double / count(*)) as bigint) as weight from fb join g using (b) where aim = 0 group by row_id),
h as (select row_id, doc_id, len(w) as n_words, cast('0x' || substr(sha256('7:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) as h from w where aim = 0),
scored as (
  select doc_id, n_words, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double))) as bigint) as score
  from h left join weight using (row_id)),
ranked as (
  select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id nulls last) as r,
    count(*) filter (n_words >= 20) over () as able from scored)
select doc_id, n_features, weight, score, case when n_words >= 20 and r <= able * 25 // 100 then r end as rank from ranked
"""
