"""The corpus pipeline: quality rules, near-duplicate removal, decontamination, secret redaction, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last return the columns of
documents. Rows are told apart by doc_id and a hash of the text, so repeated ids with different texts stay apart.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm.common import WORD_RE, materialize, remove, small, table
from tamarack.llm.decontaminate import contained_items
from tamarack.llm.jaccard import ngram_jaccard_join
from tamarack.llm.packing import pack
from tamarack.llm.quality import quality_rules
from tamarack.llm.secrets import redact_secrets


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows (doc_id, th), a null doc_id equal to a null."""
    taken = {c.lower() for c in docs.columns}
    mark = next(c for c in (f"_th{i or ''}" for i in range(len(taken) + 1)) if c not in taken)
    d = docs.withColumn(mark, F.xxhash64(F.col("text").cast("string")))
    g = gone.select(F.col("doc_id").alias("_gone_id"), F.col("th").alias("_gone_th")).distinct()
    g = small(materialize(g, "pipeline-gone"))
    same = (d[mark] == g["_gone_th"]) & d["doc_id"].eqNullSafe(g["_gone_id"])
    return d.join(g, same, "left_anti").select(*[d[c] for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a risk-controlled cutoff reject go."""
    judged = quality_rules(docs, table(spark, sf_dir, "labels"), th=True)
    return _without(docs, judged.where(~F.col("kept")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of 5-word Jaccard similarity of at least 0.8 stays: the smallest doc_id, or of a
    component without doc_id any one. Documents without words stay, repeated ones too."""
    rows = materialize(ngram_jaccard_join(docs, k=5, pct=80), "pipeline-groups")
    grouped = rows.where("n_shingles > 0")
    order = F.struct(F.col("doc_id").isNull().alias("anonymous"), "doc_id", "th")
    first = grouped.groupBy("component").agg(F.min(order).alias("first"))
    first = materialize(first.select("component", F.col("first.doc_id").alias("first_id"), F.col("first.th").alias("first_th")), "pipeline-first")
    gone = grouped.join(first, "component").where("not (doc_id <=> first_id) or th != first_th")
    out = _without(docs, gone)
    remove(first)
    if grouped.groupBy("doc_id", "th").count().where("count > 1").limit(1).count():
        worded = F.coalesce(F.col("text").cast("string").rlike(WORD_RE), F.lit(False))
        out = out.where(worded).dropDuplicates(["doc_id", "text"]).union(out.where(~worded))
    remove(rows)
    return out


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go, each row judged on its own text, also without doc_id."""
    row = F.concat_ws(":", F.xxhash64(F.col("text").cast("string")).cast("string"), F.col("doc_id").cast("string"))
    leaks = contained_items(docs.select("text", row.alias("row")), table(spark, sf_dir, "benchmark"), key="row", kind="string")
    part = F.split("row", ":")
    out = _without(docs, leaks.select(F.get(part, 1).cast("long").alias("doc_id"), F.get(part, 0).cast("long").alias("th")))
    remove(leaks)
    return out


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are masked; every document stays."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a packed sequence."""
    r = pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return r.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality), ("ngram_jaccard_join", near_duplicates), ("decontamination", decontaminate),
    ("secret_scan", secrets), ("packing", packing),
]

#: SQL can't express the stages; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces. Each stage's documents are removed when the next ones are written, but for the last."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        remove(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
