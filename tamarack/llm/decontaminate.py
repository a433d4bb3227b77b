"""Benchmark decontamination by size-partitioned MinHash containment search (operator 2), DataFrame functions only.

Items and documents are sets of `k`-word shingles of lower-cased words. A document contains an item if it has at least
the share `threshold` of the item's distinct shingles.

1. Items are partitioned by size into classes of a power of two. An item's signature is its bottom MinHash values: twice
   as many as an item of its class can miss and still be contained, plus two (all, of a short item). So a document that
   contains an item holds at least the signature's size less the item's own allowance of misses, however long the
   document is: that is the class's threshold, and no miss is possible.
2. Documents are scanned once, and only signature values are looked for: by a bit table of them, a constant that grows
   with the benchmark up to BIT_WORDS longs. The signature values of a larger benchmark are broadcast in blocks of
   BROADCAST_ROWS instead, each of which meets all documents' shingle hashes where they are; hits alone are shuffled.
3. Search: hits are counted per document and item, and pairs below the class's threshold go.
4. Verification: the candidates' texts alone are read again; their shingles are compared as strings with the items', and
   the exact containment decides.

Defined cases: texts that are null or shorter than k words have no shingles, so they contain nothing, and such items are
contained in nothing; documents with a null doc_id are not reported; rows that share a doc_id or item_id are judged as
one set; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import BROADCAST_ROWS, in_blocks
from .common import materialize, remove, small, table

K, THRESHOLD = 5, 0.8
#: The bit table has at least LEAST_WORDS 64-bit words, 32 bits or more for each signature value, and at most BIT_WORDS (2 MB).
LEAST_WORDS, BIT_WORDS = 1 << 10, 1 << 18
#: Shingles of items (some 60 bytes each) up to which they are broadcast.
BROADCAST_SHINGLES = 200_000


def _words(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.col(text).cast("string")), r"[\x20\x09-\x0D]+"), "")


def _with_hashes(df: DataFrame, key: str, k: int, kind: str = "long") -> DataFrame:
    """key, words and hashes, one for each run of k words.

    No filter refers to words or hashes, here or later: it would be pushed below and compute them twice. For the same
    reason their callers use explode_outer, for which no filter is inferred.
    """
    w = df.where(F.col(key).isNotNull()).select(F.col(key).cast(kind).alias(key), _words("text").alias("words"))
    at = F.when(F.size("words") >= k, F.sequence(F.lit(0), F.size("words") - k))
    return w.withColumn("hashes", F.transform(at, lambda i: F.xxhash64(*[F.get("words", i + j) for j in range(k)])))


def _shingle(i: Column, k: int) -> Column:
    return F.array_join(F.slice("words", i + 1, k), " ")


def item_shingles(items: DataFrame, k: int, threshold: float) -> DataFrame:
    """item_id, h, shingle, n (distinct shingles), signature (whether h is one of its bottom MinHash values), at_least (of them in a document that contains the item)."""
    rows = _with_hashes(items, "item_id", k)
    each = rows.select(
        "item_id",
        F.explode_outer(
            F.transform("hashes", lambda h, i: F.struct(h.alias("h"), _shingle(i, k).alias("shingle")))
        ).alias("x"),
    ).select("item_id", "x.h", "x.shingle").where("h is not null").distinct()
    item = Window.partitionBy("item_id")
    each = each.withColumn("n", F.count("*").over(item)).withColumn("rank", F.row_number().over(item.orderBy("h", "shingle")))
    largest = F.pow(F.lit(2.0), F.floor(F.log2("n")) + 1) - 1
    size = F.least(F.col("n"), 2 * (F.floor((1 - threshold) * largest + 1e-9) + 1))
    misses = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9)
    return each.withColumn("signature", F.col("rank") <= size).withColumn("at_least", size - misses).drop("rank")


def _bit_table(hashes: DataFrame, most: int) -> tuple[Column, int] | None:
    """A constant array of longs with a bit for each hash, and its length; None if that would be over `most`."""
    count, words = hashes.count(), LEAST_WORDS
    while 64 * words < 32 * count:
        words *= 2
    if words > most:
        return None
    rows = hashes.select(
        F.shiftright("h", 6).bitwiseAND(words - 1).cast("int").alias("w"),
        F.expr("shiftleft(1L, cast(h & 63 as int))").alias("b"),
    ).groupBy("w").agg(F.bit_or("b").alias("b")).collect()
    bits = [0] * words
    for r in rows:
        bits[r.w] = r.b
    return F.split(F.lit(",".join(map(str, bits))), ",").cast("array<bigint>"), words


def _signature_hits(docs: DataFrame, signatures: DataFrame, key: str, k: int, kind: str, most: int, block: int) -> DataFrame:
    """key, h: hashes of a document's shingles that may be signature values."""
    d, found = _with_hashes(docs, key, k, kind), _bit_table(signatures.select("h").distinct(), most)
    if not found:  # each block of signature values is broadcast to the documents: only hits are shuffled
        each = d.select(key, F.explode_outer(F.array_distinct("hashes")).alias("h")).where("h is not null")
        blocks = in_blocks(signatures.select("h").distinct(), "h", block)
        return materialize(reduce(DataFrame.union, [each.join(b, "h", "left_semi").select(key, "h") for b in blocks]), "leak-hits")
    bits, words = found
    is_set = lambda h: F.getbit(F.get(bits, F.shiftright(h, 6).bitwiseAND(words - 1).cast("int")), h.bitwiseAND(63).cast("int")) == 1
    hit = F.array_distinct(F.filter("hashes", is_set))
    return materialize(d.select(key, F.explode_outer(hit).alias("h")).where("h is not null"), "leak-hits")


def contained_items(
    docs: DataFrame, items: DataFrame, k: int = K, threshold: float = THRESHOLD, key: str = "doc_id",
    kind: str = "long", bit_words: int = BIT_WORDS, block: int = BROADCAST_ROWS,
) -> DataFrame:
    """One row per document and item that it contains: `key`, item_id, matched, item_shingles, containment. `key` (of type `kind`) tells documents apart."""
    shingles = materialize(item_shingles(items, k, threshold), "leak-items")
    signatures = shingles.where("signature").select("h", "item_id", "at_least").distinct()
    hits = _signature_hits(docs, signatures, key, k, kind, bit_words, block)
    # Items whose shingles share a hash count it once on either side, so such an item asks for one hit less.
    wanted = shingles.where("signature").groupBy("item_id").agg(
        F.min("at_least").alias("least"), (F.count("*") - F.count_distinct("h")).alias("twins"),
    )
    found = hits.distinct().join(signatures, "h").groupBy(key, "item_id").agg(
        F.count("*").alias("hits")
    ).join(small(wanted), "item_id").where("hits >= least - twins")
    found = materialize(found.select(key, "item_id"), "leak-candidates")
    some = docs.where(F.col(key).isNotNull()).select(F.col(key).cast(kind).alias(key), "text").join(small(found.select(key).distinct()), key)
    held = _with_hashes(some, key, k, kind)
    held = held.select(
        key, F.explode_outer(F.array_distinct(F.transform("hashes", lambda h, i: _shingle(i, k)))).alias("shingle"),
    ).where("shingle is not null")
    known = small(shingles.select("item_id", "shingle", "n"), BROADCAST_SHINGLES)
    same = held.join(known, "shingle").join(small(found), [key, "item_id"], "left_semi").distinct()
    out = materialize(
        same.groupBy(key, "item_id").agg(F.count("*").alias("matched"), F.max("n").alias("item_shingles")).where(
            F.col("matched") >= F.ceil(F.col("item_shingles") * threshold - 1e-9)
        ),
        "leaks",
    )
    remove(shingles, hits, found)
    share = out.withColumn("containment", F.col("matched") / F.col("item_shingles"))
    share.tamarack_path = out.tamarack_path
    return share


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SHINGLES = "unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))"
OP2_SQL = rf"""
with i as (select item_id, list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from benchmark),
d as (select doc_id, list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
si as (select distinct item_id, {_SHINGLES} as s from i),
n as (select item_id, count(*) as n from si group by item_id),
sd as (select distinct doc_id, {_SHINGLES} as s from d where doc_id is not null)
select doc_id, item_id, count(*) as matched, any_value(n) as item_shingles, count(*) / any_value(n) as containment
from sd join si using (s) join n using (item_id)
group by doc_id, item_id having count(*) * 5 >= any_value(n) * 4
"""
