"""Substring deduplication with a count-min prefilter (operator 7).

A window is `window` consecutive words of one document. A word goes if it lies in a window whose words also start in a
document with a smaller doc_id. Passes:

1. Each document's words are digested (SHA-256). Of documents with equal words only the smallest doc_id is searched
   further: all windows of the others start there too.
2. Every window is named by its minimizer, the smallest hash of its 8-word grams: equal windows have equal minimizers,
   and neighbouring windows mostly share one, so the sketch holds a small part of the windows' number. Task sketches of
   the minimizers of each document are merged; a window whose minimizer is estimated in one document only is unique.
   Up to MOST_CELLS cells the merged sketch is broadcast. A wider one is partitioned by cells: its counts and the
   documents' cells are shuffled (about 0.2 bytes a byte of text) and meet there, with the same windows as the result.
3. Only windows that are estimated repeated are grouped exactly, by two independent 64-bit hashes over all their words
   (a wrong match among 10**12 windows has a chance of about 10**-15). Nothing is lost, since the estimate never falls
   below the count.
4. Documents with a removed window are rebuilt from their texts.

Hot windows are aggregated map-side to their smallest doc_id and joined back from written tables, so a skewed join can
be split. A document's positions are gathered per document only.

Defined cases: null or empty text has no words (kept: the empty text); rows with a null doc_id neither remove nor lose
words; repeated rows of one doc_id do not remove each other's words; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sketch as cms
from .common import arrow_map, documents, materialize, release, remove, small, table
from .textkit import Words, hash_runs, sliding_min

WINDOW = 50
#: Words of the grams whose least hash names a window.
GRAM = 8
#: Cells of a sketch that is broadcast (a byte each, two rows).
MOST_CELLS = cms.MAX_WIDTH
EMPTY = hashlib.sha256(b"").hexdigest()


def _col(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _minimizers(w: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(minimizer of each window, the window's first word)."""
    gram = min(GRAM, window)
    m = len(w.hash) - window + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    doc = w.doc_of()
    ok = np.flatnonzero(doc[:m] == doc[window - 1 :])
    return sliding_min(hash_runs(w.hash, gram), window - gram + 1)[ok], ok


def _digests(docs: DataFrame) -> DataFrame:
    def fn(batch: pa.RecordBatch) -> dict:
        text = _col(batch, "text")
        words = [b.split() for b in (x.as_buffer().to_pybytes() if x.is_valid else b"" for x in text.cast(pa.large_binary()))]
        return {
            "doc_id": _col(batch, "doc_id"), "th": _col(batch, "th"), "n_words": [len(x) for x in words],
            "digest": [hashlib.sha256(b" ".join(x)).hexdigest() for x in words]
        }

    return arrow_map(docs, fn, "doc_id long, th long, n_words long, digest string")


def _distinct(w: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, minimizer), each once, by document."""
    m, at = _minimizers(w, window)
    if not len(m):
        return np.zeros(0, np.int64), m
    doc = w.doc_of()[at]
    order = np.lexsort((m, doc))
    m, doc = m[order], doc[order]
    first = np.ones(len(m), bool)
    first[1:] = (m[1:] != m[:-1]) | (doc[1:] != doc[:-1])
    return doc[first], m[first]


def _chosen(batch: pa.RecordBatch, w: Words, at: np.ndarray) -> dict:
    """The texts that have chosen windows (first words at), and these windows' positions."""
    edge = np.searchsorted(at, w.first)
    rows = np.flatnonzero(np.diff(edge))
    keep = pa.array(rows)
    return {c: _col(batch, c).take(keep) for c in ("doc_id", "th", "text")} | {"at": [at[edge[d] : edge[d + 1]] - w.first[d] for d in rows]}


_SUSPECTS = "doc_id long, th long, text string, at array<int>"


def _suspects(docs: DataFrame, window: int, cells: int) -> DataFrame:
    """Documents with windows that may be repeated, by a broadcast sketch: their text, and the positions of those windows."""
    filt = docs.sparkSession.sparkContext.broadcast(cms.build(docs, lambda b: _distinct(Words(_col(b, "text")), window)[1], cells, depth=2))

    def fn(batch: pa.RecordBatch) -> dict:
        w = Words(_col(batch, "text"))
        m, at = _minimizers(w, window)
        return _chosen(batch, w, at[filt.value.estimate(m) >= 2])

    return arrow_map(docs, fn, _SUSPECTS)


def _suspects_by_cells(docs: DataFrame, window: int, cells: int) -> DataFrame:
    """As _suspects, by a sketch that is partitioned by its cells."""

    def used(batch: pa.RecordBatch) -> dict:
        w = Words(_col(batch, "text"))
        doc, m = _distinct(w, window)
        cell = cms.cells(m, 0, cells).view(np.int64)
        edge = np.searchsorted(doc, np.arange(len(w) + 1))
        return {"doc_id": _col(batch, "doc_id"), "th": _col(batch, "th"), "cells": [cell[edge[d] : edge[d + 1]] for d in range(len(w))]}

    each = arrow_map(docs, used, "doc_id long, th long, cells array<long>").select("doc_id", "th", F.explode("cells").alias("cell"))
    each = materialize(each, "substring-cells")
    counts = materialize(each.groupBy("cell").count().where("count > 1").select("cell"), "substring-counts")
    hits = each.join(counts, "cell").groupBy("doc_id", "th").agg(F.collect_set("cell").alias("cells"))

    def fn(batch: pa.RecordBatch) -> dict:
        w = Words(_col(batch, "text"))
        m, at = _minimizers(w, window)
        cell, doc, listed = cms.cells(m, 0, cells), w.doc_of()[at], _col(batch, "cells")
        edge = np.searchsorted(doc, np.arange(len(w) + 1))
        hit = [np.isin(cell[edge[d] : edge[d + 1]], listed[d].values.to_numpy().view(np.uint64)) for d in range(len(w))]
        return _chosen(batch, w, at[np.concatenate(hit)] if hit else at)

    found = materialize(arrow_map(docs.join(hits, ["doc_id", "th"]), fn, _SUSPECTS), "substring-suspects")
    remove(each, counts)
    return found


def _hashed(found: DataFrame, window: int) -> DataFrame:
    """One row per suspected window. Its 128 bits of hash do not compress, so they are computed anew for each use, not written."""

    def fn(batch: pa.RecordBatch) -> dict:
        w = Words(_col(batch, "text"))
        h1, at = w.grams(window)
        h2, _ = w.grams(window, seed=1)
        positions = _col(batch, "at")
        n = np.diff(positions.offsets.to_numpy())
        doc = np.repeat(np.arange(len(n)), n)
        start = positions.flatten().to_numpy()
        i = np.searchsorted(at, start + w.first[doc])
        return {
            "doc_id": _col(batch, "doc_id").take(pa.array(doc)), "th": _col(batch, "th").take(pa.array(doc)),
            "at": start, "h1": h1[i].view(np.int64), "h2": h2[i].view(np.int64),
        }

    return arrow_map(found, fn, "doc_id long, th long, at int, h1 long, h2 long")


def _rebuild(docs: DataFrame, window: int) -> DataFrame:
    def fn(batch: pa.RecordBatch) -> dict:
        removed, kept = [], []
        for text, at in zip(_col(batch, "text").to_pylist(), _col(batch, "starts").to_pylist(), strict=True):
            words = text.encode().split()
            n = np.zeros(len(words) + 1, np.int64)
            starts = np.unique(np.asarray(at, np.int64))
            n[starts] += 1
            n[starts + window] -= 1
            gone = np.cumsum(n[:-1]) > 0
            removed.append(int(gone.sum()))
            kept.append(b" ".join([words[i] for i in np.flatnonzero(~gone)]).decode())
        return {"doc_id": _col(batch, "doc_id"), "th": _col(batch, "th"), "n_removed": removed, "kept_text": kept}

    return arrow_map(docs, fn, "doc_id long, th long, n_removed long, kept_text string")


def substring_dedup(docs: DataFrame, window: int = WINDOW, most_cells: int = MOST_CELLS) -> DataFrame:
    """doc_id, n_words, n_removed, digest (SHA-256 of all words) and kept_text (null: nothing, or everything, was removed)."""
    d = documents(docs).withColumn("th", F.xxhash64("text"))
    base = materialize(_digests(d), "substring-base")
    long_enough = base.where((F.col("n_words") >= window) & F.col("doc_id").isNotNull())
    first = materialize(
        long_enough.groupBy("digest").agg(
            F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"),
        ).where("rep < last").drop("last"),
        "substring-copies",
    )
    marked = materialize(
        base.join(first, "digest", "left").withColumn(
            "copy", F.coalesce(F.col("rep") < F.col("doc_id"), F.lit(False)),
        ).drop("rep"),
        "substring-marked",
    )
    remove(base, first)
    copies = materialize(marked.where("copy").select("doc_id", "th").distinct(), "substring-gone")
    searched = d.where(F.col("doc_id").isNotNull()).join(small(copies), ["doc_id", "th"], "left_anti")
    words = marked.agg(F.sum("n_words")).first()[0] or 0
    cells = cms.width_for(4 * words * 2 / (window - GRAM + 2), most=None)
    found = materialize(
        _suspects(searched, window, cells), "substring-suspects",
    ) if cells <= most_cells else _suspects_by_cells(searched, window, cells)
    rows = _hashed(found, window)
    least = materialize(
        rows.groupBy("h1", "h2").agg(
            F.min("doc_id").alias("least"), F.max("doc_id").alias("most"),
        ).where("least < most").drop("most"),
        "substring-windows",
    )
    release(d.sparkSession)
    starts = rows.join(least, ["h1", "h2"]).where("least < doc_id").groupBy("doc_id", "th").agg(F.collect_list("at").alias("starts"))
    part = _rebuild(found.select("doc_id", "th", "text").dropDuplicates(["doc_id", "th"]).join(starts, ["doc_id", "th"]), window)
    part = materialize(part, "substring-parts")
    remove(found, least, copies)
    out = marked.join(part, ["doc_id", "th"], "left")
    n = F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    return out.select("doc_id", "n_words", n.cast("long").alias("n_removed"), "digest", "kept_text")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = substring_dedup(table(spark, sf_dir, "documents"))
    sha = F.when(F.col("n_removed") == 0, F.col("digest")).when(
        F.col("n_removed") == F.col("n_words"), F.lit(EMPTY),
    ).otherwise(F.sha2(F.col("kept_text").cast("binary"), 256))
    return r.select("doc_id", "n_words", "n_removed", sha.alias("kept_sha256"))


OP7_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, i as pos, array_to_string(w[i:i + 49], ' ') as win from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d)),
least as (select win, min(doc_id) as rep from win group by win),
hit as (select distinct doc_id, pos from win join least using (win) where rep < doc_id),
word as (select doc_id, unnest(range(1, len(w) + 1)) as pos, unnest(w) as word from d),
gone as (select doc_id, pos, word, max(case when hit.pos is null then 0 else 1 end) over (partition by doc_id order by pos rows between 49 preceding and current row) as gone
  from word left join hit using (doc_id, pos)),
kept as (select doc_id, sum(gone) as n_removed, string_agg(word, ' ' order by pos) filter (where gone = 0) as kept from gone group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join kept using (doc_id)
"""
