"""WARC archives: writing, and reading by boundary-chain verification (operator 1).

Writing. Each page becomes one record. Of pages with equal payloads of at least `min_bytes`, the one with the largest
page_id is written in full (response), the others as revisit records that name it; smaller payloads are always written
in full. Spark's text writer writes the files, with a record's closing CR LF CR LF as its line separator, so any file
system that Spark reaches will do.

Reading. Spark's text reader splits each archive at the version line, wherever its splits fall; the pieces tile the file,
so prefix sums of their lengths give offsets. Each piece with a header is a candidate: its Content-Length points to its
successor, which must be another candidate or the end of the file. Payloads may hold the version line or whole fake
records, so a candidate counts only if it is reachable from its file's start: within a split the pointers are followed
locally and shortened to where they leave the split; across splits pointer jumping doubles the reach each round. A
payload that was cut at a version line inside it is put together again from its pieces.

Defined cases: a null or empty payload has length 0; a null page_id counts as smaller than any other; repeated rows each
get a record, all with the largest page_id being responses; CR, LF and blanks in URLs are percent-encoded; an empty table
gives an empty result; extra columns are ignored. A file that doesn't start with a record yields none. A record that is
cut off by the file's end, claims more bytes than there are, or is followed by something else than a record is not
returned, nor is what comes after it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, new_path, remove, remove_path, table

VERSION = "WARC/1.1\r\n"
END = "\r\n\r\n"
MIN_BYTES = 1000


def write_warc(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES) -> None:
    """pages: page_id, url, html."""
    p = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    p = p.withColumn("bytes", F.octet_length("html")).withColumn("digest", F.sha1("html"))
    keep = p.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(
        F.max("page_id").alias("keep"), F.count("*").alias("c"),
    ).where("c > 1 and keep is not null").drop("c")
    keep = materialize(keep, "warc-copies")
    p = p.join(keep, "digest", "left").withColumn(
        "revisit", F.expr(f"keep is not null and bytes >= {min_bytes} and (page_id is null or page_id < keep)"),
    )
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    uri = F.replace(F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit(" "), F.lit("%20"))
    body = F.when(F.col("revisit"), F.lit("")).otherwise(F.col("html"))
    record = F.concat(
        F.lit(VERSION), line(
            "WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response")),
        ), line("WARC-Record-ID", urn(F.col("page_id"))), line("WARC-Date", F.lit("2024-01-01T00:00:00Z")), line("WARC-Target-URI", uri),
        F.when(
            F.col("revisit"),
            F.concat(
                line("WARC-Refers-To", urn(F.col("keep"))),
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            ),
        ).otherwise(F.lit("")),
        line(
            "WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")),
        ), line("X-Payload-Length", F.col("bytes").cast("string")), line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.octet_length(body).cast("string")), F.lit("\r\n"), body,
    )
    p.select(record.alias("value")).write.option("lineSep", END).option("compression", "none").text(path)
    remove(keep)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """What lies before, between and after version lines: file, end (the file's size), block (the split's start), at (order in it), size, value."""
    raw = spark.read.option("lineSep", VERSION).text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("end"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"),
        F.octet_length("value").cast("long").alias("size"), "value",
    )


def _offsets(p: DataFrame) -> DataFrame:
    """Adds off, where the piece's version line starts (a file's first piece, which has none, gets -len(VERSION))."""
    n = len(VERSION)
    own = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = p.groupBy("file", "block").agg(F.sum(F.col("size") + n).alias("total")).withColumn(
        "base", F.coalesce(F.sum("total").over(before), F.lit(0)) - n,
    ).drop("total")
    return p.withColumn(
        "inner", F.coalesce(F.sum(F.col("size") + n).over(own), F.lit(0)),
    ).join(base, ["file", "block"]).withColumn("off", F.col("base") + F.col("inner")).drop("base", "inner")


def _leave(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per candidate, the first offset outside its split that its chain reaches (-1: the chain breaks off)."""
    pdf = pdf.sort_values("off")
    off, nxt, end = pdf["off"].tolist(), pdf["nxt"].tolist(), int(pdf["stop"].max())
    out: dict[int, int] = {}
    for o, x in zip(reversed(off), reversed(nxt), strict=True):
        out[o] = x if x >= end else out.get(x, -1)
    return pd.DataFrame({"file": pdf["file"], "off": off, "leave": [out[o] for o in off]})


def _mark(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per piece of a split, the reachable record that it belongs to (null: one that starts before the split)."""
    pdf = pdf.sort_values("off")
    owner, current, due = [], None, set(pdf.loc[pdf["entry"], "off"].tolist())
    for o, x in zip(pdf["off"].tolist(), pdf["nxt"].tolist(), strict=True):
        if o in due and x == x and x is not None:
            current = o
            due.add(int(x))
        owner.append(current)
    return pd.DataFrame({"file": pdf["file"], "block": pdf["block"], "off": pdf["off"], "owner": pd.array(owner, dtype="Int64")})


def _field(name: str) -> F.Column:
    return F.regexp_extract("head", rf"(?:^|\n){name}: *([^\r\n]*)", 1)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: file, off, nxt, type, record_id, refers_to_id, uri, payload_bytes and payload_digest (SHA-1 hex) of the full payload."""
    n = len(VERSION)
    p = pieces(spark, path).withColumn("head", F.substring_index("value", END, 1)).withColumn("start", F.octet_length("head") + len(END))
    length = _field("Content-Length")
    p = p.withColumn("content", F.when(F.expr(f"start <= size") & length.rlike("^[0-9]{1,18}$"), length.cast("long")))
    p = p.withColumn("whole", F.col("content").isNotNull() & (F.col("start") + F.col("content") <= F.col("size")))
    p = p.withColumn(
        "sha1",
        F.when(
            F.col("whole"),
            F.sha1(F.substring(F.col("value").cast("binary"), F.col("start") + 1, F.expr("try_cast(content as int)"))),
        ),
    )
    known = F.col("content").isNotNull()
    meta = {
        "type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to_id": "WARC-Refers-To", "uri": "WARC-Target-URI",
        "said_digest": "WARC-Payload-Digest", "said_bytes": "X-Payload-Length",
    }
    p = materialize(
        p.select(
            "file", "end", "block", "at", "size", "start", "content", "whole", "sha1",
            *[F.when(known, _field(v)).alias(k) for k, v in meta.items()]
        ),
        "warc-pieces",
    )
    p2 = materialize(_offsets(p).withColumn("nxt", F.col("off") + n + F.col("start") + F.col("content") + len(END)), "warc-offsets")
    remove(p)
    p = p2
    stop = p.groupBy("file", "block").agg(F.max(F.col("off") + F.col("size") + n).alias("stop"))
    named = p.where("content is not null and off >= 0").select("file", "block", "off", "nxt", "end")
    follows = named.select("file", F.col("off").alias("nxt")).withColumn("follows", F.lit(True))
    cand = named.join(
        follows, ["file", "nxt"], "left",
    ).where("follows or nxt = end").select("file", "block", "off", "nxt").join(stop, ["file", "block"])
    jump = materialize(cand.groupBy("file", "block").applyInPandas(_leave, "file string, off long, leave long"), "warc-pointers")
    ends = jump.select("file", F.col("leave").alias("off")).distinct()
    links = cand.select("file", "off", "nxt")
    hop = materialize(jump.join(ends.union(jump.where("off = 0").select("file", "off")).distinct(), ["file", "off"]), "warc-hops")
    reach = materialize(hop.where("off = 0").select("file", "off"), "warc-reach")
    while True:
        more = reach.join(hop, ["file", "off"]).select("file", F.col("leave").alias("off")).join(
            hop.select("file", "off"), ["file", "off"], "left_semi",
        )
        wider = materialize(reach.union(more).distinct(), "warc-reach")
        if wider.count() == reach.count():
            remove(wider)
            break
        twice = hop.join(
            hop.select("file", F.col("off").alias("leave"), F.col("leave").alias("further")), ["file", "leave"], "left",
        ).select("file", "off", F.coalesce("further", "leave").alias("leave"))
        twice = materialize(twice, "warc-hops")
        remove(hop, reach)
        hop, reach = twice, wider
    entry = p.select("file", "block", "off").join(links, ["file", "off"], "left").join(
        reach.withColumn("entry", F.lit(True)), ["file", "off"], "left",
    )
    entry = entry.select("file", "block", "off", "nxt", F.coalesce("entry", F.lit(False)).alias("entry"))
    marked = entry.groupBy("file", "block").applyInPandas(_mark, "file string, block long, off long, owner long")
    marked = materialize(marked, "warc-owners")
    remove(jump, hop, reach)
    records = marked.where("owner = off").select("file", "off").join(p, ["file", "off"])
    split = materialize(records.where("not whole").select("file", F.col("off").alias("owner"), "start", "content"), "warc-split")
    records = records.drop("block", "at", "size")
    if split.limit(1).count():
        whole = payloads(spark, path, marked, split).select("file", F.col("owner").alias("off"), F.sha1("payload").alias("joined"))
        records = records.join(whole, ["file", "off"], "left").withColumn("sha1", F.coalesce("sha1", "joined"))
    revisit = F.col("type") == "revisit"
    out = records.select(
        "file", "off", "nxt", "type", "record_id", F.when(revisit, F.col("refers_to_id")).alias("refers_to_id"), "uri",
        F.when(revisit, F.col("said_bytes").cast("long")).otherwise(F.col("content")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("said_digest", "^sha1:", "")).otherwise(F.col("sha1")).alias("payload_digest"),
    )
    out = materialize(out, "warc-records")
    remove(p, marked, split)
    return out


def payloads(spark: SparkSession, path: str, marked: DataFrame, wanted: DataFrame) -> DataFrame:
    """file, owner, payload of the wanted records (file, owner, start, content), joined from all their pieces."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = marked.groupBy("file", "block").agg(F.max("owner").alias("top")).withColumn("carried", F.max("top").over(before)).drop("top")
    owned = marked.join(carried, ["file", "block"]).select(
        "file", "off", F.coalesce("owner", "carried").alias("owner"),
    ).join(wanted, ["file", "owner"])
    parts = _offsets(
        materialize(pieces(spark, path).join(wanted.select("file").distinct(), "file", "left_semi"), "warc-values")
    ).join(owned, ["file", "off"])
    joined = parts.groupBy("file", "owner", "start", "content").agg(F.array_sort(F.collect_list(F.struct("off", "value"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda x: x["value"]), VERSION).cast("binary")
    return joined.select("file", "owner", F.substring(text, F.col("start") + 1, F.expr("try_cast(content as int)")).alias("payload"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "archive")
    write_warc(table(spark, sf_dir, "pages"), path)
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    r = read_warc(spark, path)
    remove_path(spark, path)
    return r.select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
        number("refers_to_id").alias("refers_to"),
    )


OP1_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as d from pages),
g as (select d, max(page_id) as keep from p where n >= 1000 group by d)
select page_id, cast(n as bigint) as payload_bytes, d as payload_digest,
  case when n >= 1000 and page_id < keep then 'revisit' else 'response' end as record_type,
  case when n >= 1000 and page_id < keep then keep end as refers_to
from p left join g using (d)
"""
