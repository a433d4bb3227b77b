"""Language-model steps as injected functions, and the parsing of what they say.

A model is a function (system, prompts) -> replies, one reply or None for each prompt. Nothing here calls out on its own;
without a model the steps that need one are left out.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from .text import scrub, stripped, word_tokens

Model = Callable[[str, list[str]], list]
#: Prompts of one call, texts of one embedding call, texts of one labelling call, and characters of a text that is labelled.
CALL_ROWS, EMBED_ROWS, LABEL_ROWS, LABEL_CHARS = 96, 96, 18, 400
EMBED_CHARS, DIMENSIONS = 8000, 16
#: Fixed value: the label of what fits no other.
NO_LABEL = "DIGER"
#: The kinds of a claim: fact, prior, forecast.
CLAIMS = ("olgu", "prior", "ongoru")


def ask(rows: DataFrame, system: str, prompt: Column, model: Model, name: str = "reply", tries: int = 2) -> DataFrame:
    """rows with the model's reply to each prompt, in batches; null where it gave none after `tries` calls. Secrets are masked before."""
    schema = StructType([*rows.schema, StructField(name, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, CALL_ROWS):
                b = whole.slice(lo, CALL_ROWS)
                prompts, replies = b.column(b.num_columns - 1).to_pylist(), [None] * b.num_rows
                for _ in range(tries):
                    open_ = [i for i, r in enumerate(replies) if r is None]
                    if open_:
                        for i, r in zip(open_, model(system, [prompts[i] for i in open_]), strict=True):
                            replies[i] = r
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(replies, pa.string())], names=[*b.schema.names[:-1], name])

    return rows.withColumn("_prompt", scrub(F.coalesce(prompt, F.lit("")))).mapInArrow(run, schema)


def hash_embedding(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """A vector without a model: each word token of the scrubbed text adds or takes 1 at a place that its MD5 names; null without tokens."""
    codes = F.transform(word_tokens(F.substring(scrub(text), 1, EMBED_CHARS)), lambda t: F.md5(t))
    place = lambda h: F.pmod(F.conv(F.substring(h, 1, 4), 16, 10).cast("int"), F.lit(dimensions))
    sign = lambda h: F.when(F.substring(h, 5, 1) < "8", 1.0).otherwise(-1.0)
    zero = F.array_repeat(F.lit(0.0), dimensions)
    total = F.aggregate(codes, zero, lambda acc, h: F.transform(acc, lambda x, i: x + F.when(place(h) == i, sign(h)).otherwise(0.0)))
    return F.when(F.size(codes) > 0, total)


def embed(rows: DataFrame, text: str, provider: Callable[[list[str]], list] | None = None, name: str = "embedding") -> DataFrame:
    """rows with a vector of each text, by the provider in batches of EMBED_ROWS (blank texts are not sent and have none), or by hash_embedding."""
    if provider is None:
        return rows.withColumn(name, hash_embedding(F.col(text)))
    schema = StructType([*rows.schema, StructField(name, ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, EMBED_ROWS):
                b = whole.slice(lo, EMBED_ROWS)
                texts = b.column(b.num_columns - 1).to_pylist()
                some = [i for i, t in enumerate(texts) if t]
                vectors: list = [None] * len(texts)
                for i, v in zip(some, provider([texts[i] for i in some]) if some else [], strict=True):
                    vectors[i] = v
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(vectors, pa.list_(pa.float64()))], names=[*b.schema.names[:-1], name])

    clean = F.substring(stripped(scrub(F.coalesce(F.col(text), F.lit("")))), 1, EMBED_CHARS)
    return rows.withColumn("_text", clean).mapInArrow(run, schema)


def first_array(reply: Column) -> Column:
    """The text from the first [ to the last ], null if there is none."""
    return F.nullif(F.regexp_extract(reply, r"(?s)\[.*\]", 0), F.lit(""))


def facts(reply: Column) -> Column:
    """The texts of a JSON array, without blank ones; broken JSON: none."""
    said = F.from_json(first_array(reply), "array<string>")
    return F.coalesce(F.filter(F.transform(said, stripped), lambda x: x != ""), F.array().cast("array<string>"))


TRIPLE = "struct<subject:string,subject_type:string,predicate:string,object:string,object_type:string,fact:string>"


def triples(reply: Column) -> Column:
    """The objects of a JSON array that have a subject, a predicate and an object."""
    said = F.from_json(first_array(reply), f"array<{TRIPLE}>")
    full = lambda x: F.coalesce(x["subject"], F.lit("")).rlike(r"\S") & F.coalesce(x["predicate"], F.lit("")).rlike(r"\S") & F.coalesce(x["object"], F.lit("")).rlike(r"\S")
    return F.coalesce(F.filter(said, full), F.array().cast(f"array<{TRIPLE}>"))


def claims(reply: Column, cites: Column) -> Column:
    """Claims (text, type, source) of a JSON array, cut short ones up to the last whole object. Unknown types are priors; a
    source is the url of the cited number (cites: array of structs with a url), null beyond them."""
    kind = "array<struct<text:string,type:string,source:int>>"
    chunk = F.regexp_extract(reply, r"(?s)\[.*", 0)
    whole = F.from_json(F.regexp_extract(chunk, r"(?s)\[.*\]", 0), kind)
    repaired = F.from_json(F.concat(F.regexp_extract(chunk, r"(?s)\[.*\}", 0), F.lit("]")), kind)
    said = F.filter(F.coalesce(whole, repaired, F.array().cast(kind)), lambda x: F.coalesce(x["text"], F.lit("")) != "")
    low = lambda x: F.lower(F.trim(x["type"]))
    return F.transform(
        said,
        lambda x: F.struct(
            stripped(x["text"]).alias("text"), F.when(low(x).isin(*CLAIMS), low(x)).otherwise("prior").alias("type"),
            F.when(x["source"] >= 1, F.get(cites, x["source"] - 1)["url"]).alias("source"),
        ),
    )


def confirms(reply: Column) -> Column:
    """Whether a yes-or-no reply says yes."""
    return F.upper(stripped(reply)).rlike("^(EVET|YES)")


def match_label(said: Column, labels: Column) -> Column:
    """The label that was said, in any case, else the longest that is part of it (of equal ones the first), else null."""
    low = F.lower(F.coalesce(said, F.lit("")))
    exact = F.filter(labels, lambda x: F.lower(x) == low)
    part = F.filter(labels, lambda x: F.contains(low, F.lower(x)))
    longest = F.aggregate(part, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    return F.coalesce(F.get(exact, 0), F.nullif(longest, F.lit("")))


def _matched(said: str, labels: Sequence[str]) -> str | None:
    low = said.lower()
    part = [x for x in labels if x.lower() in low]
    return next((x for x in labels if x.lower() == low), None) or (max(part, key=len) if part else None)


def labelled(replies: str | None, n: int, labels: Sequence[str]) -> list[str]:
    """The labels of n numbered texts from a JSON array of {"n": number, "k": label}; NO_LABEL for the rest."""
    out = [NO_LABEL] * n
    found = re.search(r"\[.*\]", replies or "", re.DOTALL)
    try:
        items = json.loads(found[0]) if found else []
    except ValueError:
        items = []
    for x in items:
        at = x.get("n") if isinstance(x, dict) else None
        if isinstance(at, int) and 1 <= at <= n:
            out[at - 1] = _matched(str(x.get("k", "")).strip(), labels) or NO_LABEL
    return out


def label_texts(rows: DataFrame, text: str, labels: Sequence[str], model: Model, name: str = "label") -> DataFrame:
    """rows with one of the labels, or NO_LABEL; LABEL_ROWS numbered texts a call."""
    labels = [x.strip() for x in labels if x.strip()][:50]
    system = "Put each numbered text into the one category that fits best, or DIGER. Answer with a JSON array of {n, k}. Categories: " + ", ".join(
        labels
    )
    schema = StructType([*rows.schema, StructField(name, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, LABEL_ROWS):
                b = whole.slice(lo, LABEL_ROWS)
                texts = b.column(b.num_columns - 1).to_pylist()
                prompt = "\n".join(f"{i + 1}. {t}" for i, t in enumerate(texts))
                got = labelled(model(system, [prompt])[0] if labels else None, len(texts), labels)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(got, pa.string())], names=[*b.schema.names[:-1], name])

    clean = F.substring(scrub(F.coalesce(F.col(text), F.lit(""))), 1, LABEL_CHARS)
    return rows.withColumn("_text", F.regexp_replace(clean, r"\s*\n\s*", " ")).mapInArrow(run, schema)


def proposed_labels(reply: str | None, most: int = 20) -> list[dict[str, str]]:
    """Labels and slugs of a JSON array of {"slug", "label"}: each label once in any case, at most `most`."""
    found = re.search(r"\[.*\]", reply or "", re.DOTALL)
    try:
        items = json.loads(found[0]) if found else []
    except ValueError:
        items = []
    out: dict[str, dict[str, str]] = {}
    for x in items:
        label = str(x.get("label") or "")[:60].strip() if isinstance(x, dict) else ""
        if label and label.lower() not in out:
            slug = str(x.get("slug") or label)[:40].strip().lower().replace(" ", "-")
            out[label.lower()] = {"label": label, "slug": slug or f"k{len(out)}"}
    return list(out.values())[:most]
