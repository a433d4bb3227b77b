"""Texts that contain names, by automata; rule tables of any size, by a literal of each pattern.

Names meet texts in blocks of BLOCK_NAMES, each an Aho-Corasick automaton that every task builds once: a text is read once a
block, whatever the number of names in it. Rules are rows: each pattern's longest mandatory literal is looked for first, and
only the patterns whose literal a text has are matched against it. Patterns without such a literal are matched against all texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions.text import SEVERITIES
from ..sources.tables import keep, small
from .enforcement import SCAN_CHARS, literals, usable

BLOCK_NAMES = 50_000
#: Least characters of a literal that is worth a lookup.
LEAST_LITERAL = 3
#: Characters that ignoring case makes equal to an ASCII letter, and those letters.
LIKE_ASCII = ("ıİſK", "iisk")


def _blocks(names: DataFrame, most: int) -> Iterator[list[str]]:
    """The distinct names in blocks, one of which is on the driver at a time."""
    names = keep(names.where("name is not null and name != ''").select("name").distinct(), "names")
    parts = max(1, -(-5 * names.count() // (4 * most)))
    for i in range(parts):
        yield [r.name for r in names.where(F.pmod(F.xxhash64("name"), F.lit(parts)) == i).collect()]


def found_names(texts: DataFrame, names: DataFrame, most: int = BLOCK_NAMES) -> list[DataFrame]:
    """For each block of names (name), texts (any columns, text) with found, the names of the block that the text contains."""
    schema = StructType([*texts.schema.fields, StructField("found", ArrayType(StringType()))])
    at = texts.columns.index("text")

    def scan(block: list[str]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for i, name in enumerate(block):
                automaton.add_word(name, i)
            automaton.make_automaton()
            for b in batches:
                hits = [sorted({i for _, i in automaton.iter(t)}) if t and block else [] for t in b.column(at).to_pylist()]
                found = pa.array([[block[i] for i in h] for h in hits], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*b.columns, found], names=schema.fieldNames())

        return texts.mapInArrow(run, schema)

    return [scan(block) for block in _blocks(names, most)]


def contained(texts: DataFrame, names: DataFrame, most: int = BLOCK_NAMES) -> DataFrame:
    """id and name of each text (id, text) and name (name) that it contains, each once. Null and empty names are in no text."""
    each = [x.select("id", F.explode("found").alias("name")) for x in found_names(texts.select("id", "text"), names, most)]
    out = each[0]
    for more in each[1:]:
        out = out.unionByName(more)
    return out.distinct()


def literal(pattern: str) -> str:
    """The longest run of ASCII characters, in lower case, that every match of the pattern has; empty if none is sure."""
    best = max(reversed(literals(pattern) or [""]), key=len)
    return best if len(best) >= LEAST_LITERAL else ""


def rulebook(rules: DataFrame) -> DataFrame:
    """rules: rule_id, severity, forbid and require (arrays of patterns). One row for each pattern that can be used: rule_id,
    severity (an unknown one is critical), forbidden, pattern, literal."""
    level = F.lower(F.coalesce("severity", F.lit("")))
    r = rules.select("rule_id", F.when(level.isin(*SEVERITIES), level).otherwise("critical").alias("severity"), "forbid", "require")
    side = lambda c, f: r.select("rule_id", "severity", F.lit(f).alias("forbidden"), F.explode(c).alias("pattern"))
    rows = side("forbid", True).union(side("require", False)).where("pattern is not null")
    schema = StructType([*rows.schema.fields, StructField("literal", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            patterns = b.column("pattern").to_pylist()
            sure = pa.array([literal(p) if usable(p) else None for p in patterns], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, sure], names=schema.fieldNames())

    return rows.mapInArrow(run, schema).where("literal is not null")


def _folded(text: Column) -> Column:
    return F.lower(F.translate(text, *LIKE_ASCII))


def check(texts: DataFrame, rules: DataFrame, most: int = BLOCK_NAMES) -> DataFrame:
    """texts: id, text; rules as for rulebook(). id, rule_id, severity and evidence of each forbidden pattern that a text has (what
    matched) and each required one that it lacks, as enforcement.findings() tells for rules in the plan. The plan's size doesn't
    depend on the number of rules."""
    book = keep(rulebook(rules), "rulebook")
    t = texts.select("id", F.substring(F.coalesce("text", F.lit("")), 1, SCAN_CHARS).alias("_t")).withColumn("text", _folded(F.col("_t")))
    hit = F.expr("_t rlike concat('(?iuU)', pattern)")
    what = F.expr("regexp_extract(_t, concat('(?iuU)', pattern), 0)")
    missing = F.concat(F.lit("missing /"), "pattern", F.lit("/"))
    keyed, other = book.where("literal != ''"), small(book.where("literal = ''"))
    entry = lambda evidence: ["id", "rule_id", "severity", evidence.alias("evidence")]
    out = t.join(other.where("forbidden"), hit).select(*entry(what))
    out = out.unionByName(t.join(other.where("not forbidden"), ~hit).select(*entry(missing)))
    forbidden = small(keyed.where("forbidden").withColumnRenamed("literal", "name"))
    for found in found_names(t, keyed.where("forbidden").select(F.col("literal").alias("name")), most):
        rows = found.where(F.size("found") > 0).select("id", "_t", F.explode("found").alias("name")).join(forbidden, "name").where(hit)
        out = out.unionByName(rows.select(*entry(what)))
    lacks = ~(F.contains("text", "literal") & hit)  # every text that lacks a required pattern is a row of the result
    return out.unionByName(t.join(small(keyed.where("not forbidden")), lacks).select(*entry(missing)))
