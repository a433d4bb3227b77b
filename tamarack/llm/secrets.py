"""Secret scanning by a trigram index (operator 4).

Each rule's regular expression is parsed into a Boolean query of trigrams that any match must contain: literal runs,
small classes and optional parts are expanded to the strings they can spell; alternatives become OR, what follows one
another becomes AND. Blocks of documents (one run of a few MB of text each) get an inverted index of the trigrams that
some query names; postings are intersected and united as the queries say, and only the remaining documents are verified
with the regular expression itself over their whole text. A rule without mandatory trigrams scans every text.

The index folds ASCII case, which only widens the candidates. A block's index lives in the task that scans the block, so
nothing is shuffled and nothing grows with the table.

Defined cases: null text is empty; repeated rows and null doc_id are scanned like any other; extra columns are ignored;
an empty table gives an empty result. Offsets are in code points, ends exclusive; a kind's matches don't overlap, but
spans of different kinds may.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as C  # the parser's opcodes
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, documents, table
from .textkit import LOWER, text_buffer


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    flags: int = re.ASCII
    group: int = 0
    #: Matches whose group is shorter are dropped (after they have consumed their text).
    least: int = 1


#: The base rules' patterns. A run of [0-9a-f] of 24 or more is what [0-9a-f]+ finds, less the short ones.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", re.ASCII, 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", re.ASCII, 0, 24),
)
EXTRA_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE_RULES + EXTRA_RULES
#: Strings and characters up to which a part of a pattern is expanded.
MOST_STRINGS, MOST_CHARS = 64, 16

# A query is True (anything), a trigram, or ("and" | "or", [queries]).


def _both(kind: str, parts: list) -> object:
    if kind == "and":
        parts = [p for p in parts if p is not True]
        return True if not parts else parts[0] if len(parts) == 1 else ("and", parts)
    return True if any(p is True for p in parts) else parts[0] if len(parts) == 1 else ("or", parts)


def _spelled(strings: set[str]) -> object:
    """The query of a text that holds one of these strings."""
    each = []
    for s in sorted(strings):
        s = s.lower()
        if len(s) < 3 or not s.isascii():
            return True
        each.append(_both("and", sorted({s[i : i + 3] for i in range(len(s) - 2)})))
    return _both("or", each)


def _characters(items: list) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is C.LITERAL:
            out.add(chr(arg))
        elif op is C.RANGE and arg[1] - arg[0] < MOST_CHARS:
            out |= {chr(c) for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= MOST_CHARS else None


def _analyse(tree) -> tuple[set[str] | None, object]:
    """(all strings it can spell, or None if too many; the trigram query of its matches)."""
    exact: set[str] | None = {""}
    run: set[str] = {""}
    queries: list = []

    def cut() -> None:
        nonlocal exact, run
        queries.append(_spelled(run))
        exact, run = None, {""}

    for op, arg in tree:
        query: object = True
        if op is C.LITERAL:
            part = {chr(arg)}
        elif op is C.IN:
            part = _characters(arg)
        elif op is C.SUBPATTERN:
            part, query = _analyse(arg[3])
        elif op is C.BRANCH:
            branches = [_analyse(b) for b in arg[1]]
            part = set().union(*(b[0] for b in branches)) if all(b[0] is not None for b in branches) else None
            query = _both("or", [b[1] if b[0] is None else _spelled(b[0]) for b in branches])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, body = arg
            inner, query = _analyse(body)
            if inner is not None and high == 1:
                part = inner | ({""} if low == 0 else set())
            elif inner is not None and low == high and len(inner) ** low <= MOST_STRINGS:
                part = {""}
                for _ in range(low):
                    part = {a + b for a in part for b in inner}
            else:
                part, query = None, (query if low else True)
        elif op is C.AT:
            part = {""}
        else:
            part = None
        if part is not None and len(part) * len(run) <= MOST_STRINGS:
            run = {a + b for a in run for b in part}
            exact = run if exact is not None else None
        elif part is not None:
            cut()
            run = part
        else:
            cut()
            queries.append(query)
    if exact is None:
        queries.append(_spelled(run))
        return None, _both("and", queries)
    return exact, _spelled(exact)


def trigram_query(pattern: str, flags: int = 0) -> object:
    return _analyse(parser.parse(pattern, flags))[1]


def trigrams_of(query: object) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*(trigrams_of(q) for q in query[1]))


class TrigramIndex:
    """Postings of the named trigrams over one block of texts."""

    def __init__(self, column: pa.Array, names: dict[str, int], lookup: np.ndarray):
        data, offsets = text_buffer(column)
        self.size = len(column)
        self.names = names
        b = LOWER[data].astype(np.int32)
        code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:] if len(b) > 2 else np.zeros(0, np.int32)
        which = lookup[code]
        at = np.flatnonzero(which)
        doc = np.searchsorted(offsets, at, "right") - 1
        inside = at + 2 < offsets[doc + 1]
        self.postings = np.zeros((len(names), self.size), bool)
        self.postings[which[at[inside]] - 1, doc[inside]] = True

    def candidates(self, query: object) -> np.ndarray:
        if query is True:
            return np.ones(self.size, bool)
        if isinstance(query, str):
            return self.postings[self.names[query]]
        each = [self.candidates(q) for q in query[1]]
        return np.logical_and.reduce(each) if query[0] == "and" else np.logical_or.reduce(each)


def matches(rule: Rule, compiled: re.Pattern, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in compiled.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.compiled = [re.compile(r.pattern, r.flags) for r in rules]
        self.queries = [trigram_query(r.pattern, r.flags) for r in rules]
        named = sorted(set().union(*(trigrams_of(q) for q in self.queries)))
        self.names = {t: i for i, t in enumerate(named)}
        self.lookup = np.zeros(1 << 24, np.int16)
        for t, i in self.names.items():
            x, y, z = t.encode()
            self.lookup[(x << 16) | (y << 8) | z] = i + 1

    def scan(self, column: pa.Array) -> list[list[tuple[int, int, int]]]:
        """Per text its (start, rule number, end), sorted."""
        index = TrigramIndex(column, self.names, self.lookup)
        texts = column.fill_null("").to_pylist()
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, rule in enumerate(self.rules):
            for d in np.flatnonzero(index.candidates(self.queries[k])):
                found[d] += [(s, k, e) for s, e in matches(rule, self.compiled[k], texts[d])]
        return [sorted(x) for x in found]


_scanners: dict[tuple[Rule, ...], Scanner] = {}


def scanner(rules: tuple[Rule, ...]) -> Scanner:
    if rules not in _scanners:
        _scanners[rules] = Scanner(rules)
    return _scanners[rules]


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end) by start, then in the rules' order."""

    def fn(batch: pa.RecordBatch) -> dict:
        found = scanner(rules).scan(batch.column(1))
        return {"doc_id": batch.column(0), "spans": [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in x] for x in found]}

    return arrow_map(documents(docs), fn, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def mask_text(text: str, spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    """Each run of overlapping spans gives way to [SECRET:kind of its first]."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[SECRET:{rules[k].kind}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with its own columns, the secrets in text masked (null stays null)."""
    at = docs.columns.index("text")

    def fn(batch: pa.RecordBatch) -> dict:
        column = batch.column(at)
        found = scanner(rules).scan(column)
        texts = [t if not f else mask_text(t, f, rules) for t, f in zip(column.to_pylist(), found, strict=True)]
        return {n: (texts if i == at else batch.column(i)) for i, n in enumerate(batch.schema.names)}

    return arrow_map(docs, fn, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = scan_secrets(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["kind"].isin([b.kind for b in BASE_RULES]))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return r.select(
        "doc_id", *[count(b.kind) for b in BASE_RULES], F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def _folded(pattern: str) -> str:
    """The pattern with each lower-case literal letter as a class of both cases."""
    return re.sub(r"\[[^]]*\]|\\x..|[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]" if len(m[0]) == 1 else m[0], pattern)


def _rule_sql(rule: Rule) -> str:
    p = (_folded(rule.pattern) if rule.flags & re.IGNORECASE else rule.pattern).replace("'", "''")
    return f"""select doc_id, '{rule.kind}' as kind, {RULES.index(rule)} as no, {rule.least} as least, string_split_regex(text, '{p}') as gap,
  regexp_extract_all(text, '{p}') as hit, regexp_extract_all(text, '{p}', {rule.group}) as part from d"""


OP4_SQL = f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
found as ({" union all ".join(_rule_sql(r) for r in RULES)}),
each as (select doc_id, kind, no, least, gap, hit, unnest(part) as part, unnest(range(1, len(hit) + 1)) as i from found),
span as (select doc_id, kind, no, list_sum(list_transform(gap[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hit[1:i - 1], lambda x: length(x))), 0) as s, length(hit[i]) as n
  from each where length(part) >= least),
line as (select doc_id, kind, no, s, concat(kind, ':', s::bigint, ':', (s + n)::bigint) as line from span),
out as (select doc_id, count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access, count(*) filter (where kind = 'hex') as n_hex,
  string_agg(line, ',' order by s, no) filter (where no < {len(BASE_RULES)}) as base, string_agg(line, ',' order by s, no) as spans from line group by doc_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join out using (doc_id)
"""
