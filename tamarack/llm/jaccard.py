"""Exact n-gram Jaccard join by a token-group matrix (operator 5).

A document's set: its distinct `k`-word shingles (64-bit hashes) of lower-cased (A-Z) words; with fewer words, the whole
sequence as one; without words, empty and linked with nothing. Two documents link when
100 * |intersection| >= pct * |union|; the result has every document with the smallest doc_id of its component.

1. Equal sets are one node, named by a digest of the set's shingles and of a second, independent hash of each, so that
   128 bits decide. Among linked sets a shingle counts by its 64-bit hash: two of 10,000 shingles each have a wrong
   match with a chance of about 10**-11.
2. A node can only link with one that shares a token of its prefix, the first n - ceil(pct * n / 100) + 1 tokens of its
   set in a common order: rare ones first, then those of the upper half of the hashes, then frequent ones. Frequency comes from a count-min sketch over all documents (of the lower half of the
   hashes); it steers the order only, so errors cost time, not links.
   Nodes whose prefix tokens occur in no other node's prefix are done.
3. The rest is partitioned into groups: nodes with the same most frequent prefix token form a family. Each is compared to
   the family's most typical node; those that link with it are its main part and need no comparison among themselves.
   Families that share prefix tokens with a larger one then join it (not its main part).
   Main part and rest are dealt by size and hash into groups of about GROUP nodes or GROUP_TOKENS tokens.
4. Pairs of groups of one family, or of families that share a prefix token, and whose sizes allow a link, meet in one task of at most two groups; to a
   meeting of two families come only nodes that share a prefix token with the other family. Each
   group's token union bounds the overlap of each node of the other, and only nodes whose bound reaches
   pct / 100 of their size are opened, that is, compared exactly with the group's members. Tasks send on only a spanning
   forest of the links they find.
5. Components of these links by min-label joins.

Defined cases: null text is empty; repeated rows each appear with their class; rows with a null doc_id count as nodes
and link like others, but name no component: one without any doc_id has a null component_id. Posts name a node by a
64-bit hash of its digest; should two nodes share one, they are only compared more often. Extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sketch as cms
from .common import arrow_map, documents, materialize, remove, small, table
from .graph import components
from .textkit import Words, hash_runs, mix

#: Most nodes of a group, and about the most tokens (8 MB): a task holds two groups and some ten arrays of their size.
GROUP, GROUP_TOKENS = 1024, 1 << 20
#: Tokens below it are sketched.
_HALF = np.uint64(1 << 63)


def _col(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    return [x for x, _ in _sets(Words(column, lower=True), k, ())]


def named_sets(column: pa.Array, k: int) -> tuple[list[np.ndarray], list[bytes]]:
    """The sorted distinct shingle hashes of each text, and the name of that set."""
    w = Words(column, lower=True)
    sets = list(_sets(w, k, w.grams(k, seed=1)[0]))
    return [x for x, _ in sets], [hashlib.blake2b(x.tobytes() + int(y).to_bytes(8, "little"), digest_size=16).digest() for x, y in sets]


def _sets(w: Words, k: int, second: np.ndarray | tuple) -> Iterator[tuple[np.ndarray, int]]:
    """Each text's set and, where second hashes of all shingles are given, the sum of its shingles' second hashes."""
    g, at = w.grams(k)
    edge = np.searchsorted(at, w.first)
    for d in range(len(w)):
        lo, hi = w.first[d], w.first[d + 1]
        if hi - lo >= k:
            if len(second):
                x, one = np.unique(g[edge[d] : edge[d + 1]], return_index=True)
                yield x, int(second[edge[d] + one].sum())
            else:
                yield np.unique(g[edge[d] : edge[d + 1]]), 0
        elif hi == lo:
            yield np.zeros(0, np.uint64), 0
        else:
            few = [hash_runs(w.hashes(seed)[lo:hi], hi - lo) ^ np.uint64(hi - lo) for seed in (0, 1)]
            yield mix(few[0]), int(few[1][0])


def needed(n: int, pct: int) -> int:
    return -(-pct * n // 100)


def levels(tokens: np.ndarray, filt: cms.Sketch, load: float) -> np.ndarray:
    """The rank of each token in the common order, less its hash: estimated frequency, the unsketched half between rare and frequent."""
    rare = int(4 + 3 * load)
    level = filt.estimate(tokens).astype(np.int16)
    level[level > rare] += 1
    level[tokens >= _HALF] = rare + 1
    return level


def _signatures(docs: DataFrame, k: int, pct: int, filt, load: float) -> DataFrame:
    def fn(batch: pa.RecordBatch) -> dict:
        sets, names = named_sets(_col(batch, "text"), k)
        level = levels(np.concatenate(sets) if sets else np.zeros(0, np.uint64), filt.value, load)
        prefix, at = [], 0
        for s in sets:
            order = np.argsort(level[at : at + len(s)], kind="stable")
            at += len(s)
            p = len(s) - needed(len(s), pct) + 1 if len(s) else 0
            prefix.append(s[order[:p]].view(np.int64))
        return {"doc_id": _col(batch, "doc_id"), "th": _col(batch, "th"), "n": [len(s) for s in sets], "node": names, "prefix": prefix}

    return arrow_map(docs, fn, "doc_id long, th long, n long, node binary, prefix array<long>")


def _token_sets(docs: DataFrame, k: int) -> DataFrame:
    def fn(batch: pa.RecordBatch) -> dict:
        sets, names = named_sets(_col(batch, "text"), k)
        return {
            "node": names, "rep": _col(batch, "rep"), "family": _col(batch, "family"),
            "popular": _col(batch, "popular"), "n": [len(s) for s in sets], "tokens": [s.tobytes() for s in sets]
        }

    return arrow_map(docs, fn, "node binary, rep long, family long, popular double, n long, tokens binary")


def jaccard_at_least(a: bytes, b: bytes, pct: int) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= pct * (len(x) + len(y) - both)


def _typical(pct: int):
    def run(batches):
        for b in batches:
            t, lead = _col(b, "tokens").to_pylist(), _col(b, "lead").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    _col(b, "node"),
                    pa.array([jaccard_at_least(x, y, pct) for x, y in zip(t, lead, strict=True)], pa.bool_())
                ],
                names=["node", "main"],
            )

    return run


def link_groups(left: list[np.ndarray], right: list[np.ndarray], pct: int) -> list[tuple[int, int]]:
    """Links (i, j) between two groups' sets, opening only sets that pass the bound by the other group's token union."""

    def opened(queries: list[np.ndarray], group: list[np.ndarray]) -> np.ndarray:
        union = np.unique(np.concatenate(group))
        sizes = np.array([len(q) for q in queries])
        flat = np.concatenate(queries)
        pos = np.minimum(np.searchsorted(union, flat), len(union) - 1)
        hit = np.concatenate([[0], np.cumsum(union[pos] == flat)])
        edge = np.concatenate([[0], np.cumsum(sizes)])
        return np.flatnonzero(100 * (hit[edge[1:]] - hit[edge[:-1]]) >= pct * sizes)

    if not left or not right:
        return []
    i, j = opened(left, right), opened(right, left)
    if not len(i) or not len(j):
        return []
    a, b = [left[x] for x in i], [right[x] for x in j]
    common = np.intersect1d(np.concatenate(a), np.concatenate(b))

    def matrix(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        flat = np.concatenate(sets)
        pos = np.minimum(np.searchsorted(common, flat), len(common) - 1)
        ok = common[pos] == flat
        return row[ok], pos[ok]

    if not len(common):
        return []
    (ra, ca), (rb, cb) = matrix(a), matrix(b)
    both = np.zeros((len(a), len(b)), np.float32)
    step = max(1024, (1 << 22) // max(len(a), len(b)))
    for lo in range(0, len(common), step):
        x, y = np.zeros((len(a), step), np.float32), np.zeros((len(b), step), np.float32)
        s, t = (ca >= lo) & (ca < lo + step), (cb >= lo) & (cb < lo + step)
        x[ra[s], ca[s] - lo] = 1
        y[rb[t], cb[t] - lo] = 1
        both += x @ y.T
    na, nb = np.array([len(s) for s in a]), np.array([len(s) for s in b])
    o = np.rint(both).astype(np.int64)
    r, c = np.nonzero(100 * o >= pct * (na[:, None] + nb[None, :] - o))
    return list(zip(i[r].tolist(), j[c].tolist(), strict=True))


def _forest(links: list[tuple[bytes, bytes]]) -> list[tuple[bytes, bytes]]:
    up: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = up[x]
        return x

    out = []
    for a, b in links:
        x, y = root(a), root(b)
        if x != y:
            up[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _meet(pct: int):
    """Rows (l, r, side, node, tokens) arrive sorted; one pair of groups is held at a time."""

    def links(rows: list[tuple]) -> list[tuple[bytes, bytes]]:
        left = [x for x in rows if x[2] == 0]
        right = left if rows[0][0] == rows[0][1] else [x for x in rows if x[2] == 1]
        sets = [[np.frombuffer(x[4], np.uint64) for x in side] for side in (left, right)]
        return _forest([(left[i][3], right[j][3]) for i, j in link_groups(*sets, pct) if left[i][3] != right[j][3]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][:2] != row[:2]:
                    found += links(held)
                    held = []
                held.append(row)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], names=["a", "b"])
        found = links(held) if held else []
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], names=["a", "b"])

    return run


def _frequencies(docs: DataFrame, k: int) -> tuple[cms.Sketch, float]:
    """A sketch of the shingles of the hashes' lower half over all documents, and how many there are a cell."""
    words = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 6
    width = cms.width_for(words / 2)
    sketched = lambda b: (lambda x: x[x < _HALF])(np.concatenate(shingle_sets(_col(b, "text"), k) or [np.zeros(0, np.uint64)]))
    return cms.build(docs, sketched, width), words / 2 / width


def _postings(signed: DataFrame, pct: int) -> DataFrame:
    """token, rep, df of the prefix tokens that stand in other nodes' prefixes of a fitting size."""
    nodes = signed.where("n > 0").groupBy(F.xxhash64("node").alias("rep"), "node").agg(
        F.any_value("n").alias("n"), F.any_value("prefix").alias("prefix"),
    )
    each = materialize(nodes.select("rep", "n", F.explode("prefix").alias("token")), "jaccard-tokens")
    remove(signed)
    shared = each.groupBy("token").agg(F.count("*").alias("df"), F.min("n").alias("low"), F.max("n").alias("high"))
    shared = shared.where(f"df > 1 and (df > 2 or 100 * low >= {pct} * high)").select("token", "df")
    posts = materialize(each.join(shared, "token").select("token", "rep", "df"), "jaccard-shared")
    remove(each)
    return posts


def _node_sets(docs: DataFrame, sigs: DataFrame, alive: DataFrame, k: int) -> DataFrame:
    """The set of each node that can link, from its first row's text; rows equal to that in doc_id and text count once."""
    ident = F.struct(F.col("doc_id").isNull().alias("anonymous"), "doc_id", "th")
    first = sigs.where("n > 0").groupBy("node").agg(F.min(ident).alias("x"), F.count("*").alias("copies"))
    first = first.select(
        F.xxhash64("node").alias("rep"), F.col("x.doc_id").alias("first_id"), F.col("x.th").alias("first_th"),
        (F.col("copies") > 1).alias("copied"),
    )
    first = materialize(first.join(alive, "rep"), "jaccard-first")
    same = (F.col("th") == F.col("first_th")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    texts = [
        docs.join(small(first.where(cond)), same).select(
            "doc_id", "th", "text", "rep", "family", "popular",
        ) for cond in ("not copied", "copied")
    ]
    sets = materialize(_token_sets(texts[0].union(texts[1].dropDuplicates(["doc_id", "th", "rep"])), k), "jaccard-sets")
    remove(first)
    return sets


def _main_parts(sets: DataFrame, pct: int) -> tuple[DataFrame, DataFrame]:
    """node, main: the nodes that link with their family's most typical one; and these links."""
    lead = sets.groupBy("family").agg(
        F.max(F.struct("popular", "node")).getField("node").alias("leader"), F.count("*").alias("size"),
    ).where("size > 1")
    lead = small(materialize(lead.select("family", "leader"), "jaccard-lead"))
    led = sets.select("node", "family", "tokens").join(lead, "family")
    # Written out, so that the join with a large family's members is one that can be split.
    leaders = materialize(led.where("node = leader").dropDuplicates(["family"]).select("family", F.col("tokens").alias("lead")), "jaccard-leaders")
    checked = led.where("node != leader").join(leaders, "family").select("node", "tokens", "lead").mapInArrow(
        _typical(pct), "node binary, main boolean",
    )
    leading = led.select("node", (F.col("node") == F.col("leader")).alias("main"))
    main = materialize(checked.union(leading).where("main").distinct(), "jaccard-main")
    remove(leaders)
    star = main.join(sets.select("node", "family"), "node").join(lead, "family").select(F.col("node").alias("a"), F.col("leader").alias("b"))
    return main, star


def _kin(posts: DataFrame, alive: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Families that share a prefix token are kin. family, into: families that join their largest kin, so that its groups
    needn't meet each of them on its own; and f, g: the pairs of kin that are left.

    The largest kin comes from each token's largest family, so only families that are left are paired.
    """
    size = sets.groupBy("family").agg(F.count("*").alias("c")).select("family", F.struct("c", "family").alias("x"))
    holds = posts.select("token", "rep").join(alive.select("rep", "family"), "rep").select("token", "family").distinct()
    holds = materialize(holds.join(size, "family").select("token", "family", "x"), "jaccard-families")
    top = holds.groupBy("token").agg(F.max("x").alias("top"), F.min("x").alias("low")).where("top > low").drop("low")
    best = holds.join(top, "token").where("top > x").groupBy("family").agg(F.max("top").getField("family").alias("into"))
    best = materialize(best, "jaccard-best")
    joined = materialize(best.join(best.select(F.col("family").alias("into")), "into", "left_anti").select("family", "into"), "jaccard-absorbed")
    left = holds.select("token", "family").join(joined, "family", "left").select("token", F.coalesce("into", "family").alias("family")).distinct()
    left = materialize(left.join(top.select("token"), "token", "left_semi"), "jaccard-left")
    pair = left.alias("p").join(left.alias("q"), F.expr("p.token = q.token and p.family < q.family"))
    kin = materialize(pair.select(F.col("p.family").alias("f"), F.col("q.family").alias("g")).distinct(), "jaccard-kin")
    remove(holds, best, left)
    return joined, kin


def _places(sets: DataFrame, main: DataFrame, joined: DataFrame, pct: int) -> DataFrame:
    """node, rep, family, n, main and gid, its group: families are dealt by size and hash."""
    scale = F.floor(F.log(F.col("n").cast("double")) / -math.log(pct / 100 if pct < 100 else 0.99))
    place = sets.select("node", "rep", "family", "n", scale.alias("scale")).join(main, "node", "left").join(joined, "family", "left")
    stays = F.coalesce("main", F.lit(False)) & F.col("into").isNull()
    place = place.select("node", "rep", F.coalesce("into", "family").alias("family"), "n", "scale", stays.alias("main"))
    room = F.greatest(F.count("*") / GROUP, F.sum("n") / GROUP_TOKENS)
    sizes = place.groupBy("family", "main", "scale").agg(F.ceil(room).alias("groups"))
    gid = F.xxhash64("family", "main", "scale", F.pmod(F.xxhash64("node"), "groups"))
    return materialize(place.join(sizes, ["family", "main", "scale"]).withColumn("gid", gid), "jaccard-places")


def _calls(posts: DataFrame, place: DataFrame, kin: DataFrame, pct: int) -> DataFrame:
    """node, l, r, side: which node takes part in which meeting of two groups."""
    groups = place.groupBy("gid", "family", "main").agg(F.count("*").alias("members"), F.min("n").alias("low"), F.max("n").alias("high"))
    fits = f"100 * y.high >= {pct} * x.low and 100 * x.high >= {pct} * y.low"
    inner = groups.alias("x").join(
        groups.alias("y"),
        F.expr(
            f"x.family = y.family and not (x.main and y.main) and (x.gid < y.gid or x.gid = y.gid and x.members > 1) and {fits}"
        ),
    )
    pairs = materialize(inner.select(F.col("x.gid").alias("l"), F.col("y.gid").alias("r")).distinct(), "jaccard-pairs")
    meets = pairs.withColumn("side", F.lit(0)).withColumn("gid", F.col("l"))
    meets = meets.union(pairs.where("l != r").withColumn("side", F.lit(1)).withColumn("gid", F.col("r")))
    within = place.select("node", "gid").join(meets, "gid").select("node", "l", "r", "side")

    end = lambda f, gid, no: groups.select(F.col("family").alias(f), F.col("gid").alias(gid), F.col("low").alias(f"low{no}"), F.col("high").alias(f"high{no}"))
    outer = kin.join(end("f", "l", 1), "f").join(end("g", "r", 2), "g").where(f"100 * high2 >= {pct} * low1 and 100 * high1 >= {pct} * low2")
    outer = materialize(outer.select("f", "g", "l", "r"), "jaccard-outer")
    held = posts.select("token", "rep").join(place.select("rep", "node", "gid", "family"), "rep").select("token", "node", "gid", "family")
    other = held.select("token", F.col("family").alias("other")).distinct()
    wants = held.join(other, "token").where("family != other").select("node", "gid", "other").distinct()
    ends = outer.select("l", "r", F.lit(0).alias("side"), F.col("l").alias("gid"), F.col("g").alias("other"))
    ends = ends.union(outer.select("l", "r", F.lit(1), "r", "f"))
    across = wants.join(ends, ["gid", "other"]).select("node", "l", "r", "side")
    called = materialize(within.union(across).distinct(), "jaccard-calls")
    remove(pairs, outer)
    return called


def ngram_jaccard_join(docs: DataFrame, k: int = 4, pct: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, th (a hash of the text), node, the digest of the document's set (equal for equal sets), and component, which all of a component share (null without words)."""
    spark = docs.sparkSession
    d = documents(docs).withColumn("th", F.xxhash64("text"))
    filt, load = _frequencies(d, k)
    filt = spark.sparkContext.broadcast(filt)
    both = materialize(_signatures(d, k, pct, filt, load), "jaccard-prefixes")
    filt.unpersist()
    sigs = materialize(both.drop("prefix"), "jaccard-signatures")
    posts = _postings(both, pct)
    family = F.max(F.struct("df", "token")).getField("token")
    alive = materialize(posts.groupBy("rep").agg(family.alias("family"), F.avg("df").alias("popular")), "jaccard-alive")
    sets = _node_sets(d, sigs, alive, k)
    main, star = _main_parts(sets, pct)
    joined, kin = _kin(posts, alive, sets)
    place = _places(sets, main, joined, pct)
    called = _calls(posts, place, kin, pct)
    remove(joined, kin, place, posts, alive)

    met = sets.select("node", "tokens").join(small(called), "node").select("l", "r", "side", "node", "tokens")
    links = met.repartition("l", "r").sortWithinPartitions("l", "r", "side", "node").mapInArrow(_meet(pct), "a binary, b binary")
    label = components(links.union(star))
    least = sigs.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep")).join(label, "node", "left")
    least = materialize(least.select("node", "rep", F.coalesce("label", "node").alias("label")), "jaccard-labels")
    named = least.groupBy("label").agg(F.min("rep").alias("component_id"))
    comp = materialize(least.join(named, "label").select("node", "component_id", F.col("label").alias("component")), "jaccard-components")
    remove(sets, main, called, least)
    out = sigs.select("doc_id", "th", F.col("n").alias("n_shingles"), "node").join(comp, "node", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "th", "node", "component")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents")).drop("node", "th", "component")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
OP5_SQL = f"""
with recursive w as (select doc_id, {_WORDS} as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
  else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end as s from w),
sized as (select doc_id, len(s) as n, list_sort(s) as s from s),
node as (select min(doc_id) as rep, any_value(n) as n, s from sized where n > 0 group by s),
each as (select rep, n, unnest(s) as x from node),
near as (select a.rep as a, b.rep as b from each a join each b on a.x = b.x and a.rep < b.rep
  group by a.rep, b.rep, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e as (select a, b from near union all select b, a from near),
reach as (select rep, rep as root from node union select e.b, r.root from reach r join e on e.a = r.rep),
least as (select rep, min(root) as root from reach group by rep)
select d.doc_id, cast(d.n as bigint) as n_shingles, coalesce(l.root, d.doc_id) as component_id
from sized d left join node on node.s = d.s left join least l on l.rep = node.rep
"""
