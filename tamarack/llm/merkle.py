"""Merkle manifest of a dataset, by a broadcast upper tree (operator 12).

Every row is a leaf. The leaves of one source, ascending, form a ternary tree; the sources' roots, ascending by source, form
the tree above them. Executors reduce blocks of 3**height consecutive nodes to one node each. That is repeated until at
most `top_nodes` nodes are left in all; the driver builds the rest of the trees from them and broadcasts, for each of
these nodes, the siblings on its way to the root. Executors then finish each row's proof and fold it. Where the sources
alone are more than `top_nodes`, their roots are numbered and reduced in blocks in the same way, so the driver and the
broadcast keep their size whatever the number of rows and sources.

Places in a source are counted within sorted ranges of (source, doc_id, leaf) and offset by the ranges' counts, so that a
source of any share is spread over all tasks. A block is at most 3**height rows of one source.

Defined cases: nulls in any column have a mark of their own; an empty text differs from a null; rows that are equal in
all five columns have equal leaves and lie side by side; among equal (source, doc_id) the leaf orders, null ids come
first; a row without doc_id counts as not tampered with; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, offsets, ordered, remove, small, table, tune
from .textkit import CRC_SQL, CRC_TABLE_SQL

ARITY = 3
#: Levels of a block: at most 3**6 = 729 nodes.
HEIGHT = 6
#: Nodes left for the driver, at most; a suffix path has about 18 digests, so the broadcast stays below 15 MB.
TOP_NODES = 10_000
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: A step on the way up: the digests left and right of the own node in its run.
PATH = "array<struct<before: string, after: string>>"


def _digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf(values: list[Column]) -> Column:
    """The digest of the values: `-` for a null, else the number of UTF-8 bytes, a colon and the value."""
    said = [v.cast("string") for v in values]
    coded = [F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in said]
    return F.sha2(F.concat(*coded), 256)


def levels(n: int, most: int) -> int:
    """The levels until one of n nodes is left, at most `most`."""
    k = 0
    while n > 1 and k < most:
        n, k = -(-n // ARITY), k + 1
    return k


def reduce_run(nodes: list[str], height: int) -> tuple[list[str], list[list[tuple[str, str]]]]:
    """The nodes `height` levels up, and each node's siblings (before, after) on its way there."""
    paths: list[list[tuple[str, str]]] = [[] for _ in nodes]
    span = 1
    for _ in range(height):
        upper = []
        for i in range(0, len(nodes), ARITY):
            run = nodes[i : i + ARITY]
            upper.append(_digest(*run))
            for j in range(len(run)):
                step = ("".join(run[:j]), "".join(run[j + 1 :]))
                for k in range((i + j) * span, min((i + j + 1) * span, len(paths))):
                    paths[k].append(step)
        nodes, span = upper, span * ARITY
    return nodes, paths


def _blocks(nodes: DataFrame, height: int, name: str) -> DataFrame:
    """nodes (tree, m: the nodes of the tree, pos, digest, carried) by block: tree, m, block, members in order, digest of the block.

    Written, since it is read twice: on the way up, and for the proofs."""
    size = ARITY**height
    by = nodes.withColumn("block", F.floor(F.col("pos") / size).cast("long"))
    member = F.struct("pos", "digest", "carried")
    rows = by.groupBy("tree", "m", "block").agg(F.array_sort(F.collect_list(member)).alias("members"))
    tune(nodes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            above = [
                reduce_run([x["digest"] for x in part], levels(m, height))[0][0]
                for m, part in zip(b.column("m").to_pylist(), b.column("members").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(above, pa.string())], names=[*b.schema.names, "digest"])

    carried = dict(nodes.dtypes)["carried"]
    schema = f"tree string, m long, block long, members array<struct<pos: long, digest: string, carried: {carried}>>, digest string"
    return materialize(rows.mapInArrow(run, schema), name)


def _upper(blocks: DataFrame, height: int) -> DataFrame:
    """The blocks as the nodes of the next round."""
    m = F.ceil(F.col("m") / ARITY**height).cast("long")
    return blocks.select("tree", m.alias("m"), F.col("block").alias("pos"), "digest", F.struct("tree", "m", "block").alias("carried"))


def _top(rows: list, single: bool) -> tuple[str, list[tuple]]:
    """From (tree, pos, digest) of all nodes left, the root and each node's (tree, pos, path, subroot). With `single` the
    nodes are those of one tree of sources' roots, and there are no subroots to tell."""
    trees: dict[str, list[tuple[int, str]]] = {}
    for tree, pos, digest in rows:
        trees.setdefault(tree, []).append((pos, digest))
    names, found, roots = sorted(trees, key=lambda t: t.encode()), [], []
    for t in names:
        nodes = [d for _, d in sorted(trees[t])]
        (root,), paths = reduce_run(nodes, levels(len(nodes), 64))
        roots.append(root)
        found.append(paths)
    if single:
        return roots[0], [(names[0], i, p, None) for i, p in enumerate(found[0])]
    (root,), above = reduce_run(roots, levels(len(roots), 64))
    return root, [
        (t, i, p + above[k], roots[k]) for k, t in enumerate(names) for i, p in enumerate(found[k])
    ]


def _finish(blocks: DataFrame, suffixes: DataFrame, height: int) -> DataFrame:
    """Each member's carried, digest, path to the root and subroot: its siblings in the block, then the block's suffix (tree, block, path, subroot)."""
    rows = blocks.select("tree", "m", "block", "members").join(suffixes, ["tree", "block"])
    tune(blocks.sparkSession)
    kind = blocks.schema["members"].dataType.elementType["carried"].dataType.simpleString()
    step = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                members = b.column("members")[i].values
                paths = reduce_run(members.field("digest").to_pylist(), levels(b.column("m")[i].as_py(), height))[1]
                rest = [(s["before"], s["after"]) for s in b.column("path")[i].as_py()]
                full = [[{"before": x, "after": y} for x, y in p + rest] for p in paths]
                subroot = pa.array([b.column("subroot")[i].as_py()] * len(full), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [members.field("carried"), members.field("digest"), pa.array(full, step), subroot],
                    names=["carried", "digest", "path", "subroot"],
                )

    return rows.mapInArrow(run, f"carried {kind}, digest string, path {PATH}, subroot string")


def manifest(leaves: DataFrame, height: int = HEIGHT, top_nodes: int = TOP_NODES) -> tuple[DataFrame, str | None]:
    """leaves: source, doc_id, leaf, carried (any columns of the caller as a struct). The rows carried, leaf, path (siblings
    before and after, from the leaf to the root) and subroot, and the root (null: no rows)."""
    spark = leaves.sparkSession
    # A null source sorts before every other one: the marks are in byte order.
    keyed = leaves.withColumn("tree", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")))
    rows = ordered(keyed, "merkle-order", "tree", "doc_id", "leaf")
    counts = rows.groupBy("tree", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    counts = materialize(offsets(counts, by=("tree",)).withColumn("shift", F.col("base") - F.col("first")), "merkle-counts")
    sizes = counts.groupBy("tree").agg(F.sum("n").alias("m"))
    where = small(materialize(counts.join(small(sizes), "tree").select("tree", "part", "shift", "m"), "merkle-places"))
    nodes = rows.join(where, ["tree", "part"]).select(
        "tree", "m", (F.col("at") + F.col("shift")).alias("pos"), F.col("leaf").alias("digest"), "carried",
    )
    rounds, single = [], False
    while True:
        blocks = _blocks(nodes, height, "merkle-blocks")
        rounds.append((blocks, single))
        nodes = _upper(blocks, height)
        left, tallest = nodes.agg(F.count("*"), F.max("m")).first()
        if not left:
            return _finish(blocks, _frame(spark, []), height).withColumnRenamed("digest", "leaf"), None
        if left <= top_nodes:
            break
        if tallest == 1 and not single:  # too many sources for the driver: their roots become one tree's nodes
            placed = ordered(nodes.select("tree", "digest", "carried"), "merkle-sources", "tree")
            ranges = materialize(placed.groupBy("part").agg(F.count("*").alias("n")), "merkle-ranges")
            nodes = placed.join(F.broadcast(offsets(ranges).select("part", "base")), "part").select(
                F.lit("").alias("tree"), F.lit(left).cast("long").alias("m"), (F.col("base") + F.col("at")).alias("pos"), "digest", "carried",
            )
            single = True
    root, suffixes = _top([tuple(r) for r in nodes.select("tree", "pos", "digest").collect()], single)
    down = F.broadcast(_frame(spark, suffixes))
    for k in range(len(rounds) - 1, 0, -1):
        (blocks, one), below = rounds[k], rounds[k - 1][1]
        got = _finish(blocks, down, height)
        subroot = F.col("digest") if one and not below else F.col("subroot")
        down = got.select(F.col("carried.tree").alias("tree"), F.col("carried.block").alias("block"), "path", subroot.alias("subroot"))
    return _finish(rounds[0][0], down, height).withColumnRenamed("digest", "leaf"), root


def _frame(spark: SparkSession, suffixes: list[tuple]) -> DataFrame:
    return spark.createDataFrame(suffixes, f"tree string, block long, path {PATH}, subroot string")


def fold(node: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, node, lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256))


def merkle_manifest(docs: DataFrame, height: int = HEIGHT, top_nodes: int = TOP_NODES) -> DataFrame:
    """docs: COLUMNS. One row per document: doc_id, leaf, subroot, root, path, tampered_leaf.

    tampered_leaf is the leaf of the text without line feeds where 2 divides the CRC-32 of doc_id, else the leaf."""
    typed = [F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long"), F.col("text").cast("string")]
    d = docs.select(*[c.alias(n) for c, n in zip(typed, COLUMNS, strict=True)])
    own = [F.col(c) for c in COLUMNS]
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    bad = leaf([*own[:-1], F.translate("text", "\n", "")])
    rows = d.select("doc_id", "source", leaf(own).alias("leaf"), F.when(hit & F.contains("text", F.lit("\n")), bad).alias("bad"))
    rows = materialize(rows.withColumn("carried", F.struct("doc_id", "bad")).drop("bad"), "merkle-leaves")
    got, root = manifest(rows, height, top_nodes)
    remove(rows)
    return got.select(
        F.col("carried.doc_id").alias("doc_id"), "leaf", "subroot", F.lit(root).cast("string").alias("root"), "path",
        F.coalesce("carried.bad", "leaf").alias("tampered_leaf"),
    )


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = merkle_manifest(table(spark, sf_dir, "documents"))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    r = r.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), fold(F.col("tampered_leaf"), F.col("path")).alias("folded_root"))
    return r.withColumn("verified", F.col("folded_root") == F.col("root"))


def _coded(column: str) -> str:
    s = f"cast({column} as varchar)"
    return f"coalesce(octet_length(encode({s})) || ':' || {s}, '-')"


def _leaf_sql(text: str) -> str:
    return f"sha256({' || '.join(_coded(c) for c in (*COLUMNS[:-1], text))})"


OP12_SQL = f"""
with recursive t as (
  select doc_id, coalesce('=' || source, '-') as tree, {_leaf_sql('text')} as leaf,
    case when {CRC_SQL.format(x="cast(doc_id as varchar)")} % 2 = 0 then {_leaf_sql("replace(text, chr(10), '')")} end as bad
  from documents, {CRC_TABLE_SQL}),
leaves as (
  select doc_id, tree, leaf, coalesce(bad, leaf) as bad, count(*) over (partition by tree) as m,
    row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos from t),
up as (
  select tree, 0 as lvl, pos, leaf as h, m from leaves
  union all select tree, lvl + 1, pos // 3, sha256(string_agg(h, '' order by pos)), (m + 2) // 3 from up where m > 1
  group by tree, lvl, m, pos // 3),
sib as (
  select a.tree, a.lvl, a.pos, coalesce(string_agg(b.h, '' order by b.pos) filter (b.pos < a.pos), '') as before,
    coalesce(string_agg(b.h, '' order by b.pos) filter (b.pos > a.pos), '') as after
  from up a join up b on a.tree = b.tree and a.lvl = b.lvl and a.pos // 3 = b.pos // 3 where a.m > 1 group by all),
subroots as (
  select tree, h as subroot, row_number() over (order by encode(tree)) - 1 as spot, count(*) over () as trees from up where m = 1),
up2 as (
  select 0 as lvl, spot as pos, subroot as h, trees as m from subroots
  union all select lvl + 1, pos // 3, sha256(string_agg(h, '' order by pos)), (m + 2) // 3 from up2 where m > 1
  group by lvl, m, pos // 3),
sib2 as (
  select a.lvl, a.pos, coalesce(string_agg(b.h, '' order by b.pos) filter (b.pos < a.pos), '') as before,
    coalesce(string_agg(b.h, '' order by b.pos) filter (b.pos > a.pos), '') as after
  from up2 a join up2 b on a.lvl = b.lvl and a.pos // 3 = b.pos // 3 where a.m > 1 group by all),
walk as (
  select doc_id, leaf, tree, 0 as lvl, pos, m, '' as proof, bad as folded from leaves
  union all select doc_id, leaf, w.tree, w.lvl + 1, w.pos // 3, (m + 2) // 3, proof || before || after, sha256(before || folded || after)
  from walk w join sib s on s.tree = w.tree and s.lvl = w.lvl and s.pos = w.pos where m > 1),
walk2 as (
  select doc_id, leaf, subroot, 0 as lvl, spot as pos, trees as m, proof, folded from walk join subroots using (tree) where m = 1
  union all select doc_id, leaf, subroot, w.lvl + 1, w.pos // 3, (m + 2) // 3, proof || before || after, sha256(before || folded || after)
  from walk2 w join sib2 s on s.lvl = w.lvl and s.pos = w.pos where m > 1)
select doc_id, leaf, subroot, r.h as root, sha256(proof) as proof_sha256, folded as folded_root, folded = r.h as verified
from walk2 w, (select h from up2 where m = 1) r where w.m = 1
"""
