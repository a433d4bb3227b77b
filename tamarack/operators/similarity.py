"""Vectors by cells: a trained coarse quantizer, an index that searches, and the cosine-threshold join.

A quantizer is a set of unit centroids from spherical k-means over a bounded sample (SAMPLE_ROWS rows of the smallest hashes
of the id). Every vector belongs to the cell of its nearest centroid and keeps its angle to it. Angles obey the triangle
inequality, so a cell whose angles lie in [lo, hi] can only hold vectors within `a` of a vector u if
lo - a <= angle(u, centroid) <= hi + a. All pruning here rests on that bound, so joins and exact searches lose nothing;
only the search with a fixed number of probes is approximate.

Defined cases: a null or empty vector, a zero vector and one with NaN have no neighbours; vectors of another length than the
quantizer's lie in a cell of their length, which is never pruned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ..sources.tables import keep, new_path, small
from . import nearest
from .retrieval import top_k

#: Rows that the quantizer is trained on, at most, and its cells, at most.
SAMPLE_ROWS, MOST_CELLS = 16_384, 1024
#: Bytes of vectors in a pack that is compared at once, and cells of a join, at most: a row is sent to each cell it may meet, once for
#: each pack there, so these bound how often it is sent.
PACK_BYTES, JOIN_CELLS = 8 << 20, 64
#: Products of a join that are held at once, and pairs that are worked out again at once.
PRODUCTS, PAIRS = 1 << 22, 1 << 16
#: Least recall that the number of probes is chosen for, measured over the sample.
RECALL = 0.95
#: Scores are rounded to six digits; the slack of the bounds, in cosine and in radians.
ROUNDING, SLACK = 1e-6, 1e-7


def matrix(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list array as a matrix of unit rows of the first row's length, and which rows have that length and a direction."""
    import pyarrow.compute as pc

    n = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    d = int(n.max(initial=0))
    ok = (n == d) & (d > 0)
    out = np.zeros((len(vectors), d))
    if ok.any():
        out[ok] = vectors.filter(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return _unit(out, ok)


def _unit(rows: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.sqrt((rows * rows).sum(1))
    ok = ok & (norm > 0) & np.isfinite(norm)
    return np.where(ok[:, None], rows / np.where(ok, norm, 1.0)[:, None], 0.0), ok


def train(vectors: DataFrame, cells: int | None = None, key: str = "id", rounds: int = 8) -> np.ndarray:
    """Unit centroids (cells x length) of vectors (key, embedding); cells defaults to the root of the number of rows. The length
    is the commonest one of the sample. No row: an empty array."""
    v = vectors.where(F.size("embedding") > 0)
    n = v.count()
    if not n:
        return np.zeros((0, 0))
    spot = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    some = v if n <= SAMPLE_ROWS else v.where(spot < int((1.2 * SAMPLE_ROWS + 100) / n * (1 << 30)))
    got = some.select(spot.alias("spot"), "embedding").orderBy("spot").limit(SAMPLE_ROWS).toArrow().column("embedding").combine_chunks()
    lengths = np.array([len(x) for x in got])
    d = int(np.bincount(lengths).argmax())
    x, ok = matrix(got.filter(pa.array(lengths == d)))
    x = x[ok]
    k = min(MOST_CELLS, max(1, round(n**0.5)) if cells is None else cells, len(x))
    centroids = x[np.linspace(0, len(x) - 1, k).astype(int)] if k else np.zeros((0, d))
    for _ in range(rounds if k else 0):
        near = (x @ centroids.T).argmax(1)
        total = np.zeros_like(centroids)
        np.add.at(total, near, x)
        moved, full = _unit(total, np.bincount(near, minlength=k) > 0)
        centroids = np.where(full[:, None], moved, centroids)
    return centroids


def placed(df: DataFrame, centroids: np.ndarray, angles: bool = False) -> DataFrame:
    """df (embedding) with cell and angle to its centroid, or with the angles to all centroids. Vectors of another length
    have cell -1 - their length, those without a direction a null."""
    found = [StructField("cell", IntegerType()), StructField("angle", DoubleType())]
    schema = StructType([*df.schema.fields, *found, *([StructField("angles", ArrayType(DoubleType()))] if angles else [])])
    d = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for b in batches:
            vectors = b.column("embedding")
            n = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
            x, ok = np.zeros((b.num_rows, d)), n == d
            flat = vectors.filter(pa.array(ok)).flatten()
            ok &= d > 0
            if ok.any():
                x[ok] = flat.to_numpy(zero_copy_only=False).reshape(-1, d)
            x, ok = _unit(x, ok)
            cos = np.clip(x @ centroids.T, -1.0, 1.0) if len(centroids) else np.zeros((b.num_rows, 1))
            cell = np.where(ok, cos.argmax(1), -1 - n)
            angle = np.where(ok, np.arccos(cos.max(1)), 0.0)
            none = (n == 0) | ((n == d) & ~ok)
            cols = [*b.columns, pa.array(cell, pa.int32(), mask=none), pa.array(angle, pa.float64(), mask=none)]
            if angles:
                cols.append(pa.array(list(np.arccos(cos)), pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays(cols, names=schema.fieldNames())

    return df.mapInArrow(run, schema)


def _packed(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("name", "kind", "embedding"))).alias(name))


def compared_packs(
    left: DataFrame, right: DataFrame, threshold: float, by: list[str], cells: int | None = None,
) -> DataFrame:
    """Packs of rows (key, kind, embedding, by) and (id, kind, embedding, by) that the bounds can't rule out: by, l and r, arrays of
    name, kind and embedding in the order of name. Every pair at or above the threshold is in one pack."""
    if cells is None:
        cells = min(JOIN_CELLS, max(1, round(right.where(F.size("embedding") > 0).count() ** 0.5)))
    centroids = train(right, cells)
    side = lambda df, name: df.where(F.size("embedding") > 0).select(F.col(name).alias("name"), "kind", "embedding", *by)
    r = keep(placed(side(right, "id"), centroids).where("cell is not null"), "near-right")
    l = placed(side(left, "key"), centroids, angles=True).where("cell is not null")  # noqa: E741
    chunk = F.greatest(F.lit(32), F.floor(F.lit(PACK_BYTES) / (4 * F.max(F.size("embedding")))))
    held = r.groupBy(*by, "cell").agg(F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.ceil(F.count("*") / chunk).cast("int").alias("splits"))
    held = keep(held.withColumnRenamed("cell", "_cell"), "near-cells")
    reach = float(np.arccos(min(1.0, max(-1.0, threshold - ROUNDING)))) + SLACK
    same = F.col("_cell") == F.col("cell")
    own = F.get(F.col("angles"), F.col("_cell"))
    home = F.col("angle") + 2 * reach  # a row of another cell is nearer to its own centroid than to this row's
    met = F.when(F.col("_cell") < 0, same).otherwise(
        (F.col("cell") >= 0) & own.between(F.col("lo") - reach, F.col("hi") + reach) & (own <= home),
    )
    sides = small(held)
    met_rows = l.join(sides, by).where(met) if by else l.join(F.broadcast(held), met)  # without `by`, at most MOST_CELLS cells and one a length
    parts = keep(
        met_rows.select(*by, "name", "kind", "embedding", F.col("_cell").alias("cell"), F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("split")),
        "near-left",
    )
    unit = [*by, "cell", "split"]
    n = parts.groupBy(*unit).agg(F.ceil(F.count("*") / chunk).cast("int").alias("packs"))
    n = small(keep(n, "near-packs"))
    lefts = _packed(parts.join(n, unit).withColumn("pack", F.pmod(F.xxhash64("name"), F.col("packs"))), [*unit, "pack"], "l")
    split = F.pmod(F.xxhash64("name"), F.col("splits")).cast("int")
    rights = _packed(r.join(sides.withColumnRenamed("_cell", "cell"), [*by, "cell"]).withColumn("split", split), unit, "r")
    rights = rights.join(n, unit).withColumn("pack", F.explode(F.sequence(F.lit(0).cast("long"), F.col("packs").cast("long") - 1))).drop("packs")
    return lefts.withColumn("pack", F.col("pack").cast("long")).join(rights, [*unit, "pack"]).select(*by, "l", "r")


def near_pairs(x: np.ndarray, y: np.ndarray, threshold: float, digits: int | None = 6) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of x, rows of y and scores of the pairs of unit rows whose product, rounded, is at or above the threshold, in parts of
    whole rows of x. Products are made in single precision; what may be near is worked out again in double."""
    low, other = x.astype(np.float32), np.ascontiguousarray(y.astype(np.float32).T)
    # The error of a single-precision product of unit rows is below (length + 2) units in the last place.
    least = np.float32(threshold - (ROUNDING if digits is None else 10.0**-digits) - (x.shape[1] + 2) * 2.0**-23)
    step = max(1, PRODUCTS // max(1, len(y)))
    for at in range(0, len(x), step):
        rows, cols = np.nonzero(low[at : at + step] @ other >= least)
        rows += at
        score = np.empty(len(rows))
        for p in range(0, len(rows), PAIRS):
            score[p : p + PAIRS] = np.einsum("ij,ij->i", x[rows[p : p + PAIRS]], y[cols[p : p + PAIRS]])
        score = score if digits is None else np.round(score, digits)
        near = score >= threshold
        yield rows[near], cols[near], score[near]


def _codes(left: pa.Array, right: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Both arrays of texts as numbers, equal ones (and nulls) alike, and the number of the blank one (-1: there is none)."""
    both = pa.concat_arrays([left, right]).dictionary_encode(null_encoding="encode")
    codes, values = both.indices.to_numpy(), both.dictionary.to_pylist()
    return codes[: len(left)], codes[len(left) :], values.index("") if "" in values else -1


def cosine_join(
    left: DataFrame, right: DataFrame, threshold: float, by: list[str] | None = None, best: bool = False, cells: int | None = None,
    digits: int | None = 6,
) -> DataFrame:
    """key, id, score of rows of left (key, kind, embedding) and right (id, kind, embedding) of equal `by` whose cosine, rounded to
    `digits` (None: as it is), is at or above the threshold (> 0). Kinds must be equal if neither is blank. With `best`, the most similar id
    of each key (ties: the smallest); equal vectors of the right are compared once.

    Rows meet in packs of about PACK_BYTES by one matrix product each, so no cell, however full, is one task."""
    if threshold <= 0:
        raise ValueError("the threshold must be above 0")
    by = by or []
    key, id_ = left.schema["key"], right.schema["id"]
    if best:
        right = right.groupBy(*by, "kind", "embedding").agg(F.min("id").alias("id"))
    packs = compared_packs(left, right, threshold, by, cells)
    schema = StructType([StructField("key", key.dataType), StructField("id", id_.dataType), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                l, r = (v[i].values for v in b.columns)  # noqa: E741
                (x, _), (y, _) = matrix(l.field("embedding")), matrix(r.field("embedding"))
                if x.shape[1] != y.shape[1]:
                    continue
                kinds, others, blank = _codes(l.field("kind"), r.field("kind"))
                for rows, cols, score in near_pairs(x, y, threshold, digits):
                    mine, its = kinds[rows], others[cols]
                    fits = (mine == blank) | (its == blank) | (mine == its)
                    rows, cols, score = rows[fits], cols[fits], score[fits]
                    if best:
                        order = np.lexsort((cols, -score, rows))
                        first = order[np.flatnonzero(np.diff(rows[order], prepend=-1))]
                        rows, cols, score = rows[first], cols[first], score[first]
                    yield pa.RecordBatch.from_arrays(
                        [l.field("name").take(pa.array(rows)), r.field("name").take(pa.array(cols)), pa.array(score)], names=["key", "id", "score"],
                    )

    pairs = packs.select("l", "r").mapInArrow(run, schema)
    if not best:
        return pairs
    found = pairs.groupBy("key").agg(F.min_by(F.struct("id", "score"), F.struct(-F.col("score"), F.col("id"))).alias("x"))
    return found.select("key", "x.id", "x.score")


def followers(rows: DataFrame, threshold: float, by: list[str] | None = None) -> DataFrame:
    """rows (key: their order, kind, embedding, `by`) taken in order: a row with an earlier leader near it follows the nearest such
    (ties: the earliest), others lead. later and leader of those that follow.

    Rows of equal vector and kind are compared as one: only the first can lead, and then the others follow it; if it follows,
    each of them follows the nearest leader that is earlier than itself."""
    by = by or []
    rows = rows.where(F.size("embedding") > 0).select("key", "kind", "embedding", *by)
    same = [*by, "kind", "embedding"]
    classes = keep(rows.groupBy(*same).agg(F.min("key").alias("rep"), F.count("*").alias("n")), "near-classes")
    left, right = (classes.select(F.col("rep").alias(c), "kind", "embedding", *by) for c in ("key", "id"))
    pairs = keep(cosine_join(left, right, threshold, by).where("id != key"), "near-pairs")
    led = keep(leaders(pairs.where("id < key").select(F.col("key").alias("later"), F.col("id").alias("earlier"), "score")), "near-led")
    # A vector without a direction is near none, not even its like.
    repeated = classes.where((F.col("n") > 1) & (F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) > 0))
    others = rows.join(repeated.drop("n"), same).where("key != rep").select(F.col("key").alias("later"), "rep")
    others = keep(others.join(led.select(F.col("later").alias("rep"), F.lit(True).alias("_led")), "rep", "left"), "near-others")
    near = pairs.select(F.col("key").alias("rep"), F.col("id").alias("leader"), "score").join(led.select(F.col("later").alias("leader")), "leader", "left_anti")
    later = others.where("_led").join(near, "rep").where("leader < later").groupBy("later").agg(F.min_by("leader", F.struct(-F.col("score"), "leader")).alias("leader"))
    return led.union(others.where("_led is null").select("later", F.col("rep").alias("leader"))).union(later)


def leaders(pairs: DataFrame) -> DataFrame:
    """pairs: later, earlier, score, of rows that are taken in order. later, leader of the followers. Each round settles all rows
    whose earlier ones are settled, so the rounds grow with the longest chain of near rows."""
    open_, lead = keep(pairs.select("later").distinct(), "undecided"), keep(
        pairs.select(F.col("earlier").alias("leader")).distinct().join(
            pairs.select(F.col("later").alias("leader")), "leader", "left_anti",
        ),
        "leaders",
    )
    while open_.limit(1).count():
        following = pairs.join(lead, F.col("earlier") == F.col("leader"), "left_semi").select("later").distinct()
        rest = open_.join(following, "later", "left_anti")
        waits = pairs.join(rest.select(F.col("later").alias("earlier")), "earlier", "left_semi").select("later").distinct()
        settled = rest.join(waits, "later", "left_anti")
        lead = keep(lead.union(settled.select("later")), "leaders")
        open_ = keep(rest.join(lead, F.col("later") == F.col("leader"), "left_anti"), "undecided")
    near = pairs.join(lead, F.col("earlier") == F.col("leader")).join(lead.select(F.col("leader").alias("later")), "later", "left_anti")
    return near.groupBy("later").agg(F.min_by("leader", F.struct(-F.col("score"), F.col("leader"))).alias("leader"))


def write_index(vectors: DataFrame, path: str, cells: int | None = None) -> dict:
    """Write vectors (id, embedding) by cell under `path`, and the index's facts (centroids, cells, probes) as a table beside them.

    probes is the number of nearest cells that hold RECALL of the ten nearest sample rows of sample rows, whose neighbours
    are farther than those among all rows. Rows without a direction are kept (cell null) and never found."""
    spark = vectors.sparkSession
    centroids = train(vectors, cells)
    placed(vectors.select("id", "embedding"), centroids).write.partitionBy("cell").parquet(f"{path}/cells")
    held = spark.read.parquet(f"{path}/cells").where("cell is not null").groupBy("cell").agg(F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.count("*").alias("n"))
    held.write.parquet(f"{path}/bounds")
    probes = _probes(vectors, centroids)
    rows = [(i, c.tolist(), probes) for i, c in enumerate(centroids)]
    spark.createDataFrame(rows, "cell int, centroid array<double>, probes int").coalesce(1).write.parquet(f"{path}/centroids")
    return {"cells": len(centroids), "probes": probes}


def _probes(vectors: DataFrame, centroids: np.ndarray, rows: int = 2048, k: int = 10) -> int:
    if len(centroids) < 2:
        return 1
    spot = F.xxhash64("id", F.lit(1))
    got = vectors.where(F.size("embedding") == centroids.shape[1]).orderBy(spot).limit(rows).select("embedding").toArrow()
    x, ok = matrix(got.column("embedding").combine_chunks())
    x = x[ok]
    cos = x @ x.T
    np.fill_diagonal(cos, -2)
    near = np.argsort(-cos, axis=1)[:, :k]
    cell = (x @ centroids.T).argmax(1)
    place = np.empty((len(x), len(centroids)), int)
    np.put_along_axis(place, np.argsort(-(x @ centroids.T), axis=1), np.arange(len(centroids))[None], 1)
    needed = np.sort(np.take_along_axis(place, cell[near], 1).reshape(-1))
    return int(needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))))]) + 1 if len(needed) else 1


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int | None = None, exact: bool = False) -> DataFrame:
    """query_id, id, score and rank of the k rows of the index nearest to each query (query_id, query_vec), by exact cosine.

    The cells nearest to a query are read (as many as were chosen when the index was written, or `probes`). With `exact`, a
    second pass reads the cells that may still hold a nearer row than the k-th found, and the result is that of a full scan."""
    facts = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
    if not facts:
        return queries.select("query_id", F.col("query_id").alias("id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    centroids, probes = np.array([r.centroid for r in facts]), probes or facts[0].probes
    q = keep(placed(queries.select("query_id", F.col("query_vec").alias("embedding")), centroids, angles=True).where("cell >= 0"), "index-queries")
    ranked = F.array_sort(F.transform("angles", lambda a, i: F.struct(a.alias("angle"), i.alias("cell"))))
    kinds = queries.schema["query_id"].dataType, spark.read.parquet(f"{path}/cells").schema["id"].dataType
    bounds = spark.read.parquet(f"{path}/bounds").where("cell >= 0")
    sized = bounds.select("cell", F.ceil(F.col("n") / max(32, nearest.PACK_BYTES // (4 * centroids.shape[1]))).cast("int").alias("splits"))
    rows = spark.read.parquet(f"{path}/cells")
    asked = q.select("query_id", F.col("embedding").alias("query_vec"), "angles")

    def probed(start: int, n: int) -> DataFrame:
        return asked.select("query_id", "query_vec", F.explode(F.slice(ranked, start, n)["cell"]).alias("cell"))

    def met(pairs: DataFrame, floors: DataFrame | None = None) -> DataFrame:
        """The best rows of the cells of pairs (query_id, query_vec, cell), by packs of a cell's rows and of the queries that meet it."""
        pairs = pairs.withColumn("floor", F.lit(None).cast("double")) if floors is None else pairs.join(floors, "query_id", "left")
        pairs = keep(pairs, "index-pairs")
        most = pairs.groupBy("cell").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
        packs = nearest.query_packs(pairs, -(-most // nearest.QUERY_ROWS), "cell").join(F.broadcast(sized), "cell")
        packs = packs.withColumn("_v", F.explode(F.sequence(F.lit(0), F.col("splits") - 1))).drop("splits")
        some = rows.join(F.broadcast(pairs.select("cell").distinct()), "cell", "left_semi")  # at most MOST_CELLS
        own = nearest.classes(some, k, "cell").join(F.broadcast(sized), "cell").select(
            "cell", F.pmod(F.xxhash64("embedding"), F.col("splits")).cast("int").alias("_v"), F.struct("ids", "embedding").alias("row"),
        ).groupBy("cell", "_v").agg(F.collect_list("row").alias("v"))
        return nearest.best_in_packs(packs.join(own, ["cell", "_v"]).withColumn("pack", F.concat_ws("-", "cell", "_pack")), k, *kinds)

    # The nearest cell's k-th score is the least that counts in the others, so these pass few rows on.
    floor = lambda best: best.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    best = top_k(met(probed(1, 1)), "query_id", "score", "id", k)
    if probes > 1:
        best = keep(best, "index-nearest")
        best = top_k(best.drop("rank").unionByName(met(probed(2, probes - 1), floor(best))), "query_id", "score", "id", k)
    if not exact:
        return best
    best = keep(best, "index-first")
    # With fewer than k rows found, every cell may hold one more.
    reach = F.acos(F.greatest(F.lit(-1.0), F.col("floor") - ROUNDING))
    own = F.element_at("angles", F.col("cell") + 1)
    open_ = asked.join(floor(best), "query_id", "left").withColumn("_reach", reach).join(F.broadcast(bounds), F.col("_reach").isNull() | own.between(F.col("lo") - F.col("_reach") - SLACK, F.col("hi") + F.col("_reach") + SLACK))
    second = open_.select("query_id", "query_vec", "cell").join(probed(1, probes).select("query_id", "cell"), ["query_id", "cell"], "left_anti")
    return top_k(best.drop("rank").unionByName(met(second, floor(best))), "query_id", "score", "id", k)


def index_recall(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """The share of wanted (query_id, id) that was found, as a one-row frame: queries, recall."""
    hit = wanted.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("_hit")), ["query_id", "id"], "left")
    return hit.agg(F.countDistinct("query_id").alias("queries"), F.avg(F.coalesce("_hit", F.lit(0))).alias("recall"))


def new_index(vectors: DataFrame, cells: int | None = None) -> str:
    """The path of an index over vectors, written to the shared folder."""
    path = new_path(vectors.sparkSession, "vector-index")
    write_index(vectors, path, cells)
    return path


