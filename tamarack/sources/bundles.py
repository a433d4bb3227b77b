"""Export and import of a tenant's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from ..functions.text import content_hash, normalized, safe_embedding, safe_salience, scrub
from ..operators import graph, memory, rules
from .tables import keep, small

TABLES = ("tombstones", "memories", "rules", "corrections")
MOST_PER_TABLE, MOST_ROWS, MOST_DIMENSIONS, MOST_DEPTH, VERSION = 5_000, 20_000, 4096, 8, 1


def masked(value: Column, kind: DataType, depth: int = 0) -> Column | None:
    """The value with secrets masked in all its strings, map keys included, down to MOST_DEPTH levels; None if it holds no string.
    Of map keys that become equal the last stays."""
    if depth > MOST_DEPTH:
        return None
    if isinstance(kind, StringType):
        return scrub(value)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: masked(x, kind.elementType, depth + 1)) if _has_text(kind.elementType, depth + 1) else None
    if isinstance(kind, MapType):
        one = lambda x, t: masked(x, t, depth + 1) if _has_text(t, depth + 1) else x
        entries = F.transform(
            F.map_entries(value),
            lambda e: F.struct(
                one(e["key"], kind.keyType).alias("key"), one(e["value"], kind.valueType).alias("value"),
            ),
        )
        keys = F.transform(entries, lambda e: e["key"])
        last = F.filter(entries, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.greatest(F.lit(0), F.size(keys) - i - 1)), e["key"]))
        return F.map_from_entries(last)
    if isinstance(kind, StructType) and _has_text(kind, depth):
        fields = [(masked(value[f.name], f.dataType, depth + 1) if _has_text(f.dataType, depth + 1) else value[f.name]).alias(f.name) for f in kind]
        return F.when(value.isNotNull(), F.struct(*fields))
    return None


def _has_text(kind: DataType, depth: int) -> bool:
    if depth > MOST_DEPTH:
        return False
    inner = [kind.elementType] if isinstance(kind, ArrayType) else [
        kind.keyType, kind.valueType,
    ] if isinstance(kind, MapType) else [f.dataType for f in kind] if isinstance(kind, StructType) else []
    return isinstance(kind, StringType) or any(_has_text(t, depth + 1) for t in inner)


def scrubbed(rows: DataFrame) -> DataFrame:
    """Secrets masked in every string, however deep in lists, maps and structs; vectors and numbers stay."""
    columns = {f.name: masked(F.col(f.name), f.dataType) for f in rows.schema if _has_text(f.dataType, 0)}
    return rows.withColumns(columns) if columns else rows


def export(memories: DataFrame, rule_table: DataFrame, corrections: DataFrame, tombstones: DataFrame) -> dict[str, DataFrame]:
    """Active memories with content, all rules, corrections and tombstones, without secrets."""
    kept = memory.active(memories).where(F.trim(F.coalesce("content", F.lit(""))) != "")
    return {"tombstones": tombstones, "memories": scrubbed(kept), "rules": scrubbed(rule_table), "corrections": scrubbed(corrections)}


def write_bundle(tables: dict[str, DataFrame], path: str) -> None:
    """One JSON folder per table."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def read_bundle(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schema).json(f"{path}/{name}") for name, schema in schemas.items()}


def check_size(bundle: dict[str, DataFrame], per_table: int | None = MOST_PER_TABLE, total: int | None = MOST_ROWS) -> dict[str, int]:
    """Rows of each table; a ValueError beyond the limits (None: no limit, for bulk loads)."""
    counts = {name: df.count() for name, df in bundle.items()}
    for name, n in counts.items():
        if per_table is not None and n > per_table:
            raise ValueError(f"{name}: {n} rows, at most {per_table}")
    if total is not None and sum(counts.values()) > total:
        raise ValueError(f"{sum(counts.values())} rows, at most {total}")
    return counts


def load(
    current: dict[str, DataFrame], bundle: dict[str, DataFrame], mode: str = "merge", version: int = VERSION,
    per_table: int | None = MOST_PER_TABLE, total: int | None = MOST_ROWS, blank: bool = False,
) -> dict[str, DataFrame]:
    """The tables after an import, in this order: tombstones, memories that none of them bars, rules, corrections. A ValueError
    for another mode or version, or beyond the limits (None: no limit, for bulk loads).

    Of a repeated tombstone the imported vector counts, also if it is null.
    replace drops the current memories, rules and corrections, but keeps tombstones. Memories merge by user and content
    without a rise in salience; of repeated ones the last id stays. Those without content are left out unless `blank`. Rules merge as rule upserts do (current ones first).
    """
    if mode not in ("merge", "replace"):
        raise ValueError(f"mode {mode}: merge or replace")
    if version != VERSION:
        raise ValueError(f"bundle of version {version}, not {VERSION}")
    if per_table is not None or total is not None:
        check_size(bundle, per_table, total)
    now = {n: (df.limit(0) if mode == "replace" and n != "tombstones" else df) for n, df in current.items()}
    new = bundle["tombstones"].groupBy("content_hash").agg(F.max("embedding").alias("embedding"))
    stones = keep(memory.upsert(now["tombstones"].select("content_hash", "embedding"), new, ["content_hash"], []), "tombstones")
    fit = F.when(F.size("embedding") <= MOST_DIMENSIONS, safe_embedding(F.col("embedding")))
    m = scrubbed(bundle["memories"]).where(
        F.lit(blank) | (F.trim(F.coalesce("content", F.lit(""))) != "")
    ).withColumn("embedding", fit).withColumn("salience", safe_salience(F.col("salience")))
    # A row is barred by itself: others of its id may have another content.
    m = keep(m.withColumn("_at", F.monotonically_increasing_id()), "imported")
    barred = memory.blocked(m, stones).select("_at").distinct()
    m = m.join(small(barred), "_at", "left_anti").withColumn("_k", normalized(F.col("content")))
    m = m.groupBy("user_id", "_k").agg(F.max_by(F.struct(*bundle["memories"].columns), "id").alias("m")).select("m.*")
    key = lambda d: d.withColumn("_k", F.sha1(F.concat_ws("|", "user_id", content_hash(F.col("content")))))
    memories = memory.upsert(key(now["memories"]), key(m), ["_k"], ["id"]).drop("_k")
    written = now["rules"].withColumn("_at", F.lit(0)).unionByName(scrubbed(bundle["rules"]).withColumn("_at", F.lit(1)), allowMissingColumns=True)
    corrections = graph.insert_new(now["corrections"], scrubbed(bundle["corrections"]), ["id"])
    return {"tombstones": stones, "memories": memories, "rules": rules.merge_writes(written, F.col("_at")), "corrections": corrections}
