"""Token ids in binary files: frequency-ranked, byte-aligned variable-length coding with separate control bytes (operator 13).

Ids are replaced by their rank by frequency over all documents, so that the commonest 256 take one byte and all others of
a vocabulary of up to 65,536 take two. A group of four ranks has one control byte, two bits for each rank's number of
bytes (a document's last group may have fewer ranks); control bytes and data bytes lie apart, so that a block is decoded by
numpy table lookups without a loop over ids. Documents are coded before they are sorted, so the shuffle moves coded bytes.

Files. `dictionary` holds the ids in order of rank. `blocks` holds files of blocks, each closed by a line feed (Spark's
text writer writes the bytes as they are, through its own committer, to any file system that Spark reaches). A block is
HEADER (magic, range, block in the range, documents, control bytes, data bytes; little-endian), the documents' ids (8 bytes each),
whether they are present (1 byte), their numbers of ids (8 bytes), the control bytes and the data bytes. Documents ascend
by doc_id over ranges, blocks and rows in a block. A range is one task's; a block has about BLOCK_IDS ids, a file
FILE_BLOCKS blocks.

Defined cases: a null or empty text has the end id alone; null doc_ids come first; repeated rows are written each;
equal doc_ids are in order of a hash of their texts; extra columns are ignored; an empty table gives a dictionary without
entries and no block. A file that is cut or has foreign bytes raises ValueError.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, new_path, offsets, remove, remove_path, slices, small, table, tune
from .tokens import encoder

END_ID = 2
BLOCK_IDS = 1 << 20
FILE_BLOCKS = 32
HEADER = struct.Struct("<4sIIIQQ")
MAGIC, CLOSE = b"TKVB", b"\n"
#: Bytes of each of the four ranks that a control byte stands for.
WIDTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


def encode_ranks(ranks: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of documents of these lengths, in a row: control bytes, where each document's end, data bytes, where each document's end."""
    wide = np.ascontiguousarray(ranks, "<u4")
    code = (wide >= 1 << 8).astype(np.uint8) + (wide >= 1 << 16) + (wide >= 1 << 24)
    data = wide.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    lengths = lengths.astype(np.int64)
    groups, ends = np.cumsum(-(-lengths // 4)), np.cumsum(lengths)
    four = np.zeros((int(groups[-1]) if len(groups) else 0, 4), np.uint8)
    shift = 4 * np.concatenate([[0], groups[:-1]]) - (ends - lengths)  # a document's first rank begins a group
    four.reshape(-1)[np.arange(len(wide)) + np.repeat(shift, lengths)] = code
    sizes = np.concatenate([[0], np.cumsum(code + np.int64(1))])
    return (four << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8), groups, data, sizes[ends]


def decode_ranks(control: np.ndarray, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ranks of documents of these lengths from their control and data bytes (uint8)."""
    groups = -(-lengths.astype(np.int64) // 4)
    if len(control) != groups.sum():
        raise ValueError("token block: control bytes and lengths differ")
    place = np.arange(4 * int(groups.sum())) - np.repeat(4 * (np.cumsum(groups) - groups), 4 * groups)
    width = WIDTHS[control].reshape(-1)[place < np.repeat(lengths.astype(np.int64), 4 * groups)]
    start = np.cumsum(width, dtype=np.int64) - width
    if int(width.sum(dtype=np.int64)) != len(data):
        raise ValueError("token block: data bytes and control bytes differ")
    ranks = data[start].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(width > k)
        ranks[more] |= data[start[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def pack_block(part: int, block: int, docs: list[tuple[int | None, int, bytes, bytes]]) -> bytes:
    """docs: doc_id, number of ids, control bytes, data bytes."""
    keys, lengths = np.array([d[0] or 0 for d in docs], "<i8"), np.array([d[1] for d in docs], "<u8")
    present = np.array([d[0] is not None for d in docs], np.uint8)
    control, data = (b"".join(d[i] for d in docs) for i in (2, 3))
    head = HEADER.pack(MAGIC, part, block, len(docs), len(control), len(data))
    return b"".join((head, keys.tobytes(), present.tobytes(), lengths.tobytes(), control, data))


def unpack_blocks(content: memoryview) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """range, block, doc_ids, whether they are present, lengths and ranks of each block of a file."""
    at = 0
    while at < len(content):
        if len(content) - at < HEADER.size:
            raise ValueError("token file: cut in a header")
        magic, part, block, docs, groups, size = HEADER.unpack_from(content, at)
        at += HEADER.size
        ends = np.cumsum([8 * docs, docs, 8 * docs, groups, size]) + at
        if magic != MAGIC or ends[-1] + 1 > len(content) or content[int(ends[-1])] != CLOSE[0]:
            raise ValueError("token file: no whole block where one should be")
        cut = lambda i, kind: np.frombuffer(content[(int(ends[i - 1]) if i else at) : int(ends[i])], kind)  # noqa: B023, E731
        lengths = cut(2, "<u8")
        yield part, block, cut(0, "<i8"), cut(1, np.uint8), lengths, decode_ranks(cut(3, np.uint8), cut(4, np.uint8), lengths)
        at = int(ends[-1]) + 1


def tokenized(docs: DataFrame, tokenizer: str, end_id: int | None = END_ID) -> DataFrame:
    """doc_id, th (hash of the text) and ids (little-endian unsigned 32-bit), the end id last."""
    tune(docs.sparkSession)
    end = np.array([] if end_id is None else [end_id], np.uint32)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("th"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            for b in slices(batch, "text"):
                ids = [np.concatenate([x, end]).astype("<u4").tobytes() for x in encode(b.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.binary())], names=["doc_id", "th", "ids"])

    return rows.mapInArrow(run, "doc_id long, th long, ids binary")


def id_counts(tokens: DataFrame) -> DataFrame:
    """id, n over all rows; a task sends each id that it has once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            found = np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), "<u4"))
            if len(found) > len(total):
                found[: len(total)] += total
                total = found
            else:
                total[: len(found)] += found
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], names=["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _binary(body: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary array of the slices of body that end there."""
    offsets = np.concatenate([[0], ends])
    kind = pa.binary() if offsets[-1] < 1 << 31 else pa.large_binary()
    offsets = offsets.astype(np.int32 if kind == pa.binary() else np.int64)
    return pa.Array.from_buffers(kind, len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(body.tobytes())]).cast(pa.binary())


def _coded(rank_of: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "ids"):
                values = b.column("ids").to_pylist()
                lengths = np.array([len(x) // 4 for x in values], np.int64)
                control, ends, data, sizes = encode_ranks(rank_of[np.frombuffer(b"".join(values), "<u4")], lengths)
                columns = [pa.array(lengths), _binary(control, ends), _binary(data, sizes)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), *columns], names=["doc_id", "th", "n", "control", "data"])

    return run


def _one(value: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([value], pa.binary())], names=["value"])


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int | None = END_ID, block_ids: int = BLOCK_IDS, file_blocks: int = FILE_BLOCKS) -> None:
    """docs: doc_id, text. Writes dictionary and blocks under `path`."""
    spark = docs.sparkSession
    tokens = materialize(tokenized(docs, tokenizer, end_id), "tokens")
    counts = sorted(((-r.n, r.id) for r in id_counts(tokens).collect()))  # at most a row for each id of the vocabulary
    order = np.array([i for _, i in counts], "<u4")
    rank_of = np.zeros(int(order.max(initial=0)) + 1, np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    raw = lambda df: df.select(F.col("value").cast("string").alias("value")).write.option("compression", "none")
    raw(spark.createDataFrame([(bytearray(order.tobytes()),)], "value binary").coalesce(1)).text(f"{path}/dictionary")
    coded = tokens.mapInArrow(_coded(rank_of), "doc_id long, th long, n long, control binary, data binary")
    rows = coded.repartitionByRange("doc_id", "th").sortWithinPartitions("doc_id", "th").drop("th")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, held = TaskContext.get().partitionId(), 0, 0
        docs: list[tuple] = []
        for b in batches:
            for doc in zip(*(c.to_pylist() for c in b.columns), strict=True):
                docs.append(doc)
                held += doc[1]
                if held >= block_ids or len(docs) >= block_ids:
                    yield _one(pack_block(part, block, docs))
                    block, held, docs = block + 1, 0, []
        if docs:
            yield _one(pack_block(part, block, docs))

    out = raw(rows.mapInArrow(run, "value binary"))
    out.option("lineSep", CLOSE.decode()).option("maxRecordsPerFile", file_blocks).text(f"{path}/blocks")
    remove(tokens)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: part, block, doc_id, before (ids before it in the block), ids (unsigned 32-bit, little-endian)."""
    tune(spark)
    files = spark.read.format("binaryFile").load(f"{path}/dictionary").select("content").collect()
    id_of = np.frombuffer(bytes(files[0].content)[:-1], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                for part, block, keys, present, lengths, ranks in unpack_blocks(memoryview(content.as_buffer())):
                    ends = np.cumsum(lengths, dtype=np.int64)
                    ids = _binary(id_of[ranks].astype("<u4"), 4 * ends)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(lengths), part), pa.int64()), pa.array(np.full(len(lengths), block), pa.int64()),
                            pa.array(keys, pa.int64(), mask=present == 0), pa.array(ends - lengths.astype(np.int64), pa.int64()), ids,
                        ],
                        names=["part", "block", "doc_id", "before", "ids"],
                    )

    blocks = spark.read.format("binaryFile").load(f"{path}/blocks").select("content")
    return blocks.mapInArrow(run, "part long, block long, doc_id long, before long, ids binary")


def token_table(spark: SparkSession, path: str) -> DataFrame:
    """The files' documents: doc_id, start (ids before it in all files), n_tokens, ids_crc32."""
    rows = read_tokens(spark, path).select(
        "doc_id", "part", "block", "before", F.expr("length(ids) div 4").cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"),
    )
    rows = materialize(rows, "token-rows")
    blocks = materialize(rows.groupBy("part", "block").agg(F.sum("n_tokens").alias("n")), "token-blocks")
    inner = offsets(blocks, "block", by=("part",)).withColumnRenamed("base", "inner").drop("n")
    outer = offsets(blocks.groupBy("part").agg(F.sum("n").alias("n"))).select("part", F.col("base").alias("outer"))
    place = small(materialize(inner.join(F.broadcast(outer), "part"), "token-places"))
    start = (F.col("outer") + F.col("inner") + F.col("before")).alias("start")
    return rows.join(place, ["part", "block"]).select("doc_id", start, "n_tokens", "ids_crc32")


def op13_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "token-files")
    write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    r = token_table(spark, path)
    remove_path(spark, path)
    return r
