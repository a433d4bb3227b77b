"""Importance resampling, Merkle manifest, token files and the packing plan against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

W = [f"w{i}" for i in range(300)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, part long, n long, score long, tree string"


def rows():
    rng = np.random.default_rng(11)
    some = lambda n: " ".join(rng.choice(W, n))
    out = [(i, some(int(rng.integers(1, 60))) + ("\nline\n" if i % 3 else ""), "en", ["a", "é", "B", None, "hot"][min(i % 9, 4)], i, "x") for i in range(180)]
    out += [(500, None, None, None, None, "x"), (501, "", "de", "", 0, "x"), (502, "Straße ÄÖ ǅ ABC-abc_9 \x00 z", "de", "lone", 5, "x"), (503, W[1] + " " + "\n" * 300, "en", "a", 3, "x")]
    out += [(7, "same id other text\n", "en", "hot", 1, "x"), (None, "no id\n", "en", "hot", 1, "x"), (None, None, None, None, None, "x"), (12, out[12][1], "en", out[12][3], 12, "x")]
    out.append((504, " ".join(W * 200), "en", "hot", 1, "x"))
    return out


ROWS = rows()


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("round"))
    spark.createDataFrame([(*r, 1, 2, 3, "t") for r in ROWS], SCHEMA).repartition(5).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, " ".join(W[:40])), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def query(spark, sf, name):
    from __spark_entry__ import queries

    return [tuple(r) for r in queries()[name](spark, sf).collect()]


def features(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    return len(w), [zlib.crc32(x.encode()) % 10000 for x in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]]


def resampled(docs, items):
    s, t = Counter(), Counter()
    for _, x, *_ in docs:
        s.update(features(x)[1])
    for x in items:
        t.update(features(x)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + 10000) / ((s[b] + 1) * (n_t + 10000)))) for b in range(10000)]
    out = []
    for i, x, *_ in docs:
        n, f = features(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: len(able) * 25 // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_importance(spark, sf):
    want = resampled(ROWS, [" ".join(W[:40]), None, ""])
    assert sorted(query(spark, sf, "op11_importance_resampling"), key=str) == want and sum(r[4] is not None for r in want) > 30


def test_importance_odd_tables(spark, sf):
    from tamarack.llm.importance import importance_resample

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = spark.createDataFrame([], "item_id long, text string")
    assert importance_resample(docs.limit(0), items).count() == 0
    got = importance_resample(docs, items).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=str) == resampled(ROWS, [])
    assert importance_resample(docs, items, runs=3).where("doc_id = 504").first().n_features == 3 * 60_000 - 3


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def up(nodes):
    """All levels of the tree over nodes."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def path(tree, i):
    out = []
    for level in tree[:-1]:
        run = level[i // 3 * 3 : i // 3 * 3 + 3]
        out.append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
        i //= 3
    return out


def manifest(docs):
    by = {}
    for i, text, lang, source, n, *_ in docs:
        row = (i, source, lang, n, text)
        bad = (*row[:4], text.replace("\n", "")) if text is not None and i is not None and zlib.crc32(str(i).encode()) % 2 == 0 else row
        by.setdefault(source, []).append((i is not None, i or 0, leaf(row), leaf(bad), i))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: up([x[2] for x in sorted(by[s])]) for s in names}
    top = up([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for j, (_, _, own, bad, i) in enumerate(sorted(by[s])):
            steps = path(trees[s], j) + path(top, k)
            node = bad
            for before, after in steps:
                node = H(before, node, after)
            out.append((i, own, trees[s][-1][0], top[-1][0], H(*(a + b for a, b in steps)), node, node == top[-1][0]))
    return sorted(out, key=str)


def test_merkle(spark, sf):
    got = sorted(query(spark, sf, "op12_merkle_manifest"), key=str)
    assert got == manifest(ROWS) and {r[6] for r in got} == {True, False}


@pytest.mark.parametrize(("height", "top"), [(1, 1), (2, 5), (1, 8), (3, 40)])
def test_merkle_rounds(spark, height, top):
    """Several rounds of blocks, and more sources than the driver takes."""
    from tamarack.llm.merkle import fold, merkle_manifest

    docs = [*ROWS, *((1000 + i, f"t{i}", "en", f"s{i % 50}", i, "x") for i in range(120))]
    df = spark.createDataFrame([(*r, 1, 2, 3, "t") for r in docs], SCHEMA)
    r = merkle_manifest(df, height, top).withColumn("folded", fold(*_columns("leaf", "path")))
    want = {(x[0], x[1]): x[2:4] for x in manifest(docs)}
    got = r.collect()
    assert len(got) == len(docs)
    assert all(want[x.doc_id, x.leaf] == (x.subroot, x.root) and x.folded == x.root for x in got)


def _columns(*names):
    from pyspark.sql import functions as F

    return [F.col(c) for c in names]


def test_merkle_small_tables(spark):
    from tamarack.llm.merkle import merkle_manifest

    one = spark.createDataFrame([(1, "t", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    r = merkle_manifest(one).first()
    assert r.leaf == r.subroot == r.root and r.path == [] and merkle_manifest(one.limit(0)).count() == 0


def test_token_file(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    t, want, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), [], 0
    got = query(spark, sf, "op13_token_file")
    starts = {}
    for i, x, *_ in ROWS:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, len(ids), zlib.crc32(ids.tobytes())))
    assert sorted((r[0], r[2], r[3]) for r in got if r[0] is not None) == sorted(w for w in want if w[0] is not None)
    assert sorted((r[2], r[3]) for r in got if r[0] is None) == sorted(w[1:] for w in want if w[0] is None)
    for r in sorted(got, key=lambda r: (r[1])):
        assert r[1] == at
        at += r[2]
        starts.setdefault(r[0], r[1])
    order = [r[0] for r in sorted(got, key=lambda r: r[1])]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))


def test_token_file_blocks(spark, sf, tmp_path):
    import public_tokenizers

    from tamarack.llm.token_file import read_tokens, token_table, write_tokens

    p = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    write_tokens(docs, p, str(tmp_path / "a"), block_ids=500, file_blocks=2)
    write_tokens(docs, p, str(tmp_path / "b"))
    key = lambda path: sorted(map(tuple, token_table(spark, path).collect()), key=str)
    assert key(str(tmp_path / "a")) == key(str(tmp_path / "b"))
    assert read_tokens(spark, str(tmp_path / "a")).select("part", "block").distinct().count() > 20
    write_tokens(docs.limit(0), p, str(tmp_path / "c"))
    assert token_table(spark, str(tmp_path / "c")).count() == 0


def test_variable_length_coding():
    from tamarack.llm.token_file import decode_ranks, encode_ranks, pack_block, unpack_blocks

    rng = np.random.default_rng(2)
    for sizes in ([0], [1], [4], [5, 0, 1000, 3, 8, 1]):
        docs = [(2 ** rng.uniform(0, 32, n)).astype(np.uint32) for n in sizes]
        control, ends, data, stops = encode_ranks(np.concatenate(docs), np.array(sizes))
        assert np.diff(ends, prepend=0).tolist() == [-(-n // 4) for n in sizes] and stops[-1] == len(data)
        assert (decode_ranks(control, data, np.array(sizes)) == np.concatenate(docs)).all()
        for k in range(len(sizes)):
            own = decode_ranks(np.split(control, ends)[k], np.split(data, stops)[k], np.array(sizes[k : k + 1]))
            assert (own == docs[k]).all()
    control, _, data, _ = encode_ranks(np.array([1, 300], np.uint32), np.array([2]))
    block = pack_block(3, 1, [(None, 2, control.tobytes(), data.tobytes()), (5, 0, b"", b"")]) + b"\n"
    ((part, number, keys, present, lengths, ranks),) = unpack_blocks(memoryview(block))
    assert (part, number, keys[1], present.tolist(), lengths.tolist(), ranks.tolist()) == (3, 1, 5, [0, 1], [2, 0], [1, 300])
    for bad in (block[:-1], block[:20], b"X" + block[1:], block + b"rest"):
        with pytest.raises(ValueError, match="token"):
            list(unpack_blocks(memoryview(bad)))


def test_long_blank_runs_are_encoded():
    import public_tokenizers
    from tokenizers import Tokenizer

    from tamarack.llm.tokens import encoder

    p = public_tokenizers.path("byte_bpe_50k.json")
    t, encode = Tokenizer.from_file(p), encoder(p)
    for x in (" " * 1_000_000 + "a", "\n" * 1_000_000, "a" * 100_000, "<|endoftext|> x", ""):
        assert encode([x])[0].tolist() == t.encode(x, add_special_tokens=False).ids


def histograms():
    rng = np.random.default_rng(0)
    for k in (10**4, 10**5, 10**6):
        h = np.ones(1024, np.int64)
        h[[5, 300, 719, 1000]] = k
        yield h
    yield np.r_[0, rng.integers(0, 10**7, 1023)]
    yield np.r_[0, (1e9 / np.arange(1, 1024)).astype(np.int64)]
    yield np.r_[0, rng.poisson(10**6, 1023)]
    yield np.zeros(1024, np.int64)
    yield np.bincount([700], minlength=1024) * 10**6


@pytest.mark.parametrize("k", range(8))
def test_plan_has_constant_size(k):
    import time

    from tamarack.llm.packing import plan

    h = list(histograms())[k]
    h[0] = 0
    began = time.process_time()
    ranges, stream, planned = plan(h)
    assert time.process_time() - began < 10 and sum(map(len, ranges.values())) < 10_000
    fill = np.zeros(planned + 1, np.int64)
    position = 0
    for r in sorted(stream, reverse=True):
        at = 0
        for lo, hi, sequence, offset in ranges.get(r, []):
            assert lo == at and offset + r <= 1024
            np.add.at(fill, [sequence, sequence + hi - lo], [r, -r])
            at = hi
        assert stream[r] == (at, position)
        position += (h[r] - at) * r
    assert (np.cumsum(fill)[:-1] == 1024).all() and planned * 1024 + position == (h * np.arange(1024)).sum()


def test_packed_pieces(spark):
    """Small sequences over random texts, whole rows: gapless sequences, gapless documents, at most one with padding."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from tamarack.llm.packing import pack

    p = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(p)
    docs = spark.createDataFrame([(k, r[1]) for k, r in enumerate(ROWS)], "doc_id long, text string").repartition(4)
    for size in (8, 16, 64):
        got = pack(docs, p, size=size).collect()
        seq, doc = {}, {}
        for r in got:
            seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
            doc.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
        assert sorted(seq) == list(range(len(seq)))
        for k, x in seq.items():
            ends = np.cumsum([n for _, n in sorted(x)])
            assert [o for o, _ in sorted(x)] == [0, *ends[:-1]] and (ends[-1] == size or k == max(seq))
        for k, r in enumerate(ROWS):
            ids = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
            assert b"".join(b for _, b in sorted(doc[k])) == ids.tobytes()


def test_components_of_edges_that_differ_between_evaluations(spark):
    """A task's spanning forest may be another one each time that it is computed; no node may lose its links by that."""
    from pyspark.sql import functions as F

    from tamarack.llm.graph import components

    def forest(frames):
        import random

        import pandas as pd

        for pdf in frames:
            for i in pdf["id"]:
                nodes = [f"{i}-{k}".encode() for k in range(6)]
                random.SystemRandom().shuffle(nodes)
                yield pd.DataFrame({"a": nodes[:-1], "b": nodes[1:]})

    edges = spark.range(40).mapInPandas(forest, "a binary, b binary")
    got = components(edges).select(F.col("node").cast("string").alias("n"), F.col("label").cast("string").alias("l")).collect()
    assert {r.n: r.l for r in got} == {f"{i}-{k}": f"{i}-0" for i in range(40) for k in range(6)}
