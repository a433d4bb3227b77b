"""Cases in which an operator once did less than its whole job."""

import numpy as np

W = [f"w{i}" for i in range(400)]


def test_quality_keeps_strata_apart_beyond_64(spark):
    from tamarack.llm.quality import quality_rules

    rng = np.random.default_rng(11)
    text = lambda mark: " ".join(rng.choice(W, 60, replace=False)) + mark
    # In "odd" the good documents are full of symbols; in "en" the bad ones are. 70 more languages have a row each.
    odd = [(i, text(" ###" * 20), "odd", 1) for i in range(900)]
    en = [(1000 + i, text(" ###" * 20 if i % 5 == 0 else ""), "en", int(i % 5 != 0)) for i in range(12000)]
    rare = [(20000 + i, text(""), f"l{i}", None) for i in range(70)]
    for rows in (odd + en, odd + en + rare):
        docs = spark.createDataFrame([(i, t, x) for i, t, x, _ in rows], "doc_id long, text string, lang string")
        labels = spark.createDataFrame([(i, q) for i, _, _, q in rows if q is not None], "doc_id long, quality int")
        got = {r.doc_id: r for r in quality_rules(docs, labels).collect()}
        assert len(got) == len(rows)
        assert all(got[i].kept == (q != 0) for i, _, _, q in rows)
        assert "symbol_ratio" in got[1000].failed_rules


def test_toxicity_at_every_prior(spark):
    from tamarack.llm.toxicity import toxicity

    rng = np.random.default_rng(12)
    for share in (0.5, 0.7):
        for mark in (" you awful moron", None):
            # With a mark, toxic documents have its words; without, they say the same in capitals.
            y = rng.random(800) < share
            text = [" ".join(rng.choice(W, 60)) for _ in y]
            text = [(t + mark if mark else "SO " + t.replace("w", "WORDS")) if bad else (t if mark else "so " + t.replace("w", "words")) for t, bad in zip(text, y, strict=True)]
            docs = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")
            labels = spark.createDataFrame([(i, int(bad)) for i, bad in enumerate(y)], "doc_id long, toxic int")
            got = {r.doc_id: r for r in toxicity(docs, labels).collect()}
            assert sum(got[i].predicted != bad for i, bad in enumerate(y)) <= 16


def test_pipeline_decontaminates_each_row_on_its_own(spark, tmp_path):
    import corpus_pipeline

    item = " ".join(W[60:90])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    half, rest = " ".join(W[60:76]), " ".join(W[71:90])
    rows = [(None, f"so {item} there"), (None, "clean"), (None, None), (1, f"a {item}"), (1, "clean namesake"), (2, half), (2, rest), (3, item), (3, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = [(r.doc_id, r.text) for r in corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).collect()]
    assert sorted(left, key=str) == sorted([rows[1], rows[2], rows[4], rows[5], rows[6]], key=str)


def shingles(text, k):
    w = (text or "").lower().encode().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def all_pairs(rows, k, pct):
    """The component of each row, by comparing every two of them."""
    sets, up = [shingles(t, k) for _, t in rows], list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= pct * len(x | sets[j]):
                up[max(root(i), root(j))] = min(root(i), root(j))
    return sets, [root(i) for i in range(len(rows))]


def families():
    """Rows of several families of near copies, some without doc_id, with repeats and rows without words."""
    rng = np.random.default_rng(13)
    rows, n = [(None, ""), (None, ""), (None, None), (5000, " "), (5000, " "), (5001, None), (None, "lone words of a null id"), (5002, "w1 w2"), (5003, "W1 w2")], 0
    for f, size in enumerate((60, 90, 200, 30, 120, 64)):
        base = [f"f{f}x{i}" for i in range(size)]
        for c in range(25):
            w = list(base)
            for at in rng.choice(size, rng.integers(0, max(2, size // 20)), replace=False):
                w[at] = f"c{c}y{at}"
            if f == 1 and c % 3 == 0:
                w = w[: size // 2] + [f"f2x{i}" for i in range(100)]
            n += 1
            rows.append((None if f == 0 or (f < 4 and c % 4 == 1) else n, " ".join(w)))
    return rows + [rows[20], rows[20], rows[70], rows[70]]


def test_jaccard_query_and_stage_against_all_pairs(spark, tmp_path):
    import corpus_pipeline

    from __spark_entry__ import queries

    rows = families()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    sets, root = all_pairs(rows, 4, 85)
    least = {r: min((i for (i, _), q in zip(rows, root, strict=True) if q == r and i is not None), default=None) for r in root}
    want = [(i, len(s), least[r] if s else i) for (i, _), s, r in zip(rows, sets, root, strict=True)]
    got = [tuple(r) for r in queries()["op5_ngram_jaccard_join"](spark, str(tmp_path)).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(set(root)) > 10

    sets, root = all_pairs(rows, 5, 80)
    left = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()]
    kept = {r: [x for x in left if x in {y for y, q in zip(rows, root, strict=True) if q == r}] for r, s in zip(root, sets, strict=True) if s}
    for r, some in kept.items():
        ids = [i for (i, _), q in zip(rows, root, strict=True) if q == r and i is not None]
        assert len(some) == 1 and some[0][0] == min(ids, default=None)
    assert sorted([x for x in left if not shingles(x[1], 5)], key=str) == sorted([x for x in rows if not shingles(x[1], 5)], key=str)
