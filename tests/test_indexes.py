"""The stored indexes: what they find, what they read and skip, and how their work grows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import graph_index as G
from corvane.operators import lexical_index as I
from corvane.operators import retrieval as R
from corvane.operators import vector_index as V
from corvane.sources.files import scratch, stored


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def files_read(df):
    """How many files the scan of an executed plan without shuffles opened."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().get("numFiles").get().value()


# ---- lexical


@pytest.fixture(scope="module")
def topics(spark):
    """Documents whose chunks differ: each run of 64 has words of its own, and a few words are everywhere."""
    text = lambda i: " ".join([f"w{i // 64}x{j % 5}" for j in range(3 + i % 7)] + ["every"] * (i % 4) + [f"rare{i % 500}"])
    return spark.createDataFrame([(i, text(i), "ab"[i % 2]) for i in range(1600)] + [(5000, None, "a"), (5001, "", "b"), (None, "every", "a")], "doc_id long, text string, grp string").coalesce(1)


def test_index_equals_a_scan_and_skips_blocks(spark, topics):
    index = I.build(topics.select("doc_id", "text"), chunk_docs=64)
    asked = spark.createDataFrame([(1, "w3x1 every"), (2, "rare7 every every"), (3, "w9x0 w9x1 w20x2"), (4, "nothing here"), (5, None)], "query_id long, text string")
    found, tally = I.walked(index, asked, 10)
    scan = R.top_k(R.bm25(topics.where("doc_id is not null").select("doc_id", "text"), asked), 10)
    assert rows(R.top_k(found, 10), "query_id", "doc_id", "score", "rank") == rows(scan, "query_id", "doc_id", "score", "rank")
    met, skipped = tally.agg(F.sum("met"), F.sum("skipped")).first()
    assert 0 < skipped < met
    print("blocks met", met, "skipped", skipped)


def test_index_by_group_with_shares_and_without_a_cut(spark, topics):
    docs = topics.where("doc_id is not null").select("grp", "doc_id", "text")
    index = I.build(docs, by=["grp"], chunk_docs=100)
    asked = spark.createDataFrame([(1, "w3x1 every"), (2, "w0x0 w0x1 w0x2 rare1")], "query_id long, text string")
    for k, share in ((None, 0.5), (7, 0.5)):
        names = ["grp", "query_id", "doc_id", "score", "much"]
        got, want = rows(I.search(index, asked, k, share), *names), rows(R.bm25(docs, asked, by=["grp"], k=k, share=share), *names)
        best = lambda found: {r[:4] for r in found if k is None or r[4]}
        assert best(got) == best(want)
    overlap = {(r.query_id, r.doc_id): r.overlap for r in I.search(index, asked, None).collect()}
    assert overlap[1, 198] == 1.0 and overlap[2, 1] == 1.0 and min(overlap.values()) > 0


def test_searches_read_only_the_folders_of_their_terms(spark, topics):
    index = I.build(topics.select("doc_id", "text"), parts=32)
    every = index.table(spark, "postings")
    part = every.where(F.col("term") == "rare7").select("part").first()[0]
    assert 0 < files_read(every.where(F.col("part").isin(part))) < files_read(every) / 8


def test_blocks_are_written_once_and_not_shuffled(spark, topics, monkeypatch):
    """Only counts of terms are shuffled, and the blocks lie in one table, in files of the tasks that made them."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    made, write = [], I._write_apart
    monkeypatch.setattr(I, "_write_apart", lambda df, *rest: made.append(df) or write(df, *rest))
    index = I.build(topics.select("doc_id", "text").repartition(3), chunk_docs=64, parts=4)
    assert made[0]._jdf.queryExecution().sparkPlan().toString().count("Exchange") <= 1  # the texts' own
    every = index.table(spark, "postings")
    assert {"docs", "tfs", "dls"} <= set(every.columns) and spark.conf.get(name) == before
    assert every.where("part = -1").agg(F.sum("n")).first()[0] == 1602 and every.where("part >= 0 and term is null").isEmpty()
    assert not spark._jvm.java.io.File(index.path.removeprefix("file:") + "/blocks").exists()


def test_a_changed_corpus_gets_a_new_index(spark):
    path = scratch(spark, "corpus")
    spark.createDataFrame([(1, "old words")], "doc_id long, text string").write.parquet(path)
    first = I.index_of(spark.read.parquet(path))
    assert I.index_of(spark.read.parquet(path)) is first
    spark.createDataFrame([(2, "new words")], "doc_id long, text string").write.mode("append").parquet(path)
    asked = spark.createDataFrame([(1, "words")], "query_id long, text string")
    assert rows(I.search(I.index_of(spark.read.parquet(path)), asked, None), "doc_id") == [(1,), (2,)]


def test_index_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "words")], "query_id long, text string")
    assert I.search(I.build(docs), asked, 5).collect() == []


# ---- cells


def vectors(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(e) for e in v]) for i, v in zip(ids, x, strict=True)], "doc_id long, vec array<double>")


def queries(df, where):
    return df.where(where).select(F.col("doc_id").alias("query_id"), F.col("vec").alias("qvec"))


def clustered(n, width=12, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, width)) * 4
    return centres[rng.integers(0, 20, n)] + rng.normal(size=(n, width)) * 0.3


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_cells_find_what_a_scan_finds_and_read_less(spark, metric):
    df = vectors(spark, clustered(2000))
    asked = queries(df, "doc_id % 100 = 0")
    index = V.build_cells(df, 20)
    true = rows(R.exact(df, asked, metric, 10), "query_id", "doc_id", "score", "rank")
    everything, touched = V.search_cells(index, asked, 20, 10, metric)
    assert rows(everything, "query_id", "doc_id", "score", "rank") == true
    assert {r.touched for r in touched.collect()} == {2000}
    complete, touched = V.search_cells(index, asked, 2, 10, metric, complete=True)
    assert rows(complete, "query_id", "doc_id", "score", "rank") == true
    if metric == "l2":
        assert touched.agg(F.avg("touched")).first()[0] < 600
        few, touched = V.search_cells(index, asked, 2, 10, metric)
        assert len(set(rows(few, "query_id", "doc_id")) & {r[:2] for r in true}) >= 0.95 * len(true)
        assert touched.agg(F.avg("touched")).first()[0] < 500


def test_a_search_opens_only_probed_cells(spark):
    index = V.build_cells(vectors(spark, clustered(1000)), 20)
    whole = files_read(index.cells(spark))
    assert 0 < files_read(index.cells(spark).where(F.col("cell").isin(3, 4))) < whole / 4
    one = queries(vectors(spark, clustered(1000)), "doc_id = 7")
    read = []
    scan = V.CellIndex.cells
    watched = lambda self, session: read.append(scan(self, session)) or read[-1]
    V.CellIndex.cells = watched
    try:
        found, touched = V.search_cells(index, one, 1, 5)
        assert found.count() == 5 and len(read) == 1
    finally:
        V.CellIndex.cells = scan
    assert 0 < touched.first()["touched"] < 1000 / 4


def test_cells_with_copies_and_unusable_rows(spark):
    x = np.tile([1.0, 2.0, 3.0], (300, 1))
    df = vectors(spark, x).unionByName(spark.createDataFrame([(900, None), (901, []), (902, [1.0, None, 1.0]), (903, [math.nan, 0.0, 0.0]), (904, [1.0]), (None, [1.0, 2.0, 3.0])], "doc_id long, vec array<double>"))
    found = V.search_cells(V.build_cells(df, 8), queries(df, "doc_id in (5, 900, 904)"), 8, 4)[0]
    assert rows(found, "query_id", "doc_id", "rank") == [(5, 0, 1), (5, 1, 2), (5, 2, 3), (5, 3, 4)]
    empty = df.limit(0)
    assert V.search_cells(V.build_cells(empty, 4), queries(df, "doc_id = 5"), 2, 3)[0].collect() == []


# ---- late interaction


def test_max_sim_over_ragged_masked_tokens(spark):
    rng = np.random.default_rng(4)
    table = [(d, p, rng.normal(size=6).tolist(), bool(p == 0 or rng.random() < 0.7)) for d in range(200) for p in range(1 + d % 5)]
    table += [(300, 0, [9.0] * 6, False), (301, 0, None, True), (302, 0, [9.0] * 6, None)]
    tokens = spark.createDataFrame(table, "doc_id long, position long, vec array<double>, mask boolean")
    asked = tokens.where("doc_id % 40 = 4").withColumnRenamed("doc_id", "query_id")
    index = V.build_tokens(tokens, 10)
    by = {}
    for d, _, v, m in table:
        if m and v:
            by.setdefault(d, []).append(v)
    want = []
    for q in (4, 44, 84, 124, 164):
        score = {d: round(float((np.array(by[q]) @ np.array(v).T).max(1).sum()), 6) for d, v in by.items() if d != q}
        want += [(q, d, score[d], r) for r, d in enumerate(sorted(score, key=lambda d: (-score[d], d))[:8], 1)]
    assert [r[:2] + r[3:] for r in rows(V.max_sim(index, asked, 8), "query_id", "doc_id", "score", "rank")] == sorted(w[:2] + w[3:] for w in want)
    through_all = V.max_sim(index, asked, 8, probes=10, depth=1000)
    assert rows(through_all, "query_id", "doc_id", "rank") == sorted((q, d, r) for q, d, _, r in want)
    few = V.max_sim(index, asked, 8, probes=5, depth=60)
    assert len(set(rows(few, "query_id", "doc_id")) & {w[:2] for w in want}) >= 0.8 * len(want)


# ---- graph


def curved(n, seed=1):
    """Vectors of 24 numbers that vary in five directions."""
    rng = np.random.default_rng(seed)
    return np.tanh(rng.normal(size=(n, 5)) @ rng.normal(size=(5, 24))) + 0.01 * rng.normal(size=(n, 24))


def test_graph_finds_the_nearest_with_little_work_that_grows_slowly(spark):
    work = {}
    for n in (1000, 4000):
        df = vectors(spark, curved(n)).repartition(4)
        asked = queries(df, f"doc_id % {n // 40} = 0")
        index = G.knn_graph(df, degree=10)
        found, distances = G.graph_search(index, asked, 10, beam=24)
        true = set(rows(R.exact(df, asked, "l2", 10), "query_id", "doc_id"))
        recall = len(set(rows(found, "query_id", "doc_id")) & true) / len(true)
        work[n] = distances.agg(F.avg("distances")).first()[0]
        print("vectors", n, "recall", recall, "distances", work[n])
        assert recall >= 0.9
    assert work[4000] < 4000 / 5
    assert math.log(work[4000] / work[1000]) / math.log(4) < 0.5


def test_graph_corners(spark):
    x = np.vstack([np.tile([1.0, 2.0], (700, 1)), [[5.0, 5.0], [5.0, 6.0]]])
    df = vectors(spark, x).unionByName(spark.createDataFrame([(900, None), (901, [1.0, None]), (902, [1.0]), (None, [1.0, 1.0]), (700, [5.0, 5.0])], "doc_id long, vec array<double>"))
    index = G.knn_graph(df, degree=6, rounds=2)
    longest = index[0].agg(F.max(F.size("links"))).first()[0]
    assert longest <= 2 * 6 * 3  # copies make no hub
    found, _ = G.graph_search(index, queries(df, "doc_id in (3, 900, 902)"), 5, beam=8)
    assert {r.query_id for r in found.collect()} == {3} and {r.score for r in found.collect()} == {0.0}
    assert G.graph_search(G.knn_graph(df.limit(0)), queries(df, "doc_id = 3"), 5, 8)[0].collect() == []
    alone = G.knn_graph(df.where("doc_id = 3"))
    assert G.graph_search(alone, queries(df, "doc_id = 701"), 5, 8)[0].count() == 1


def test_stored_is_built_once(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/region.parquet")
    made = []
    build = lambda: made.append(1) or len(made)
    assert stored(df, "test", build) == stored(df, "test", build) == 1
    assert stored(df, "other", build) == 2
