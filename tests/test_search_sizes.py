"""Searches against brute force at odd sizes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import graph_index as G
from corvane.operators import retrieval as R
from corvane.operators import vector_index as V


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def vectors(spark, n, width, copies=1, seed=4):
    x = np.random.default_rng(seed).normal(size=(n, width))
    return spark.createDataFrame([(int(i + n * c), x[i].tolist()) for c in range(copies) for i in range(n)], "doc_id long, vec array<double>")


def asked(df, where):
    return df.where(where).select(F.col("doc_id").alias("query_id"), F.col("vec").alias("qvec"))


@pytest.mark.parametrize("metric", ["ip", "l2", "max_sim"])
def test_scan_by_small_blocks(spark, monkeypatch, metric):
    df = vectors(spark, 300, 4, copies=2).repartition(2)
    q = asked(df, "doc_id % 10 = 0")
    whole = rows(R.exact(df, q, metric, 9, 2))
    monkeypatch.setattr(R, "BLOCK", 500)
    assert rows(R.exact(df, q, metric, 9, 2)) == whole and len(whole) == 60 * 9


def test_hashing_loses_no_neighbour(spark):
    """Two tables of narrow buckets part most neighbours; copies are as far as their originals."""
    df = vectors(spark, 1500, 3, copies=2).repartition(3)
    q = asked(df, "doc_id % 40 = 0")
    got = [(r.query_id, r.rank, r.doc_id) for r in R.lsh_search(df, q, 7, radius=0.9, bucket=0.05, tables=2).orderBy("query_id", "rank").collect()]
    held = sorted((r.doc_id, r.vec) for r in df.collect())
    want = []
    for i, v in held:
        if i % 40 == 0:
            near = sorted((float(np.sqrt(((np.array(u) - np.array(v)) ** 2).sum())), j) for j, u in held if j != i)
            want += [(i, r, j) for r, (d, j) in enumerate(near[:7], 1) if d < 0.9]
    assert got == want


def share(found, true):
    pairs = lambda df: {(r.query_id, r.doc_id) for r in df.collect()}
    return len(pairs(found) & pairs(true)) / len(pairs(true))


def test_late_interaction_is_as_deep_as_recall_needs(spark):
    tokens = vectors(spark, 3000, 8).select((F.col("doc_id") / 3).cast("long").alias("doc_id"), (F.col("doc_id") % 3).alias("position"), "vec", F.lit(True).alias("mask"))
    index = V.build_tokens(tokens, 8)
    q = tokens.where("doc_id % 10 = 0").withColumnRenamed("doc_id", "query_id")
    true = V.max_sim(index, q, 10)
    assert share(V.max_sim(index, q, 10, probes=6, depth=2), true) < 0.9
    assert share(V.max_sim(index, q, 10, probes=6, depth=2, recall=0.95), true) >= 0.9
    assert share(V.max_sim(index, q, 10, probes=8, depth=100, recall=0.9), true) >= 0.9


def test_graph_is_as_wide_as_recall_needs(spark):
    df = vectors(spark, 1500, 32)
    index, q = G.knn_graph(df), asked(df, "doc_id % 30 = 0")
    true = R.exact(df, q, "l2", 10)
    assert share(G.graph_search(index, q, 10, 10)[0], true) < 0.9
    found, distances = G.graph_search(index, q, 10, 10, recall=0.95)
    assert share(found, true) >= 0.9 and distances.count() == 50


def test_graph_of_many_shards_takes_few_jobs(spark, monkeypatch):
    """A walk's steps are no jobs of Spark, and shards and slices of queries lose nothing: a beam over all of a shard is exact."""
    context = spark.sparkContext
    df = vectors(spark, 2000, 8).repartition(3)
    q = asked(df, "doc_id % 20 = 0")
    monkeypatch.setattr(G, "NUMBERS", 600, raising=False)

    def jobs(name, call):
        context.setJobGroup(name, name)
        out = call()
        context.setJobGroup("others", "others")
        return out, len(context.statusTracker().getJobIdsForGroup(name))

    index, building = jobs("building", lambda: G.knn_graph(df))
    (found, distances), walking = jobs("walking", lambda: G.graph_search(index, q, 10, 100))
    assert index[0].select("shard").distinct().count() == 27
    assert building <= 12 and walking <= 16
    ranked = lambda df: [(r.query_id, r.rank, r.doc_id) for r in df.orderBy("query_id", "rank").collect()]
    assert ranked(found) == ranked(R.exact(df, q, "l2", 10))
    assert distances.count() == 100
