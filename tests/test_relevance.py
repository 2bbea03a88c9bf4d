"""Judgements by classes against the same as pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import evaluation as E
from corvane.operators import fusion as U
from corvane.operators import retrieval as R
from corvane.operators import trust as X
from corvane.operators.relevance import Classes
from corvane.plans.catalogue import QUERIES


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def judged(spark):
    """60 documents of 5 classes and one without, 8 queries, the last with a class nobody has."""
    docs = spark.createDataFrame([(i, i % 5 if i % 11 else None) for i in range(60)], "doc_id long, label int")
    gains = spark.createDataFrame([(q, q % 5 if q < 35 else 9, 2) for q in range(0, 40, 5)] + [(q, (q + 1) % 5, 1) for q in range(0, 35, 5)], "query_id long, label int, gain int")
    pairs = docs.join(gains, "label").where("doc_id <> query_id").select("query_id", "doc_id", "gain")
    lists = spark.createDataFrame([(c, q, (q * 7 + r * m) % 60, 1.0 / r, r) for c, m in (("a", 7), ("b", 13)) for q in range(0, 40, 5) for r in range(1, 15)], "channel string, query_id long, doc_id long, score double, rank long")
    return Classes(docs, gains), pairs, lists


def test_classes_give_what_their_pairs_give(spark, judged):
    classes, pairs, lists = judged
    good = pairs.where("gain = 2")
    for dialect in E.DIALECTS:
        assert rows(E.binary_metrics(lists, classes.only(2), lists, (3, 10), dialect=dialect)) == rows(E.binary_metrics(lists, good, lists, (3, 10), dialect=dialect))
    assert rows(E.graded_ndcg(lists, classes, (2, 5, 14))) == rows(E.graded_ndcg(lists, pairs, (2, 5, 14)))
    binary = Classes(classes.docs, classes.gains.withColumn("gain", F.col("gain") - 1))
    assert rows(E.bpref(lists, binary)) == rows(E.bpref(lists, pairs.select("query_id", "doc_id", (F.col("gain") - 1).alias("relevant"))))
    assert rows(E.coverage(lists, classes, (4, 9))) == rows(E.coverage(lists, pairs, (4, 9)))
    assert rows(U.oracle_recall(lists, classes.only(2), (4, 9))) == rows(U.oracle_recall(lists, good, (4, 9)))
    assert rows(U.features(lists, ("a", "b"), relevant=classes.only(2))) == rows(U.features(lists, ("a", "b"), relevant=good))
    one = lists.where("channel = 'a'")
    each = E.miss_buckets(good, one, [("near", 3), ("far", 14)]).groupBy("query_id", "bucket").agg(F.count("*").alias("n"))
    assert rows(E.miss_counts(classes.only(2), one, [("near", 3), ("far", 14)])) == rows(each)
    marked = Classes(classes.docs.withColumn("junk", F.col("doc_id") % 3 == 0), classes.gains).only(2)
    assert rows(X.contamination_by_class(marked, "junk")) == rows(X.contamination(good, classes.docs.where("doc_id % 3 = 0")))


def test_classes_never_list_their_pairs(spark):
    """20,000 documents of one class for 1,000 queries are 20 million pairs; sizes are a row for each query."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("label"))
    gains = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "label", F.lit(2).alias("gain"))
    sizes = Classes(docs, gains).sizes()
    assert sizes.agg(F.count("*"), F.min("n"), F.max("n")).first() == (1000, 19_999, 19_999)
    lists = gains.select("query_id", ((F.col("query_id") + 1) % 20_000).alias("doc_id"), F.lit(1).cast("long").alias("rank"))
    assert Classes(docs, gains).marked(lists).where("gain = 2").count() == 1000


def test_slices_of_queries_share_one_shuffle(spark, monkeypatch):
    """Ranked slice by slice, the task of a union sorts once for each slice: its memory grows with the queries."""
    rng = np.random.default_rng(1)
    docs = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(300)], "doc_id long, vec array<double>")
    asked = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("query_id"), F.col("vec").alias("qvec"))
    whole = [rows(R.exact(docs, asked, metric, 5)) for metric in ("ip", "l2")] + [rows(R.lsh_search(docs, asked, 5))]
    monkeypatch.setattr(R, "QUERY_SLICE", 10)
    found = [R.exact(docs, asked, metric, 5) for metric in ("ip", "l2")] + [R.lsh_search(docs, asked, 5)]
    assert [rows(df) for df in found] == whole
    for df in found:
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("MapInArrow") >= 5 and plan.count("Window [") == 1


def test_the_channel_is_searched_once_for_training_pairs(spark, monkeypatch):
    """A search is written before positives and negatives are taken from it, and the scorer learns from the channel's lists."""
    sf, asked, search = "/root/testdata/sf0.001", [], R._product
    kernel = lambda sent, metric, *rest: asked.append(metric) or search(sent, metric, *rest)
    monkeypatch.setattr(R, "_product", kernel)
    pairs = QUERIES["u12_training_pairs"](spark, sf)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert asked == ["ip"] and "MapInArrow" not in plan
    asked.clear()
    QUERIES["u12_pairwise_training"](spark, sf)
    assert asked == ["ip", "l2"]


def test_a_pairwise_fit_reads_written_differences(spark, monkeypatch):
    """The fit reads its rows more than once; their joins are done once."""
    df = spark.createDataFrame([(q, d, float(d), 1.0) for q in range(4) for d in range(5)], "query_id long, doc_id long, a double, b double")
    pairs = df.where("doc_id > 0").select("query_id", F.col("doc_id").alias("positive"), (F.col("doc_id") - 1).alias("negative"))
    names, write = [], U.cached
    monkeypatch.setattr(U, "cached", lambda spark, df, name: names.append(name) or write(spark, df, name))
    U.pairwise_scores(df, pairs, ["a", "b"])
    assert names == ["pair-gaps"]
