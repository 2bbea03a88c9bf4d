"""Fusion models trained in place: against differences, a plain fit, and each other on held-out queries."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import fusion as U
from corvane.operators import networks as N


def pooled(spark, queries=12, seed=4):
    """Labels follow a feature with noise; one feature is noise, one is constant, one is missing at times."""
    r = random.Random(seed)
    rows = [(q, d, float(y + r.gauss(0, 0.4)), r.random(), 3.0, y + r.gauss(0, 1) if r.random() < 0.8 else None, y) for q in range(queries) for d in range(20) for y in [int(d < 7)]]
    return spark.createDataFrame(rows, "query_id long, doc_id long, a double, b double, c double, d double, label int"), rows


def test_gradient_against_differences():
    r = np.random.default_rng(1)
    widths, x, y = [4, 5, 3, 1], r.normal(size=(9, 4)), r.integers(0, 2, 9).astype(float)
    masks = [(r.random((9, h)) >= 0.3) / 0.7 for h in widths[1:-1]]
    flat = N.initial(widths, 2) + r.normal(0, 0.1, len(N.initial(widths, 2)))
    _, g = N.loss_and_gradient(flat, widths, x, y, 2.5, masks)
    for k in range(len(flat)):
        step = np.zeros(len(flat))
        step[k] = 1e-6
        up, down = (N.loss_and_gradient(flat + s, widths, x, y, 2.5, masks)[0] for s in (step, -step))
        assert g[k] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_first_move_of_adamw():
    """The first corrected step is the rate in the gradient's direction, after decay."""
    moved = N.AdamW(2, 0.1, 0.5).moved(np.array([1.0, 2.0]), np.array([3.0, -0.01]))
    assert moved == pytest.approx([1 - 0.05 - 0.1, 2 - 0.1 + 0.1], abs=1e-6)


def test_stats_of_the_other_folds(spark):
    df, _ = pooled(spark)
    rows = N.with_folds(df, ["a", "b", "c", "d"], 3)
    total, ones, mean, spread = N.training_stats(rows, 4, 3)
    held = [(r.fold, r._x, r._y) for r in rows.select("fold", "_x", "_y").collect()]
    for f in range(3):
        x = np.array([v for g, v, _ in held if g != f])
        assert total[f] == len(x) and ones[f] == sum(y for g, _, y in held if g != f)
        assert mean[f] == pytest.approx(x.mean(0)) and spread[f] == pytest.approx(np.where(x.std(0) > 0, x.std(0), 1))


def ndcg(rows):
    """Mean over queries of (query, probability, label) rows."""
    out = []
    for q in {r[0] for r in rows}:
        labels = [y for _, _, y in sorted((r for r in rows if r[0] == q), key=lambda r: -r[1])]
        out.append(sum(y / math.log2(k + 2) for k, y in enumerate(labels)) / sum(1 / math.log2(k + 2) for k in range(sum(labels))))
    return sum(out) / len(out)


def test_network_ranks_held_out_queries_as_well_as_logistic(spark):
    df, rows = pooled(spark, 20)
    columns = ["a", "b", "c", "d"]
    kept = lambda out: [(r.query_id, r.probability, int(r.label)) for r in out.collect()]
    out = N.cross_validated_network(df, columns, 3, hidden=(8,), steps=1, rate=0.02).cache()
    network, logistic = kept(out), kept(U.cross_validated(df.fillna(0.0), columns, "logistic", 3))
    assert len(network) == len(rows) and all(0 <= p <= 1 for _, p, _ in network)
    assert out.columns == [*df.columns, "fold", "probability"]
    assert out.groupBy("query_id").agg(F.count_distinct("fold").alias("n")).where("n > 1").isEmpty()
    assert ndcg(network) >= ndcg(logistic) - 0.02 and ndcg(network) > 0.9
    again = N.cross_validated_network(df, columns, 3, hidden=(8,), steps=1, rate=0.02)
    assert sorted(p for _, p, _ in kept(again)) == pytest.approx(sorted(p for _, p, _ in network), abs=1e-6)


def test_network_corners(spark):
    df, _ = pooled(spark, 2)
    assert N.cross_validated_network(df.limit(0), ["a"], 2, epochs=1).count() == 0
    odd = df.withColumn("label", F.when(F.col("doc_id") == 0, F.lit(None)).when(F.col("doc_id") == 1, 7).otherwise(F.col("label")))
    assert N.cross_validated_network(odd, ["a", "d"], 2, epochs=1, steps=1).where("probability between 0 and 1").count() == 40


def plain_logistic(x, y, weight, reg):
    z, c = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    penalty = np.append(np.full(x.shape[1], reg), 1e-12)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ c))
        c -= np.linalg.solve((z.T * (weight * p * (1 - p))) @ z / weight.sum() + np.diag(penalty), z.T @ (weight * (p - y)) / weight.sum() + penalty * c)
    return c


def test_search_equals_plain_fits(spark):
    df, _ = pooled(spark)
    rows = N.with_folds(df, ["a", "b", "d"], 3)
    settings = [{"reg": 0.01, "balance": 1.0, "max_iter": 20}, {"reg": 0.3, "balance": 0.0, "max_iter": 20}]
    got = N.search_logistic(rows, 3, 3, settings)
    held = [(r.fold, r._x, r._y) for r in rows.select("fold", "_x", "_y").collect()]
    for k, s in enumerate(settings):
        for f in range(3):
            x, y = np.array([v for g, v, _ in held if g != f]), np.array([y for g, _, y in held if g != f])
            c = plain_logistic((x - x.mean(0)) / x.std(0), y, np.where(y == 1, ((1 - y).sum() / y.sum()) ** s["balance"], 1.0), s["reg"])
            slope = c[:-1] / x.std(0)
            assert got[k, f] == pytest.approx(np.append(slope, c[-1] - slope @ x.mean(0)), abs=1e-5)


def test_leaderboard_by_ndcg(spark):
    df, rows = pooled(spark)
    settings = [{"reg": r, "balance": 1.0, "max_iter": m} for r, m in ((0.01, 20), (100.0, 1), (0.01, 0))]
    relevant = df.where("label = 1").select("query_id", "doc_id")
    board = N.logistic_leaderboard(df, ["a", "b", "c", "d"], settings, relevant, 3).collect()
    assert {r.setting for r in board} == {0, 1, 2} and [r.value for r in sorted(board, key=lambda r: r["rank"])] == sorted((r.value for r in board), reverse=True)
    # without a step all scores are equal, and ids decide: the relevant ones come first here
    assert next(r.value for r in board if r.setting == 2) == 1.0
    flat = N.logistic_leaderboard(df.withColumn("doc_id", -F.col("doc_id")), ["a"], settings, relevant.withColumn("doc_id", -F.col("doc_id")), 3)
    assert flat.where("rank = 1").first()["setting"] in (0, 1)
