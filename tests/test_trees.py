"""Boosted trees against a plain reading of their definition, and both ways of learning them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import fusion as U


def made(spark, queries=24, docs=25, seed=5):
    r = np.random.default_rng(seed)
    rows = []
    for q in range(queries):
        for d in range(docs):
            a, b = int(r.integers(0, 9)), int(r.integers(0, 6))
            rows.append((q, d, float(a), float(b), int(r.random() < (0.8 if (a > 4) != (b > 2) else 0.2))))
    return spark.createDataFrame(rows, "query_id long, doc_id long, a double, b double, label int").repartition(3)


def scores(df):
    return {(r.query_id, r.doc_id): r.probability for r in df.collect()}


def grown(x, y, w, margin, depth, least, rate):
    """One tree, as a function of a row: the split of largest gain, or the leaf's Newton step."""
    p = 1 / (1 + np.exp(-margin))
    g, h = w * (p - y), w * p * (1 - p)

    def node(at, depth):
        best = (1e-9, None)
        for k in range(x.shape[1]) if depth else ():
            for cut in np.unique(x[at, k])[:-1]:
                left, right = at[x[at, k] <= cut], at[x[at, k] > cut]
                if min(len(left), len(right)) >= least:
                    gain = sum(g[i].sum() ** 2 / h[i].sum() for i in (left, right)) - g[at].sum() ** 2 / h[at].sum()
                    if gain > best[0] + 1e-9:
                        best = (gain, (k, cut, left, right))
        if best[1] is None:
            value = -rate * g[at].sum() / h[at].sum()
            return lambda row: value
        k, cut, left, right = best[1]
        low, high = node(left, depth - 1), node(right, depth - 1)
        return lambda row: low(row) if row[k] <= cut else high(row)

    return node(np.arange(len(y)), depth)


def test_trees_are_those_of_their_definition(spark):
    df = made(spark)
    got = U.cross_validated(df, ["a", "b"], "gbt", 3, iterations=4, depth=3).collect()
    for fold in range(3):
        train, held = [r for r in got if r.fold != fold], [r for r in got if r.fold == fold]
        x, y = np.array([[r.a, r.b] for r in train]), np.array([r.label for r in train])
        w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
        margin, z = np.zeros(len(y)), np.zeros(len(held))
        for _ in range(4):
            tree = grown(x, y, w, margin, 3, 20, 0.1)
            margin, z = margin + [tree(row) for row in x], z + [tree((r.a, r.b)) for r in held]
        assert held and np.allclose(1 / (1 + np.exp(-z)), [r.probability for r in held], atol=1e-9)


def test_whole_number_of_rounds_unless_said(spark):
    df = made(spark).cache()
    whole, few = scores(U.cross_validated(df, ["a", "b"], "gbt", 2)), scores(U.cross_validated(df, ["a", "b"], "gbt", 2, iterations=20))
    assert len(whole) == 600 and max(abs(whole[k] - few[k]) for k in whole) > 0.01
    assert whole == scores(U.cross_validated(df, ["a", "b"], "gbt", 2, iterations=150, depth=4))


def test_step_by_step_learning_gives_the_same(spark, monkeypatch):
    from corvane.operators import trees

    df = made(spark, seed=6).cache()
    at_once = scores(U.cross_validated(df, ["a", "b"], "gbt", 3, iterations=5, depth=2))
    monkeypatch.setattr(trees, "HELD", 0)
    monkeypatch.setattr(trees, "WRITTEN", 2)
    steps = scores(U.cross_validated(df, ["a", "b"], "gbt", 3, iterations=5, depth=2))
    assert at_once.keys() == steps.keys() and max(abs(at_once[k] - steps[k]) for k in steps) < 1e-9


@pytest.mark.parametrize("held", [1 << 20, 0])
def test_trees_of_odd_tables(spark, monkeypatch, held):
    from corvane.operators import trees

    monkeypatch.setattr(trees, "HELD", held)
    df = made(spark, 4, 10)
    fit = lambda df: U.cross_validated(df, ["a", "b"], "gbt", 2, iterations=2)
    assert fit(df.limit(0)).count() == 0
    odd = df.withColumn("a", F.when(F.col("doc_id") > 3, F.col("a"))).withColumn("label", F.when(F.col("doc_id") != 5, F.col("label")))
    assert fit(odd).where("probability between 0 and 1").count() == 40
    assert fit(df.withColumn("label", F.lit(1))).where("probability > 0.99").count() == 40
    assert fit(df.where("query_id = 1")).where("probability = 0.5").count() == 10
