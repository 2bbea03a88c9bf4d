"""Hand-computed values, and properties the metrics must have."""

import math

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import dedup as D
from corvane.operators import evaluation as E
from corvane.operators import fusion as U
from corvane.operators import labelling as L
from corvane.operators import retrieval as R
from corvane.operators import stats as S

RANKED = "channel string, query_id long, doc_id long, score double, rank long"


def ranked(spark, rows):
    return spark.createDataFrame(rows, RANKED)


def test_rrf(spark):
    lists = ranked(spark, [("x", 1, 1, 0.0, 1), ("x", 1, 2, 0.0, 2), ("x", 1, 3, 0.0, 3), ("y", 1, 2, 0.0, 1), ("y", 1, 4, 0.0, 2)])
    out = {r.doc_id: (r.rank, r.score) for r in U.rrf(lists).collect()}
    assert [out[d][0] for d in (2, 1, 4, 3)] == [1, 2, 3, 4]
    assert out[2][1] == pytest.approx(1 / 62 + 1 / 61, abs=1e-8)


def test_binary_metrics(spark):
    lists = ranked(spark, [("x", 1, 1, 0.0, 1), ("x", 1, 2, 0.0, 2), ("x", 1, 3, 0.0, 3)])
    rel = spark.createDataFrame([(1, 1), (1, 3)], "query_id long, doc_id long")
    q = spark.createDataFrame([(1,), (2,)], "query_id long")
    out = {(r.query_id, r.k): r for r in E.binary_metrics(lists, rel, q, (3, 10)).collect()}
    assert out[1, 3].ndcg == pytest.approx(0.919721, abs=1e-6)
    assert out[1, 10].precision == pytest.approx(0.2)
    assert (out[2, 3].precision, out[2, 3].recall, out[2, 3].ndcg) == (0, 0, 0)
    none = {(r.query_id, r.k): r for r in E.binary_metrics(lists, rel, q, (3,), dialect="C").collect()}
    assert none[2, 3].recall is None and none[2, 3].precision == 0
    short = {(r.query_id, r.k): r for r in E.binary_metrics(lists, rel, q, (10,), dialect="B").collect()}
    assert short[1, 10].precision == pytest.approx(2 / 3, abs=1e-6)


def test_graded_ndcg(spark):
    lists = ranked(spark, [("x", 1, 1, 0.0, 1), ("x", 1, 2, 0.0, 2)])
    gains = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "query_id long, doc_id long, gain int")
    assert E.graded_ndcg(lists, gains, (2,)).first().ndcg == pytest.approx((1 + 2 / math.log2(3)) / (2 + 1 / math.log2(3)), abs=1e-6)


def test_bpref(spark):
    lists = ranked(spark, [("x", 1, d, 0.0, d) for d in (1, 2, 3, 4)])
    judged = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (1, 3, 0), (1, 4, 1)], "query_id long, doc_id long, relevant int")
    assert E.bpref(lists, judged).first().bpref == 0.25


def test_kappa(spark):
    rows = [(0, 0)] * 20 + [(0, 1)] * 5 + [(1, 0)] * 10 + [(1, 1)] * 15 + [(None, 1)]
    out = S.kappa(spark.createDataFrame(rows, "a int, b int"), "a", "b").first()
    assert (out.n, out.observed, out.expected, out.kappa) == (50, 0.7, 0.5, 0.4)


def test_wilcoxon(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 2.0), (3.0, 0.0), (4.0, 0.0), (5.0, 5.0)], "a double, b double")
    out = S.wilcoxon(df, "a", "b").first()
    assert (out.n, out.w_plus, out.w_minus, out.statistic) == (4, 8, 2, 2)


def signed_rank_p(d):
    """By going through all signs."""
    from itertools import product

    sizes = sorted(map(abs, d))
    rank = {s: sum(i for i, x in enumerate(sizes, 1) if x == s) / sizes.count(s) for s in sizes}
    ranks = [rank[abs(x)] for x in d]
    least = min(sum(r for r, x in zip(ranks, d, strict=True) if x > 0), sum(r for r, x in zip(ranks, d, strict=True) if x < 0))
    return min(1.0, 2 * sum(sum(r for r, on in zip(ranks, signs, strict=True) if on) <= least for signs in product((0, 1), repeat=len(d))) / 2 ** len(d))


@pytest.mark.parametrize("d", [[1, -2, 3, 4], [1, 1, 1, 1, 1, 1], [2, -2, 2, 2, -1, 3, 3, 5], [1, -1], [-4, -3, 7, 8, 9, 10, 11, 12, -2]])
def test_exact_p_of_wilcoxon(spark, d):
    df = spark.createDataFrame([(float(x), 0.0) for x in [*d, 0]], "a double, b double")
    assert S.wilcoxon(df, "a", "b").first().p == round(signed_rank_p(d), 6)


def test_normal_p_of_wilcoxon(spark):
    import math

    d = [(-1) ** (k % 3) * (k + 0.5) for k in range(80)]
    out = S.wilcoxon(spark.createDataFrame([(x, 0.0) for x in d], "a double, b double"), "a", "b").first()
    z = (out.statistic - 80 * 81 / 4 + 0.5) / math.sqrt(80 * 81 * 161 / 24)
    assert abs(out.p - math.erfc(-z / math.sqrt(2))) < 2e-6
    assert S.wilcoxon(spark.createDataFrame([(1.0, 1.0)], "a double, b double"), "a", "b").first().p == 1.0


def test_bootstrap_holds_the_mean(spark):
    df = spark.range(400).select("id", (F.col("id") % 5).cast("double").alias("a"), F.lit(1.0).alias("b"))
    out = S.bootstrap(df, "a", "b", "id", 500).first()
    assert out.low < 1.0 < out.high and out.high - out.low < 0.5


def test_spearman_with_ties(spark):
    df = spark.createDataFrame([(1, float(x), float(y)) for x, y in ((1, 1), (2, 2), (2, 3), (4, 4), (5, 5), (6, 7), (7, 6))], "g int, x double, y double")
    assert 0.9 < S.spearman(df, "x", "y", "g").first().spearman < 1


def test_uncertainty_order(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.45), (1, 3, 0.52)], "query_id long, doc_id long, p double")
    out = L.uncertain(df, df.limit(0), 3).orderBy("n").collect()
    assert [r.doc_id for r in out] == [3, 2, 1]


def test_calibration_bins(spark):
    df = spark.createDataFrame([(0.1, 1), (0.1001, 0), (0.0, 0), (1.0, 1)], "p double, y int")
    assert {r.bin: r.n for r in E.calibration(df).collect()} == {1: 2, 2: 1, 10: 1}


def test_rerank_head_keeps_tail(spark):
    lists = ranked(spark, [("x", 1, d, 0.0, d) for d in (1, 2, 3, 4)]).drop("channel")
    second = spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.9)], "query_id long, doc_id long, second double")
    out = R.rerank_head(lists, second, 2).orderBy("new_rank").collect()
    assert [r.doc_id for r in out] == [2, 1, 3, 4]


def test_rich_text_skips_null_and_blank(spark):
    df = spark.createDataFrame([("a", None, " "), (None, "b", "c"), (None, None, None)], "x string, y string, z string")
    out = df.select(T.rich_text([("X:", F.col("x")), ("", F.col("y")), ("Z:", F.col("z"))]).alias("t")).collect()
    assert [r.t for r in out] == ["X: a", "b | Z: c", ""]


def test_judge_reply(spark):
    df = spark.createDataFrame([('so {"label": 2, "reason": "x"} end',), ("nothing",), ('{"label": "?"}',), (None,)], "r string")
    out = [r.j for r in df.select(T.judge_reply(F.col("r")).alias("j")).collect()]
    assert [o.label for o in out] == [2, None, None, None] and out[1].reason.startswith("UNPARSEABLE: ")


def test_pair_key_round_trip(spark):
    df = spark.createDataFrame([(7, "a::b")], "q long, d string")
    out = df.select(T.split_pair_key(T.pair_key(F.col("q"), F.col("d"))).alias("s")).first().s
    assert (out.query_id, out.key) == (7, "a::b")


def test_tiers_are_nested(spark):
    df = spark.range(100).withColumn("old", F.col("id") < 10)
    out = D.nested_tiers(df, "id", F.col("old"), {"a": 5, "b": 30, "c": 60})
    n = out.agg(*[F.sum(F.col(c).cast("int")).alias(c) for c in "abc"], F.sum((F.col("b") & ~F.col("c")).cast("int")).alias("outside")).first()
    assert (n.a, n.b, n.c, n.outside) == (10, 30, 60, 0)


def test_folds_are_disjoint_by_query(spark):
    df = spark.range(200).withColumn("q", F.col("id") % 20).withColumn("f", D.fold_of("q", 5))
    assert df.groupBy("q").agg(F.count_distinct("f").alias("n")).where("n > 1").count() == 0


def test_bm25_against_plain_python(spark):
    texts = {1: "a b b c", 2: "b c d", 3: "a a a", 4: ""}
    queries = {1: "a b", 2: "b zz"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    qs = spark.createDataFrame(list(queries.items()), "query_id long, text string")
    got = {(r.query_id, r.doc_id): r.score for r in R.bm25(docs, qs).collect()}
    words = {d: t.split() for d, t in texts.items()}
    n, avgdl = len(words), sum(map(len, words.values())) / len(words)
    vocab = {w for ws in words.values() for w in ws}
    idf = {w: math.log(n - (df := sum(w in ws for ws in words.values())) + 0.5) - math.log(df + 0.5) for w in vocab}
    floor = 0.25 * sum(idf.values()) / len(idf)
    for q, text in queries.items():
        for d, ws in words.items():
            s = sum((idf[w] if idf[w] >= 0 else floor) * ws.count(w) * 2.5 / (ws.count(w) + 1.5 * (0.25 + 0.75 * len(ws) / avgdl)) for w in text.split() if w in ws)
            if any(w in ws for w in text.split()):
                assert got[q, d] == pytest.approx(s, abs=1e-5)
            else:
                assert (q, d) not in got


def test_rerank_keeps_recall_at_depth(spark):
    lists = ranked(spark, [("x", 1, d, 0.0, d) for d in range(1, 9)]).drop("channel")
    second = spark.createDataFrame([(1, d, float(d)) for d in range(1, 9)], "query_id long, doc_id long, second double")
    assert {r.doc_id for r in R.rerank_head(lists, second, 8).where("new_rank <= 8").collect()} == set(range(1, 9))


@pytest.mark.parametrize(("kind", "params"), [("logistic", {}), ("gbt", {"iterations": 3, "depth": 3}), ("mlp", {"max_iter": 30, "hidden": 4})])
def test_cross_validated_models(spark, kind, params):
    import random

    r = random.Random(4)
    rows = [(q, d, float(y + r.gauss(0, 0.4)), r.random(), y) for q in range(12) for d in range(20) for y in [int(d < 7)]]
    df = spark.createDataFrame(rows, "query_id long, doc_id long, a double, b double, label int").cache()
    out = U.cross_validated(df, ["a", "b"], kind, 3, **params).collect()
    assert len(out) == len(rows) and all(0 <= x.probability <= 1 for x in out)
    assert all(len({x.fold for x in out if x.query_id == q}) == 1 for q in range(12))
    good, bad = [x.probability for x in out if x.label == 1], [x.probability for x in out if x.label == 0]
    assert sum(g > b for g in good for b in bad) >= 0.85 * len(good) * len(bad)


def test_parameter_search_orders_settings(spark):
    settings = U.random_settings({"reg": [0.01, 10.0], "max_iter": [20]}, 5)
    assert len(settings) == 2 and U.random_settings({"x": range(100)}, 40, 1) == U.random_settings({"x": range(100)}, 40, 1)
    df = spark.createDataFrame([(q, d, float(d % 2), d % 2) for q in range(6) for d in range(10)], "query_id long, doc_id long, a double, label int").cache()
    value = lambda s: s.agg((1 - F.avg(F.abs(F.col("probability") - F.col("label")))).alias("value"))
    board = U.leaderboard(df, ["a"], settings, value, folds=2).collect()
    assert "0.01" in board[0].parameters and board[0].value > board[1].value


def test_bpref_and_ndcg_keep_queries_without_results(spark):
    lists = ranked(spark, [("x", 1, 1, 0.0, 1)])
    judged = spark.createDataFrame([(1, 1, 1), (2, 5, 1), (2, 6, 0), (3, 7, 0)], "query_id long, doc_id long, relevant int")
    assert {r.query_id: r.bpref for r in E.bpref(lists, judged).collect()} == {1: 1.0, 2: 0.0, 3: None}
    gains = judged.select("query_id", "doc_id", F.col("relevant").alias("gain"))
    assert {r.query_id: r.ndcg for r in E.graded_ndcg(lists, gains, (5,)).collect()} == {1: 1.0, 2: 0.0, 3: 0.0}


def test_workbook_round_trip(spark, tmp_path):
    from corvane.sources.workbook import read_workbook, write_workbook

    rows = [(1, "a & <b>\n ü", 0.5), (2, None, None), (3, "", -1e-7), (None, " spaced ", 2.0)]
    write_workbook(spark.createDataFrame(rows, "id long, text string, x double"), path := f"file://{tmp_path}/r.xlsx")
    got = [tuple(r) for r in read_workbook(spark, path, "x double, text string, id long, none string").collect()]
    assert got == [(x, t, i, None) for i, t, x in rows]
    with pytest.raises(ValueError):
        write_workbook(spark.range(5), path, rows=4)


def test_pairwise_scores_put_pairs_in_order(spark):
    import random

    r = random.Random(9)
    rows = [(q, d, (d < 5) + r.gauss(0, 0.2) + 10 * q, r.random()) for q in range(8) for d in range(15)]
    df = spark.createDataFrame(rows, "query_id long, doc_id long, a double, b double")
    pairs = spark.createDataFrame([(q, g, b) for q in range(8) for g in range(5) for b in range(5, 15)], "query_id long, positive long, negative long")
    score = {(x.query_id, x.doc_id): x.score for x in U.pairwise_scores(df, pairs, ["a", "b"]).collect()}
    assert len(score) == len(rows)
    assert sum(score[q, g] > score[q, b] for q in range(8) for g in range(5) for b in range(5, 15)) >= 0.95 * 8 * 50
