"""The permutation indexes against brute force, the components, and the pipeline."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm.ann import nearest
from corvane.llm.components import components
from corvane.llm.neardup import near_duplicates

SCHEMA = "vec_id long, embedding array<float>"


def table(spark, vectors, ids=None):
    ids = list(range(len(vectors))) if ids is None else ids
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in zip(ids, vectors, strict=True)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("id", "node", "rank", "file", "links", "v", "asks", "vec", "size", "row", "key", "job"):
        df = df.withColumn(c, F.lit("clash"))
    return df




def odd(dim):
    return [None, [0.0] * dim, [float("nan")] + [1.0] * (dim - 1), [float("inf")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [1.0] * 3, []]


ODD = odd(16)


def clusters(n=600, dim=16, near=0.03, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(n // 6, dim))
    spread = r.choice([near, 0.25, 1.0], size=n)[:, None]
    x = centres[r.integers(0, len(centres), n)] + spread * r.normal(size=(n, dim))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


@pytest.mark.parametrize("options", [{}, {"block": 16}, {"setting": (6, 2)}, {"setting": (8, 3), "block": 7}, {"recall": 2}])
def test_near_duplicates(spark, options):
    x = clusters()
    x[17] = x[3]
    x[18] = x[3] * 2
    n = len(x)
    out = {r.vec_id: r for r in near_duplicates(table(spark, [*x, *ODD], [*range(10, n + 10 + len(ODD))]), **options).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    got = np.array([out[i + 10].n_links for i in range(n)])
    assert (got <= link.sum(1)).all() and got.sum() >= 0.9 * link.sum()
    assert got.sum() == link.sum() or "recall" not in options
    for i in range(n, n + len(ODD)):
        r = out[i + 10]
        assert (r.n_links, r.component_id, r.kept) == (0, i + 10, True)
    assert out[27].component_id == out[28].component_id == out[13].component_id
    assert all(r.kept == (r.vec_id == r.component_id) and r.component_id <= r.vec_id for r in out.values())


def test_near_duplicates_within_a_large_group(spark):
    x = with_group(4000, 1 / 3)
    got = {r.vec_id: r.n_links for r in near_duplicates(table(spark, x)).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    mine = np.array([got[i] for i in range(len(x))])
    assert (mine <= link.sum(1)).all() and mine.sum() >= 0.99 * link.sum()


def test_near_duplicates_corners(spark):
    assert near_duplicates(table(spark, [[1.0, 2.0]]).limit(0)).count() == 0
    rows = near_duplicates(table(spark, [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0]], [5, None, 5])).collect()
    assert sorted((r.vec_id or -1, r.n_links, r.component_id) for r in rows) == [(-1, 1, 5), (5, 0, 5), (5, 1, 5)]


@pytest.mark.parametrize("options", [{}, {"block": 64, "query_part": 7}, {"recall": 1, "block": 300}])
def test_nearest_recall_and_scores(spark, options):
    r = np.random.default_rng(2)
    x = r.normal(size=(2000, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    x[40] = x[41]
    ids = [i + 100 for i in range(len(x))]
    rows = nearest(table(spark, [*x, *odd(64)], [*ids, *range(1, 1 + len(ODD))]), F.col("vec_id") % 20 == 0, 20, **options).collect()
    got = defaultdict(list)
    for row in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got[row.query_id].append((row.vec_id, row.score))
    y = x.astype(np.float64)
    hit = total = 0
    for i in range(0, 2000, 20):
        s = y @ y[i]
        s[i] = -np.inf
        best = sorted(range(len(s)), key=lambda j: (-s[j], j))[:20]
        mine = got[i + 100]
        assert len(mine) == 20 and mine == sorted(mine, key=lambda p: (-p[1], p[0]))
        assert all(abs(score - y[v - 100] @ y[i]) < 1e-9 for v, score in mine)
        hit += len({j + 100 for j in best} & {v for v, _ in mine})
        total += 20
    assert hit / total >= 0.9 and (hit == total or "recall" not in options)


def with_group(n, share, dim=64, seed=3):
    """Unit vectors, the first `share` of them near copies (cosine 0.90 to 0.95) of one point."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    point, m = x[-1], int(n * share)
    off = x[:m] - (x[:m] @ point)[:, None] * point
    cos = r.uniform(0.9, 0.95, m)[:, None]
    x[:m] = cos * point + np.sqrt(1 - cos**2) * off / np.linalg.norm(off, axis=1, keepdims=True)
    return x.astype(np.float32)


def test_nearest_recall_beside_a_group_of_near_copies(spark):
    x = with_group(4000, 1 / 3)
    got = defaultdict(set)
    for row in nearest(table(spark, x), F.col("vec_id") % 20 == 0, 20).collect():
        got[row.query_id].add(row.vec_id)
    y = x.astype(np.float64)
    recall = {}
    for i in range(0, 4000, 20):
        s = y @ y[i]
        s[i] = -np.inf
        recall[i] = len(got[i] & {int(j) for j in np.argsort(-s, kind="stable")[:20]}) / 20
    assert np.mean([v for i, v in recall.items() if i < 4000 // 3]) >= 0.9
    assert np.mean([v for i, v in recall.items() if i >= 4000 // 3]) >= 0.9


def test_nearest_corners(spark):
    few = nearest(table(spark, [[1.0, 0.0], [1.0, 0.0], [0.5, 0.0], [0.5, 0.0], None], [0, 3, 2, 1, 20]), F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in few] == [(0, 1, 3, 1.0), (0, 2, 1, 0.5), (0, 3, 2, 0.5)]
    assert nearest(table(spark, [[1.0]]).limit(0), F.col("vec_id") == 0).count() == 0
    assert nearest(table(spark, [[1.0], [2.0]]), F.col("vec_id") < 0).count() == 0
    # rows that share an id are rows of their own, and each query row has its own ranks
    rows = nearest(table(spark, [[1.0, 0.0], [0.0, 2.0], [3.0, 3.0]], [0, 0, 5]), F.col("vec_id") == 0).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in rows) == [(1, 5, 3.0), (1, 5, 6.0), (2, 0, 0.0), (2, 0, 0.0)]


def many(spark, vector, few):
    """40,000 times one vector, ids from 0, and a few others behind."""
    rows = spark.range(40_000).select(F.col("id").alias("vec_id"), F.array(*[F.lit(float(x)) for x in vector]).cast("array<float>").alias("embedding"))
    return rows.unionByName(spark.createDataFrame([(50_000 + i, [float(x) for x in v]) for i, v in enumerate(few)], SCHEMA)).repartition(4)


def test_vectors_among_very_many_zero_or_equal_ones(spark):
    four = [[1.0, 0.0, 0.1], [1.0, 0.01, 0.1], [1.0, 0.02, 0.1], [1.0, 0.03, 0.1]]
    for vector in ([0.0] * 3, [0.0, -1.0, 5.0]):
        links = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(many(spark, vector, four)).where("vec_id >= 49990 or vec_id = 7").collect()}
        assert links == {50_000 + i: (3, 50_000) for i in range(4)} | {7: (0, 7) if not any(vector) else (39_999, 0)}
    found = nearest(many(spark, [0.0] * 3, four), F.col("vec_id") >= 50_000).collect()
    assert len(found) == 12 and {r.vec_id for r in found} == {50_000, 50_001, 50_002, 50_003}
    found = nearest(many(spark, [0.0, -1.0, 5.0], four), F.col("vec_id") == 50_000, 5).orderBy("rank").collect()
    assert [r.vec_id for r in found] == [50_001, 50_002, 50_003, 0, 1] or sorted(r.vec_id for r in found) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_few_different_vectors(spark, n):
    x = [[1.0, 0.0], [1.0, 0.2], [0.0, 1.0]][:n]
    out = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(table(spark, x * 2)).collect()}
    want = {1: (1, 0), 2: (3, 0), 3: (3, 0)}[n]
    assert out[0] == want and out[n] == want and (n < 3 or out[2] == (1, 2))
    found = nearest(table(spark, x * 2), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in found] == {1: [1], 2: [1, 2, 3], 3: [1, 3, 4, 2, 5]}[n]


def shapes(kind, n=4000, dim=64):
    r = np.random.default_rng(8)
    x = r.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "lengths":
        return x * r.lognormal(0, 1, (n, 1))
    if kind == "cone":
        return 2 + 0.2 * r.normal(size=(n, dim))
    if kind == "clustered":
        return x[r.integers(0, 80, n)] + 0.08 * r.normal(size=(n, dim))
    return x


@pytest.mark.parametrize("kind", ["unit", "lengths", "cone", "clustered"])
def test_nearest_recall_by_shape(spark, kind):
    x = shapes(kind).astype(np.float32)
    got = defaultdict(set)
    for row in nearest(table(spark, x), F.col("vec_id") % 20 == 0, 20).collect():
        got[row.query_id].add(row.vec_id)
    y, hit = x.astype(np.float64), 0
    for i in range(0, len(x), 20):
        s = y @ y[i]
        s[i] = -np.inf
        assert len(got[i]) == 20
        hit += len(got[i] & {int(j) for j in np.argsort(-s, kind="stable")[:20]})
    print(kind, hit / len(x))
    assert hit >= 0.9 * len(x)


def test_structure_is_found_in_few_files(spark, monkeypatch):
    from corvane.llm import ann

    chosen = []
    plain = ann.measured
    monkeypatch.setattr(ann, "measured", lambda *a: chosen.append(plain(*a)) or chosen[-1])
    nearest(table(spark, shapes("clustered", 6000)), F.col("vec_id") % 20 == 0, 20).count()
    pivots, read, _ = chosen[0]
    assert read <= 0.25 * pivots


@pytest.mark.parametrize("kind", ["cone", "clustered"])
def test_near_duplicates_recall_by_shape(spark, kind):
    x = shapes(kind, 1500).astype(np.float32)
    got = {r.vec_id: r.n_links for r in near_duplicates(table(spark, x), threshold=0.9 if kind == "cone" else 0.7).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = u @ u.T >= (0.9 if kind == "cone" else 0.7)
    np.fill_diagonal(link, False)
    mine = np.array([got[i] for i in range(len(x))])
    assert link.sum() and (mine <= link.sum(1)).all() and mine.sum() >= 0.97 * link.sum()


def test_components(spark):
    r = random.Random(6)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, k) for k in range(5001, 5300)] + [(None, 4), (7, 7)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_pipeline_near_duplicates_by_row(spark):
    import corpus_pipeline as p

    a, b, c, d = (" ".join(f"{w}{i}" for i in range(30)) for w in "abcd")
    rows = [(1, a), (1, a), (None, b), (None, b), (5, c), (9, c), (9, d), (None, d), (None, None), (7, "")]
    kept = p.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(tuple(map(str, r)) for r in kept) == sorted(tuple(map(str, r)) for r in [(1, a), (None, b), (5, c), (9, d), (None, None), (7, "")])


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept, columns = docs, docs.columns
    names = [n for n, _ in p.STAGES]
    assert names == ["quality_classifier", "toxicity", "ngram_jaccard_join", "pii", "best_fit_packing"]
    for name, stage in p.STAGES[:-1]:
        before = kept.cache()
        kept = stage(spark, before, sf).cache()
        assert kept.columns == columns
        assert kept.select("doc_id").subtract(before.select("doc_id")).count() == 0
        if name == "quality_classifier":
            left = {r.doc_id for r in kept.select("doc_id").collect()}
            good = [d for d, r in labels.items() if r.quality == 1]
            assert sum(d in left for d in good) >= 0.98 * len(good)
        if name == "ngram_jaccard_join":
            from tests.llm.test_text_operators import plain_components

            rows = before.select("doc_id", "text").collect()
            classes = plain_components([r.doc_id for r in rows], [r.text for r in rows])
            assert {r.doc_id for r in kept.select("doc_id").collect()} == {d for d, (_, c, _) in classes.items() if d == c}
        if name == "pii":
            assert kept.count() == before.count() and kept.where(F.col("text").rlike(r"[A-Za-z0-9]@[a-z0-9]+\.[a-z]")).count() == 0
    packed = p.STAGES[-1][1](spark, kept, sf)
    assert packed.select("doc_id").distinct().count() == kept.count()
    assert packed.agg(F.sum("size")).first()[0] == kept.agg(F.sum(F.octet_length("text") + 1)).first()[0]


def test_pipeline_run_and_its_corners(spark, tmp_path):
    """run() over a small folder against its stages one by one; stages over no rows and with clashing names."""
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    rows = p.run(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
    want = p.STAGES[-1][1](spark, docs, sf).collect()
    assert sorted(map(str, rows)) == sorted(map(str, want)) and {r.doc_id for r in rows} == {r.doc_id for r in docs.select("doc_id").collect()}
    odd = spark.read.parquet(f"{sf}/documents.parquet").limit(30)
    odd = odd.unionByName(odd.limit(3)).unionByName(spark.createDataFrame([(None, None, None, None, None), (None, "", "en", None, 0), (1, "x " * 40_000, None, "a", 80_000)], odd.schema))
    for c in ("row_key", "component_id", "id", "n", "vec", "score", "label", "block", "first"):
        odd = odd.withColumn(c, F.lit("clash"))
    odd = odd.cache()
    for name, stage in p.STAGES:
        assert stage(spark, odd.limit(0), sf).count() == 0, name
        out = stage(spark, odd, sf)
        if name != "best_fit_packing":
            assert out.columns == odd.columns
            assert name == "pii" or out.exceptAll(odd).count() == 0
            assert out.count() <= odd.count()
