"""Gradient boosted trees for fusion, one model for each fold: histograms of binned features, logistic loss.

A feature becomes one of at most 256 bins between its quantiles. To a model, rows of the same fold, label and bins are one
row with a count, so what is learnt from is the table of these. Up to HELD of them a task for each fold learns the whole
model; beyond that a step is one aggregate over the table for all folds, and the driver holds sums by fold, node, feature
and bin. Both give the same trees but for the order of sums.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.networks import with_folds
from corvane.sources.files import cached

#: Distinct rows that one task learns from at most; trees after which the table's margins are written anew.
HELD, WRITTEN = 1 << 20, 10


def _learner(rounds: int, depth: int, rate: float, least: int):
    """Functions of numpy that learn trees. Made anew for each use, so that they ship without the library.

    A tree of a model is `feature` and `cut` of its 2^depth - 1 nodes, children of i at 2i + 1 and 2i + 2, and `value` of its
    2^depth leaves: a row goes right where its bin is over the cut.
    """

    def descended(bins, feature, cut, node, levels):
        """How far down rows are, as the place within the level, `levels` below where `node` is the root."""
        import numpy as np

        at = node
        for level in range(levels):
            of = (1 << level) - 1 + at
            at = 2 * at + (bins[np.arange(len(at)), feature[of]] > cut[of])
        return at

    def margins(bins, trees, start):
        import numpy as np

        out = np.array(start, float)
        for feature, cut, value in trees:
            out += value[descended(bins, feature, cut, np.zeros(len(bins), np.int64), depth)]
        return out

    def histogram(bins, y, weight, count, margin, at, nodes):
        """Sums of gradients, of their derivatives and of rows: (3, nodes, features, 256)."""
        import numpy as np

        p = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
        values = (weight * count * (p - y), weight * count * p * (1 - p), count)
        out = np.zeros((3, nodes, bins.shape[1], 256))
        for f in range(bins.shape[1]):
            key = at * 256 + bins[:, f]
            for i, v in enumerate(values):
                out[i, :, f] = np.bincount(key, v, nodes * 256).reshape(nodes, 256)
        return out

    def split(sums):
        """Feature and cut of each node, and the values of both children: the gain is that of Newton steps."""
        import numpy as np

        left = sums.cumsum(3)
        whole = left[:, :, :1, -1:]
        right = whole - left
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left[0] ** 2 / left[1] + right[0] ** 2 / right[1] - whole[0] ** 2 / whole[1]
        ok = (left[2] >= least) & (right[2] >= least) & (left[1] >= 1e-3) & (right[1] >= 1e-3)
        gain = np.where(ok, gain, -np.inf).reshape(len(left[0]), -1)
        best = gain.argmax(1)
        found = gain[np.arange(len(best)), best] > 1e-9
        feature, cut = np.where(found, best // 256, 0), np.where(found, best % 256, 255)
        node = np.arange(len(best))
        children = np.stack([left[:, node, feature, cut], right[:, node, feature, cut]], -1)
        value = np.where(children[1] > 1e-12, -rate * children[0] / np.maximum(children[1], 1e-12), 0.0)
        return feature, cut, value.ravel()

    def learn(sums_of):
        """Trees of all models. sums_of(trees, feature, cut, level): each model's histogram of the nodes of a level."""
        import numpy as np

        trees = {}
        for _ in range(rounds):
            feature, cut, value = {}, {}, {}
            for level in range(depth):
                for m, sums in sums_of(trees, feature, cut, level).items():
                    f, c, value[m] = split(sums)
                    feature[m], cut[m] = np.append(feature.get(m, []), f).astype(int), np.append(cut.get(m, []), c).astype(int)
            for m in value:
                trees.setdefault(m, []).append((feature[m], cut[m], value[m]))
        return trees

    return descended, margins, histogram, learn


def _bins(column, width: int):
    """The bins of a binary column, a row for each value."""
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _binned(edges):
    """Per batch of (fold, y, x): fold, y, bins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            bins = np.column_stack([np.searchsorted(e, x[:, k]) for k, e in enumerate(edges)]).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in bins], pa.binary())], names=["fold", "y", "bins"])

    return run


def _class_weights(rows: DataFrame, folds: int) -> tuple[np.ndarray, np.ndarray]:
    """For each fold what a row outside it weighs by its label (both classes the same in all), and the margin to begin at."""
    n = np.zeros((folds, 2))
    for r in rows.groupBy("fold", "y").agg(F.sum("n").alias("n")).collect():
        n[r["fold"], int(r["y"])] = r["n"]
    outside = n.sum(0) - n
    with np.errstate(divide="ignore", invalid="ignore"):
        weight = np.where(outside.all(1)[:, None], outside.sum(1)[:, None] / (2 * outside), 1.0)
    one = (outside > 0).sum(1) == 1
    return weight, np.where(one, np.where(outside[:, 1] > 0, 20.0, -20.0), 0.0)


def train_trees(rows: DataFrame, width: int, folds: int, rounds: int, depth: int, rate: float, least: int) -> dict[int, list]:
    """The trees of each fold's model, learnt from the rows (fold, y, bins, n) outside it."""
    spark = rows.sparkSession
    weight, start = _class_weights(rows, folds)
    descended, margins, histogram, learn = _learner(rounds, depth, rate, least)
    if rows.count() <= HELD:

        def whole(key: tuple, table: pa.Table) -> pa.Table:
            m = key[0].as_py()
            bins, y, count = _bins(table.column("bins"), width), table.column("y").to_numpy(), table.column("n").to_numpy()
            # sums are of floats: in one order, whatever order rows come in
            order = np.lexsort((*bins.T, y))
            bins, y, count = np.asfortranarray(bins[order]), y[order], count[order]
            held = {"margin": np.full(len(y), start[m]), "at": np.zeros(len(y), np.int64), "trees": 0}
            heavy = weight[m][y.astype(int)]

            def sums_of(trees, feature, cut, level):
                if len(trees.get(m, [])) > held["trees"]:
                    held["margin"], held["trees"] = margins(bins, trees[m][-1:], held["margin"]), len(trees[m])
                held["at"] = descended(bins, feature[m], cut[m], np.zeros(len(y), np.int64), level) if level else np.zeros(len(y), np.int64)
                return {m: histogram(bins, y, heavy, count, held["margin"], held["at"], 1 << level)}

            feature, cut, value = zip(*learn(sums_of)[m], strict=True)
            flat = [np.concatenate(a).tolist() for a in (feature, cut, value)]
            return pa.table({"model": [m], "feature": [flat[0]], "cut": [flat[1]], "value": [flat[2]]})

        models = spark.range(folds).select(F.col("id").alias("model"))
        each = rows.crossJoin(F.broadcast(models)).where("fold <> model").repartition(4 * folds, "model").groupBy("model")
        got = each.applyInArrow(whole, "model long, feature array<long>, cut array<long>, value array<double>").collect()
        cuts = lambda v, n, t: np.array(v, t).reshape(rounds, n)
        return {r["model"]: list(zip(cuts(r["feature"], 2**depth - 1, int), cuts(r["cut"], 2**depth - 1, int), cuts(r["value"], 2**depth, float), strict=True)) for r in got}

    state = {"rows": rows.withColumn("margin", F.array(*map(F.lit, start.tolist()))), "trees": 0}

    def advanced(trees):
        """Per batch of (fold, y, bins, n, margin): margins by the trees so far."""

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    bins, m = _bins(batch.column(2), width), batch.column(4).flatten().to_numpy().reshape(-1, folds)
                    m = np.column_stack([margins(bins, trees.get(f, []), m[:, f]) for f in range(folds)])
                    yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(list(m), pa.list_(pa.float64()))], names=["fold", "y", "bins", "n", "margin"])

        return run

    def sums_of(trees, feature, cut, level):
        known = len(next(iter(trees.values()), []))
        if known - state["trees"] >= WRITTEN:
            late = {m: t[state["trees"] :] for m, t in trees.items()}
            state.update(rows=cached(spark, state["rows"].mapInArrow(advanced(late), "fold long, y double, bins binary, n long, margin array<double>"), "margins"), trees=known)
        late = {m: t[state["trees"] :] for m, t in trees.items()}

        def run(batches):
            total = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                bins, margin = _bins(batch.column(2), width), batch.column(4).flatten().to_numpy().reshape(-1, folds)
                fold, y, count = (batch.column(i).to_numpy() for i in (0, 1, 3))
                for m in range(folds):
                    use = fold != m
                    if use.any():
                        b, c = bins[use], y[use]
                        at = descended(b, feature[m], cut[m], np.zeros(len(b), np.int64), level) if level else np.zeros(len(b), np.int64)
                        h = histogram(b, c, weight[m][c.astype(int)], count[use], margins(b, late.get(m, []), margin[use, m]), at, 1 << level)
                        total[m] = total[m] + h if m in total else h
            for m, h in total.items():
                h = h.reshape(3, -1)
                where = np.flatnonzero(h[2])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(where), m)), pa.array(where), *(pa.array(v[where]) for v in h)], names=["model", "at", "g", "h", "n"])

        sums = state["rows"].mapInArrow(run, "model long, at long, g double, h double, n double").groupBy("model", "at").agg(*(F.sum(c).alias(c) for c in "ghn")).toArrow().to_pandas()
        out = {}
        for m, part in sums.groupby("model"):
            h = np.zeros((3, (1 << level) * width * 256))
            h[:, part["at"]] = part[["g", "h", "n"]].to_numpy().T
            out[int(m)] = h.reshape(3, 1 << level, width, 256)
        return out

    return learn(sums_of)


def cross_validated_trees(df: DataFrame, columns: Sequence[str], folds: int = 5, rounds: int = 150, depth: int = 4, rate: float = 0.1, least: int = 20, label: str = "label", key: str = "query_id") -> DataFrame:
    """Each row scored by boosted trees that saw no row of its query: adds fold and probability.

    Every model has `rounds` trees of `depth` levels, a step of `rate`, no leaf of fewer than `least` rows; classes weigh the
    same in all. A missing feature is 0; a label that is null or not 0 or 1 teaches nothing. Where a fold's training rows are
    of one class the probability is next to that, without training rows it is one half. An empty table gives no rows.
    """
    rows, width = with_folds(df, columns, folds, label, key), len(columns)
    at = F.lit(np.linspace(0, 1, 257)[1:-1].tolist())
    found = rows.where("_y is not null").agg(*[F.percentile_approx(F.col("_x")[k], at, 10_000).alias(f"e{k}") for k in range(width)]).first()
    edges = [np.unique(np.array(found[k] or [], float)) for k in range(width)]
    known = rows.where("_y is not null").select("fold", F.col("_y").alias("y"), "_x").mapInArrow(_binned(edges), "fold long, y double, bins binary")
    known = cached(df.sparkSession, known.groupBy("fold", "y", "bins").agg(F.count("*").alias("n")), "binned-rows")
    trees = train_trees(known, width, folds, rounds, depth, rate, least)
    start = _class_weights(known, folds)[1]
    margins = _learner(rounds, depth, rate, least)[1]
    sent = df.sparkSession.sparkContext.broadcast((edges, trees, start))
    names = rows.columns

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, trees, start = sent.value
        for batch in batches:
            if batch.num_rows:
                fold = batch.column(names.index("fold")).to_numpy()
                x = batch.column(names.index("_x")).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                bins = np.column_stack([np.searchsorted(e, x[:, k]) for k, e in enumerate(edges)])
                z = np.zeros(batch.num_rows)
                for f in np.unique(fold):
                    z[fold == f] = margins(bins[fold == f], trees.get(int(f), []), np.full((fold == f).sum(), start[f]))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-z)))], names=[*names, "probability"])

    schema = ", ".join([*(f"`{n}` {kind}" for n, kind in rows.dtypes), "probability double"])
    return rows.mapInArrow(scored, schema).drop("_x", "_y")
