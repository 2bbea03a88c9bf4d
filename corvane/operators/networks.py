"""Fusion models trained in place: a step is one aggregate over the rows for all models (settings and folds) at once.

Rows are written once with their fold and their features. At each step tasks return sums of gradients, which Spark adds by
(model, coordinate); the driver holds the models' parameters, whose number does not depend on the rows, and no row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.dedup import fold_of
from corvane.operators.relevance import Relevance, judgements
from corvane.sources.files import cached

Layers = list[tuple[np.ndarray, np.ndarray]]


def with_folds(df: DataFrame, columns: Sequence[str], folds: int, label: str = "label", key: str = "query_id") -> DataFrame:
    """The rows, written, with `fold` and two columns of the models: `_x`, where a missing feature is 0, and `_y`.

    A label that is null or not 0 or 1 gives a null `_y`: the row is scored but teaches nothing.
    """
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])
    y = F.when(F.col(label).isin(0, 1), F.col(label).cast("double"))
    return cached(df.sparkSession, df.select("*", fold_of(key, folds).alias("fold"), x.alias("_x"), y.alias("_y")), "fold-rows")


def training_stats(rows: DataFrame, width: int, folds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each fold of the rows outside it that have a label: how many, how many with label 1, features' means and
    deviations (1 where a feature is constant)."""
    aggregates = [f(F.col("_x")[k]).alias(f"{name}{k}") for k in range(width) for name, f in (("m", F.avg), ("v", F.var_pop))]
    n, ones, mean, var = np.zeros(folds), np.zeros(folds), np.zeros((folds, width)), np.zeros((folds, width))
    for r in rows.where("_y is not null").groupBy("fold").agg(F.count("*").alias("n"), F.sum("_y").alias("ones"), *aggregates).collect():
        n[r["fold"]], ones[r["fold"]] = r["n"], r["ones"]
        mean[r["fold"]], var[r["fold"]] = [r[f"m{k}"] for k in range(width)], [r[f"v{k}"] for k in range(width)]
    others = (1 - np.eye(folds)) * n
    total = others.sum(1)
    share = others / np.maximum(total, 1)[:, None]
    centre = share @ mean
    # a fold's own variance, and how far its mean lies from the mean of all
    spread = share @ var + np.einsum("fg,fgk->fk", share, (mean[None] - centre[:, None]) ** 2)
    return total, (1 - np.eye(folds)) @ ones, centre, np.where(spread > 1e-24, np.sqrt(spread), 1.0)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def summed(rows: DataFrame, width: int, of_batch: Callable[[np.ndarray, np.ndarray, np.ndarray, int, int], Iterator[tuple[int, np.ndarray]]]) -> dict[int, np.ndarray]:
    """Sums by model of the vectors that `of_batch(x, y, fold, task, batch number)` yields."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for k, batch in enumerate(batches):
            if batch.num_rows:
                x, y, fold = _matrix(batch.column(0), width), batch.column(1).to_numpy(), batch.column(2).to_numpy()
                for model, vector in of_batch(x, y, fold, TaskContext.get().partitionId(), k):
                    held[model] = held[model] + vector if model in held else vector
        for model, vector in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(vector), model)), pa.array(np.arange(len(vector))), pa.array(vector)], names=["model", "at", "value"])

    sums = rows.select("_x", "_y", "fold").mapInArrow(run, "model long, at long, value double").groupBy("model", "at").agg(F.sum("value").alias("value")).toArrow().to_pandas()
    return {int(m): g.sort_values("at")["value"].to_numpy() for m, g in sums.groupby("model")}


# ---- networks


def unpacked(flat: np.ndarray, widths: Sequence[int]) -> Layers:
    """Weights and biases of each layer, as views of one vector."""
    out, at = [], 0
    for a, b in pairwise(widths):
        out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def initial(widths: Sequence[int], seed: int) -> np.ndarray:
    """Weights for rectified units: normal with variance 2 / inputs; biases 0."""
    r = np.random.default_rng(seed)
    return np.concatenate([np.append(r.normal(0, (2 / a) ** 0.5, a * b), np.zeros(b)) for a, b in pairwise(widths)])


def forward(layers: Layers, x: np.ndarray, masks: Sequence[np.ndarray] = ()) -> tuple[np.ndarray, list[np.ndarray]]:
    """Logits, and what went into each layer. masks: what hidden units are multiplied by (dropout), none when scoring."""
    inputs = []
    for k, (w, b) in enumerate(layers):
        inputs.append(x)
        x = x @ w + b
        if k + 1 < len(layers):
            x = np.maximum(x, 0)
            x = x * masks[k] if len(masks) else x
    return x[:, 0], inputs


def _probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def loss_and_gradient(flat: np.ndarray, widths: Sequence[int], x: np.ndarray, y: np.ndarray, positive: float, masks: Sequence[np.ndarray] = ()) -> tuple[float, np.ndarray]:
    """Cross entropy summed over rows, those with label 1 counting `positive` times, and its gradient."""
    layers = unpacked(flat, widths)
    z, inputs = forward(layers, x, masks)
    weight = np.where(y == 1, positive, 1.0)
    back = (weight * (_probability(z) - y))[:, None]
    parts = []
    for k in range(len(layers) - 1, -1, -1):
        parts.append(np.append(inputs[k].T @ back, back.sum(0)))
        if k:
            back = (back @ layers[k][0].T) * (inputs[k] > 0) * (masks[k - 1] if len(masks) else 1)
    return float((weight * (np.logaddexp(0, z) - y * z)).sum()), np.concatenate(parts[::-1])


class AdamW:
    """Adam with decoupled weight decay on one vector."""

    def __init__(self, size: int, rate: float, decay: float, first: float = 0.9, second: float = 0.999) -> None:
        self.rate, self.decay, self.first, self.second = rate, decay, first, second
        self.m, self.v, self.steps = np.zeros(size), np.zeros(size), 0

    def moved(self, flat: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        self.steps += 1
        self.m = self.first * self.m + (1 - self.first) * gradient
        self.v = self.second * self.v + (1 - self.second) * gradient**2
        m, v = self.m / (1 - self.first**self.steps), self.v / (1 - self.second**self.steps)
        return flat * (1 - self.rate * self.decay) - self.rate * m / (np.sqrt(v) + 1e-8)


def train_networks(rows: DataFrame, width: int, folds: int, hidden: Sequence[int], dropout: float, rate: float, decay: float, epochs: int, steps: int, seed: int) -> Callable[[int, np.ndarray], np.ndarray]:
    """One network for each fold, learnt from the rows outside it; gives a function (fold, features) -> probability.

    An epoch deals the rows, by a hash, to `steps` batches; every batch is spread over all tasks. Dropout draws follow
    from the seed, the step, the task and the place in it, so that a task run again returns the same sums.
    """
    widths = [width, *hidden, 1]
    total, ones, mean, spread = training_stats(rows, width, folds)
    positive = np.where(ones > 0, (total - ones) / np.maximum(ones, 1), 1.0)
    models = [initial(widths, seed) for _ in range(folds)]
    movers = [AdamW(len(models[0]), rate, decay) for _ in range(folds)]
    known = rows.where("_y is not null")
    context = rows.sparkSession.sparkContext
    for step in range(epochs * steps):
        sent = context.broadcast(models)

        def of_batch(x, y, fold, task, k, sent=sent, step=step):
            for f, flat in enumerate(sent.value):
                use = fold != f
                if use.any():
                    r = np.random.default_rng([seed, step, f, task, k])
                    masks = [(r.random((int(use.sum()), h)) >= dropout) / (1 - dropout) for h in hidden] if dropout else []
                    _, g = loss_and_gradient(flat, widths, (x[use] - mean[f]) / spread[f], y[use], positive[f], masks)
                    yield f, np.append(g, use.sum())

        dealt = F.pmod(F.xxhash64("_x", "_y", F.lit(seed), F.lit(step // steps)), F.lit(steps)) == step % steps
        for f, sums in summed(known.where(dealt), width, of_batch).items():
            models[f] = movers[f].moved(models[f], sums[:-1] / sums[-1])
        sent.destroy()
    return lambda f, x: _probability(forward(unpacked(models[f], widths), (x - mean[f]) / spread[f])[0])


def cross_validated_network(df: DataFrame, columns: Sequence[str], folds: int = 5, hidden: Sequence[int] = (32, 16), dropout: float = 0.1, rate: float = 0.005, decay: float = 0.01, epochs: int = 80, steps: int = 2, label: str = "label", key: str = "query_id", seed: int = 0) -> DataFrame:
    """Each row scored by a network that saw no row of its query: adds fold and probability.

    Features are standardised on the training rows; classes weigh the same in all; rectified units with dropout; AdamW.
    Without training rows for a fold its network stays as it began. An empty table gives no rows.
    """
    rows = with_folds(df, columns, folds, label, key)
    model = train_networks(rows, len(columns), folds, hidden, dropout, rate, decay, epochs, steps, seed)
    return _scored(rows, len(columns), model).drop("_x", "_y")


def _scored(rows: DataFrame, width: int, model: Callable[[int, np.ndarray], np.ndarray]) -> DataFrame:
    @F.pandas_udf("double")
    def probability(fold: pd.Series, x: pd.Series) -> pd.Series:
        matrix, out = np.stack(x.to_list()) if len(x) else np.zeros((0, width)), np.zeros(len(x))
        for f in fold.unique():
            at = (fold == f).to_numpy()
            out[at] = model(int(f), matrix[at])
        return pd.Series(out)

    return rows.withColumn("probability", probability("fold", "_x"))


# ---- search over settings of a logistic model


def search_logistic(rows: DataFrame, width: int, folds: int, settings: Sequence[dict]) -> np.ndarray:
    """Coefficients (setting, fold, features and a constant) of logistic models on standardised features, by Newton steps.

    A setting has `reg` (penalty on the mean loss, not on the constant), `balance` (the power of the classes' ratio that a
    row with label 1 weighs) and `max_iter`. All settings and folds take a step in one aggregate.
    """
    total, ones, mean, spread = training_stats(rows, width, folds)
    ratio = np.where(ones > 0, (total - ones) / np.maximum(ones, 1), 1.0)
    coefs, size = np.zeros((len(settings), folds, width + 1)), width + 1
    known = rows.where("_y is not null")
    penalty = np.append(np.ones(width), 0.0)
    for step in range(max((s["max_iter"] for s in settings), default=0)):
        going = [k for k, s in enumerate(settings) if step < s["max_iter"]]

        def of_batch(x, y, fold, task, k, going=going, held=coefs.copy()):
            for f in range(folds):
                use = fold != f
                if not use.any():
                    continue
                z, t = np.column_stack([(x[use] - mean[f]) / spread[f], np.ones(use.sum())]), y[use]
                for s in going:
                    p, w = _probability(z @ held[s, f]), np.where(t == 1, ratio[f] ** settings[s]["balance"], 1.0)
                    curve = (z * (w * p * (1 - p))[:, None]).T @ z
                    yield s * folds + f, np.concatenate([curve.ravel(), z.T @ (w * (p - t)), [w.sum()]])

        for model, sums in summed(known, width, of_batch).items():
            s, f = divmod(model, folds)
            reg = settings[s]["reg"] * penalty
            curve = sums[: size * size].reshape(size, size) / sums[-1] + np.diag(reg + 1e-9)
            move = np.linalg.solve(curve, sums[-1 - size : -1] / sums[-1] + reg * coefs[s, f])
            # a long step is shortened: labels that a plane parts have no finite optimum
            coefs[s, f] -= move * min(1.0, 4.0 / max(np.abs(move).max(), 1e-300))
    sigma = np.concatenate([spread, np.ones((folds, 1))], axis=1)
    coefs = coefs / sigma
    coefs[:, :, -1] -= (coefs[:, :, :-1] * mean).sum(2)
    return coefs


def logistic_leaderboard(df: DataFrame, columns: Sequence[str], settings: Sequence[dict], relevant: DataFrame | Relevance, folds: int = 5, depth: int = 1000, label: str = "label", key: str = "query_id") -> DataFrame:
    """setting, parameters, value, rank: settings by the mean NDCG at `depth` over queries, each scored by models of other
    queries. Queries without relevant documents have no value. Equal values: the smaller setting first."""
    rows = with_folds(df, columns, folds, label, key)
    sent = rows.sparkSession.sparkContext.broadcast(search_logistic(rows, len(columns), folds, settings))

    @F.pandas_udf("array<double>")
    def logits(fold: pd.Series, x: pd.Series) -> pd.Series:
        held = sent.value[:, fold.to_numpy()]
        matrix = np.column_stack([np.stack(x.to_list()), np.ones(len(x))]) if len(x) else np.zeros((0, held.shape[2]))
        return pd.Series(list(np.round(np.einsum("snk,nk->ns", held, matrix), 9)))

    each = rows.select(key, "doc_id", "_y", F.posexplode(logits("fold", "_x")).alias("setting", "score"))
    by_score = Window.partitionBy("setting", key).orderBy(F.desc("score"), "doc_id")
    each = each.withColumn("place", F.row_number().over(by_score)).where((F.col("place") <= depth) & (F.col("_y") == 1))
    gained = each.groupBy("setting", key).agg(F.sum(1 / F.log2(F.col("place") + 1)).alias("gain"))
    sizes = judgements(relevant).sizes().groupBy(F.col("query_id").alias(key)).agg(F.least(F.sum("n"), F.lit(depth)).alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("n").cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    asked = rows.select(key).distinct().join(sizes, key).select(key, ideal.alias("ideal"))
    numbered = rows.sparkSession.createDataFrame([(k, str(sorted(s.items()))) for k, s in enumerate(settings)], "setting int, parameters string")
    every = asked.crossJoin(F.broadcast(numbered))
    value = every.join(gained, ["setting", key], "left").groupBy("setting", "parameters").agg(F.round(F.avg(F.coalesce("gain", F.lit(0.0)) / F.col("ideal")), 6).alias("value"))
    # a row for each setting
    return value.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("value"), "setting")).cast("long"))
