"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: its distinct words, pairs of neighbours, pairs with one word between, and stems (a word's first bytes,
as inflection spreads one insult over many forms), hashed into 2**BITS coordinates, each with value 1. Words are runs of ASCII letters, digits and non-ASCII bytes, A-Z folded, over the whole
text. Training keeps per-coordinate learning rates and an L1 term, so few weights are not zero; those are broadcast and
every text is scored where it lies, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm import shingling as S
from corvane.llm.cluster import session_for_texts
from corvane.llm.rows import fresh
from corvane.llm.sampling import first_by_hash

BITS = 20
#: The learner reads at most this many labelled rows, the first by a hash of the id. A documented bound on training
#: data only; scoring has none.
TRAIN_ROWS = 12_000
EPOCHS = 4
GRAMS = ((0,), (0, 1), (0, 2))
STEMS = (4, 5)


def feature_hits(data: np.ndarray, offs: np.ndarray, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, coordinate) pairs of a range of texts, distinct and sorted; with a table only where it is not zero."""
    words, before, stems = S.word_hashes(data, offs, S.NOT_WORD, STEMS)
    texts, coords = [], []
    for salt, (of, gram) in enumerate([*((words, g) for g in GRAMS), *((s, (0,)) for s in stems)]):
        h = S.gram_hashes(of, gram, salt) >> np.uint64(64 - BITS)
        at = np.arange(len(h)) if table is None else np.flatnonzero(table[h])
        text = np.searchsorted(before, at, side="right") - 1
        ok = at + gram[-1] < before[text + 1]
        texts.append(text[ok])
        coords.append(h[at[ok]].astype(np.int64))
    key = np.unique((np.concatenate(texts) << BITS) | np.concatenate(coords))
    return key >> BITS, key & ((1 << BITS) - 1)


class Ftrl:
    """FTRL-proximal (McMahan et al. 2013) for logistic loss on binary features."""

    def __init__(self, size: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 5.0, l2: float = 0.0) -> None:
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, label: float) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def train(examples: list[tuple[int, np.ndarray, int]], epochs: int = EPOCHS, **rates: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Coordinates and values of the weights that are not zero, and the bias. examples: (order, coordinates, label)."""
    model = Ftrl(1 << BITS, **rates)
    examples = sorted(examples, key=lambda x: x[0])
    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(examples)):
            _, coords, label = examples[k]
            model.learn(np.append(coords, 1 << BITS), label)
    w = model.weights()
    at = np.flatnonzero(w[:-1])
    return at, w[at], float(w[-1])


def _coordinates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to their distinct coordinates, where they lie."""
    for batch in batches:
        data, offs = S.text_buffer(batch.column(1))
        rows = []
        for i, j in S.chunks(offs):
            text, coord = feature_hits(data, offs[i : j + 1])
            cuts = np.searchsorted(text, np.arange(j - i + 1))
            rows += [coord[cuts[k] : cuts[k + 1]].astype(np.int32) for k in range(j - i)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32())), batch.column(2)], names=["order", "coords", "label"])


def _learner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    examples = []
    for batch in batches:
        coords = batch.column(1)
        values, cuts = coords.values.to_numpy(), coords.offsets.to_numpy()
        examples += [(o, values[cuts[k] : cuts[k + 1]], y) for k, (o, y) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True))]
    at, w, bias = train(examples)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(w, bias))], names=["at", "w"])


def labelled_sample(documents: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, use: Column | None, rows: int) -> DataFrame:
    """(order, text, label) of labelled documents with at most `rows` ids, the first by a hash of the id. Ids with labels that
    contradict each other, or without one, are left out; a repeated document counts as often as it is there."""
    named = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    named = named.where("id is not null and label in (0, 1)" if use is None else F.col("id").isNotNull() & F.col("label").isin(0, 1) & use)
    named = named.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most")
    few = first_by_hash(named.select("id", "label"), "id", rows)
    # bounded by `rows`, so it is safe to broadcast
    texts = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(few), "id").select("order", "text", "label")


def learn_weights(sample: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """Train on one executor over the bounded sample's coordinates (not its texts); only the sparse weights reach the driver."""
    found = sample.mapInArrow(_coordinates, "order long, coords array<int>, label int").orderBy("order", F.xxhash64("coords")).limit(rows).coalesce(1).mapInArrow(_learner, "at long, w double").collect()
    at = np.array([r["at"] for r in found if r["at"] >= 0], np.int64)
    return at, np.array([r["w"] for r in found if r["at"] >= 0]), next((r["w"] for r in found if r["at"] < 0), 0.0)


def scorer(documents: DataFrame, weights: tuple[np.ndarray, np.ndarray, float]) -> Callable[[Column], Column]:
    """A column function: text to score in (0, 1); null and empty texts get the bias alone."""
    sent = documents.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        at, w, bias = sent.value
        table = np.zeros(1 << BITS, np.float32)
        table[at] = w
        for column in batches:
            data, offs = S.text_buffer(column)
            total = np.full(len(column), bias)
            for i, j in S.chunks(offs):
                text, coord = feature_hits(data, offs[i : j + 1], table)
                total[i:j] += np.bincount(text, table[coord], j - i)
            yield pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))

    return score


def toxicity(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_where: Column | None = None, rows: int = TRAIN_ROWS) -> Callable[[Column], Column]:
    """Learn from labelled documents (where `train_where`, on the label rows' `id`, holds); return a scoring function.

    Defined cases: null and empty texts have no feature and get the bias's score; labels that are null, not 0 or 1, or
    contradict each other for one id teach nothing; without any label the score is 0.5 everywhere. Repeated rows score
    alike. Only the named columns are read.
    """
    session_for_texts(documents.sparkSession)
    return scorer(documents, learn_weights(labelled_sample(documents, labels, id_col, text_col, label_col, train_where, rows), rows))


def with_toxicity(documents: DataFrame, labels: DataFrame, score_col: str = "toxicity", **options) -> DataFrame:
    """All columns and rows of documents, and the score under a name that no column has yet (`_` is added until so)."""
    score = toxicity(documents, labels, **options)
    return documents.withColumn(fresh(score_col, documents.columns), score(F.col(options.get("text_col", "text"))))
