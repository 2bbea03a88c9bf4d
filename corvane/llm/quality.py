"""Quality: a classifier learned from positive and unlabelled texts only.

Trusted positives are labelled rows of label 1; the unlabelled side is a sample of the whole corpus; labels of 0 are not
used. The class prior is estimated from the two samples, and a linear model over binned statistics of the text minimises
the non-negative unbiased risk (Kiryo et al. 2017) at that prior. Texts are scored where they lie, without a shuffle.

Statistics cover the whole text: shares of each ASCII character class and mark, of non-ASCII bytes, of words that repeat
a word one to three places before, mean word length, words a line, and the length itself.
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

#: Documented bounds on what is fitted on only: trusted positives and unlabelled texts, the first by a hash of the id. The
#: risk is a mean over each sample; at 12,000 texts the error of the share of junk among them is 0.3 %.
POSITIVES, UNLABELLED = 8_000, 12_000
BINS = 16
STEPS, BATCH = 2500, 512
LAGS = (1, 2, 3)
#: Parts of the samples in cross-fitting.
PARTS = 4

#: Character classes: 0 lower case, 1 upper case, 2 digits, 3 space, 4 other white space and control, 5 non-ASCII, and
#: one for each ASCII mark.
_CLASS = np.full(256, 4)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[32], _CLASS[128:] = 0, 1, 2, 3, 5
_MARKS = [b for b in range(33, 127) if not chr(b).isalnum()]
_CLASS[_MARKS] = 6 + np.arange(len(_MARKS))
_CLASSES = 6 + len(_MARKS)
WIDTH = _CLASSES + len(LAGS) + 4


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of WIDTH statistics for each text."""
    out = []
    for i, j in S.chunks(offs):
        o = offs[i : j + 1]
        b, n = data[o[0] : o[-1]], j - i
        size = np.diff(o)
        text = np.repeat(np.arange(n), size)
        count = np.bincount(text * _CLASSES + _CLASS[b], minlength=n * _CLASSES).reshape(n, _CLASSES).astype(float)
        words, before = S.word_hashes(data, o)
        per = np.diff(before)
        repeats = np.zeros((n, len(LAGS)))
        for k, lag in enumerate(LAGS):
            at = np.flatnonzero(words[lag:] == words[:-lag]) + lag
            home = np.searchsorted(before, at, side="right") - 1
            repeats[:, k] = np.bincount(home[at - lag >= before[home]], minlength=n)[:n] / np.maximum(per, 1)
        lines = np.bincount(text[b == 10], minlength=n) + 1
        size, per = np.maximum(size, 1)[:, None], per[:, None]
        extra = [(size - count[:, 3:4]) / np.maximum(per, 1), per / lines[:, None], np.log1p(size), np.log1p(per)]
        out.append(np.hstack([count / size, repeats, *extra]))
    return np.vstack(out) if out else np.zeros((0, WIDTH))


class Binned:
    """Statistics to one-hot bins at the quantiles of a sample."""

    def __init__(self, sample: np.ndarray) -> None:
        self.edges = np.quantile(sample, np.linspace(0, 1, BINS + 1)[1:-1], axis=0) if len(sample) else np.zeros((BINS - 1, WIDTH))
        self.top = np.quantile(sample, 0.995, axis=0) if len(sample) else np.zeros(WIDTH)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Positions of the bin of each statistic: rows x WIDTH. Bins 0 .. BINS - 1 by quantile, one more for extremes."""
        at = np.stack([np.searchsorted(np.unique(self.edges[:, k]), x[:, k], side="left") for k in range(WIDTH)], axis=1)
        at = np.where((x > self.top) & (at > 0), BINS, at)
        return at + np.arange(WIDTH) * (BINS + 1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def risk_gradient(w: np.ndarray, xp: np.ndarray, xu: np.ndarray, prior: float | None) -> np.ndarray:
    """The gradient of one batch's risk: bins of positives xp and of unlabelled texts xu.

    prior None: plain logistic loss of positives against unlabelled. Else, with the sigmoid loss s(z) of taking a text as
    negative and 1 - s(z) as positive, the risk is prior * mean(1 - s(xp)) + max(0, mean(s(xu)) - prior * mean(s(xp)));
    where the second part is below zero the step goes back on it alone (Kiryo et al. 2017).
    """
    sp, su = (_sigmoid(w[x].sum(1) + w[-1]) for x in (xp, xu))
    if prior is None:
        gp, gu = (sp - 1) / len(xp), su / len(xu)
    else:
        down_p, down_u = sp * (1 - sp) / len(xp), su * (1 - su) / len(xu)
        gp, gu = (-2 * prior * down_p, down_u) if su.mean() - prior * sp.mean() >= 0 else (prior * down_p, -down_u)
    g = np.bincount(np.concatenate([xp.ravel(), xu.ravel()]), np.concatenate([np.repeat(gp, xp.shape[1]), np.repeat(gu, xu.shape[1])]), len(w))
    g[-1] += gp.sum() + gu.sum()
    return g


def _descend(p: np.ndarray, u: np.ndarray, prior: float | None, steps: int = STEPS, rate: float = 0.02, decay: float = 1e-4) -> np.ndarray:
    """Weights (last: bias) after so many steps of Adam over batches of both samples."""
    w = np.zeros(WIDTH * (BINS + 1) + 1)
    m, v, step = np.zeros_like(w), np.zeros_like(w), 0
    draw = np.random.default_rng(9)
    batches = max(1, (len(p) + len(u)) // BATCH)
    for _ in range(-(-steps // batches)):
        for bp, bu in zip(np.array_split(draw.permutation(len(p)), batches), np.array_split(draw.permutation(len(u)), batches), strict=True):
            if not len(bp) or not len(bu):
                continue
            g = decay * w + risk_gradient(w, p[bp], u[bu], prior)
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The largest share of positives that the unlabelled scores allow: min over t of U(score >= t) / P(score >= t),
    with half the sampling error of the ratio added on the safe side. Thresholds at which few positives are left are
    not looked at: the least of many noisy ratios would be too small."""
    if not len(positive) or not len(unlabelled):
        return 0.5
    t = np.quantile(positive, np.linspace(0.02, 0.5, 40))
    up = np.maximum((unlabelled[:, None] >= t).mean(0), 1 / len(unlabelled))
    down = (positive[:, None] >= t).mean(0)
    error = np.sqrt((1 - up) / up / len(unlabelled) + (1 - down) / down / len(positive))
    return float(np.clip((up / down * (1 + error / 2)).min(), 0.05, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray) -> tuple[Binned, np.ndarray, float]:
    """From statistics of trusted positives and unlabelled texts: bins, weights and the estimated class prior.

    The prior is estimated by cross-fitting: each part of both samples is scored by a model that has not seen it.
    """
    if not len(positive) or not len(unlabelled):
        return Binned(unlabelled), np.zeros(WIDTH * (BINS + 1) + 1), 0.5
    binned = Binned(np.vstack([positive, unlabelled]))
    p, u = binned(positive), binned(unlabelled)
    if min(len(p), len(u)) < PARTS:
        return binned, _descend(p, u, 0.5), 0.5
    of_p, of_u = (np.zeros(len(x)) for x in (p, u))
    for k in range(PARTS):
        mine, theirs = np.arange(len(p)) % PARTS == k, np.arange(len(u)) % PARTS == k
        w = _descend(p[~mine], u[~theirs], None, STEPS // 4)
        of_p[mine], of_u[theirs] = w[p[mine]].sum(1), w[u[theirs]].sum(1)
    prior = class_prior(of_p, of_u)
    return binned, _descend(p, u, prior), prior


def _samples(documents: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, use: Column | None, positives: int, unlabelled: int) -> DataFrame:
    """(positive, order, text): the bounded training samples."""
    named = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    named = named.where(F.col("id").isNotNull() if use is None else F.col("id").isNotNull() & use)
    trusted = named.where("label in (0, 1)").groupBy("id").agg(F.min("label").alias("least")).where("least = 1")
    trusted = first_by_hash(trusted.select("id", F.lit(True).alias("positive")), "id", positives)
    texts = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    wild = first_by_hash(texts.select("id", F.lit(False).alias("positive")).where("id is not null"), "id", unlabelled, salt=5)
    # both are bounded, so they are safe to broadcast; the texts are read once
    return texts.join(F.broadcast(trusted.unionByName(wild)), "id").select("positive", "order", "text")


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = statistics(*S.text_buffer(batch.column(2)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))], names=["positive", "order", "x"])


def learn(documents: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, use: Column | None = None, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[Binned, np.ndarray, float]:
    """Statistics are taken on the executors; the bounded sample of them (not of texts) is fitted on the driver."""
    rows = _samples(documents, labels, id_col, text_col, label_col, use, positives, unlabelled).mapInArrow(_measure, "positive boolean, order long, x array<float>")
    rows = rows.orderBy("order", "positive").limit(2 * (positives + unlabelled)).toArrow().combine_chunks()
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(-1, WIDTH).astype(float) if rows.num_rows else np.zeros((0, WIDTH))
    positive = rows.column("positive").to_numpy() if rows.num_rows else np.zeros(0, bool)
    return fit(x[positive], x[~positive])


def quality(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_where: Column | None = None) -> Callable[[Column], Column]:
    """Learn from documents whose label is 1 (where `train_where`, on the label rows' `id`, holds) and from the corpus;
    return a scoring function to (0, 1).

    Defined cases: null and empty texts have the statistics of an empty text; ids with contradicting labels are not
    trusted; without positives, or without documents, the score is 0.5 everywhere. Repeated rows score alike. Only the
    named columns are read.
    """
    session_for_texts(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(learn(documents, labels, id_col, text_col, label_col, train_where))

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        binned, w, _ = sent.value
        for column in batches:
            at = binned(statistics(*S.text_buffer(column)).astype(np.float32).astype(float))
            yield pa.array(_sigmoid(w[at].sum(1) + w[-1]))

    return score


def with_quality(documents: DataFrame, labels: DataFrame, score_col: str = "quality", **options) -> DataFrame:
    """All columns and rows of documents, and the score under a name that no column has yet (`_` is added until so)."""
    score = quality(documents, labels, **options)
    return documents.withColumn(fresh(score_col, documents.columns), score(F.col(options.get("text_col", "text"))))
