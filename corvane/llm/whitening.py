"""Embedding whitening: covariance by upper-triangle column aggregates, components by LAPACK.

Each entry c of a vector becomes the whole number x = floor(1024 c) + 100000. Three passes fit a table of vectors, all of
them generated aggregates over columns, with no grouping key, so that every task sends one row: the sums of the columns, the
sums of centred products for every pair of dimensions i <= j, and the covariance of what whitening gives, as a check. What
the driver holds is the dimension squared, whatever the number of vectors. Projection is a generated expression per
component, so nothing leaves the JVM but the covariance matrix.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: x = floor(SCALE * c) + SHIFT
SCALE, SHIFT = 1024, 100_000
#: Entries from this magnitude on have no x that sums without overflow; they count as not finite.
LARGEST = float(1 << 40)
#: Pairs of dimensions in one aggregation. 128 dimensions need 8,256; more dimensions take more aggregations.
PAIRS = 8256
#: A component explains something if its eigenvalue is above this share of the largest.
RANK = 1e-12


def _array(terms: Iterable[str]) -> str:
    """One column of many: thousands of columns would each cost the planner an attribute."""
    return f"array({', '.join(terms)})"


def _tree(terms: list[str]) -> str:
    """The sum of the terms as a balanced expression, so that its depth is the logarithm of their number."""
    while len(terms) > 1:
        terms = [f"({terms[i]} + {terms[i + 1]})" if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
    return terms[0]


def usable(vec: Column) -> Column:
    """Whether a vector is there and holds neither null nor a non-finite entry."""
    return vec.isNotNull() & F.forall(vec, lambda c: F.coalesce(F.abs(c.cast("double")) < LARGEST, F.lit(False)))


def _entries(rows: DataFrame) -> DataFrame:
    """id and x, the whole numbers of a vector. Spark may try what is derived from x before it drops unusable rows, so
    nothing here or on x may fail on them."""
    return rows.selectExpr("id", f"transform(v, c -> try_add(floor({SCALE}D * CAST(c AS DOUBLE)), {SHIFT}L)) AS x")


class Whitening:
    """The fit of vectors of one width: n, sums S, mean, eigenvalues (falling) and unit eigenvectors (rows)."""

    def __init__(self, entries: DataFrame, width: int):
        self.width = width
        self.n, self.sums = entries.selectExpr("count(*)", _array(f"sum(get(x, {i}))" for i in range(width))).first()
        self.mean = [s / self.n for s in self.sums]
        # never null, which spares each of the sums a test
        centred = entries.selectExpr(*[f"coalesce(get(x, {i}) - {m!r}D, 0D) AS d{i}" for i, m in enumerate(self.mean)])
        pairs = [(i, j) for i in range(width) for j in range(i, width)]
        cov = np.zeros((width, width))
        for at in range(0, len(pairs), PAIRS):
            part = pairs[at : at + PAIRS]
            found = np.array(centred.selectExpr(_array(f"sum(d{i} * d{j})" for i, j in part)).first()[0]) / self.n
            i, j = np.array(part).T
            cov[i, j] = cov[j, i] = found
        values, vectors = np.linalg.eigh(cov)  # LAPACK's symmetric solver
        self.values, self.axes = values[::-1], vectors.T[::-1]
        # either sign is an eigenvector; the one whose largest entry is positive makes results repeatable
        largest = self.axes[np.arange(width), np.abs(self.axes).argmax(axis=1)]
        self.axes = self.axes * np.where(largest < 0, -1.0, 1.0)[:, None]
        self.trace = float(np.trace(cov))

    def sound(self, k: int) -> bool:
        """Whether component k (from 0) has variance to be divided by."""
        return bool(self.values[k] > RANK * max(self.values[0], 0.0)) and self.values[0] > 0

    def projected(self, k: int) -> str:
        """SQL of a vector's whitened coordinate k (from 0): (x - S/n) on the component, over the eigenvalue's root."""
        if not self.sound(k):
            return "CAST(NULL AS DOUBLE)"
        root = math.sqrt(self.values[k])
        return _tree([f"((get(x, {i}) - {m!r}D) * {float(a)!r}D)" for i, (m, a) in enumerate(zip(self.mean, self.axes[k], strict=True))]) + f" / {root!r}D"

    def deviation(self) -> str:
        """SQL of the sum over dimensions of (n x - S)^2 in whole numbers; null where that passes a long."""
        off = f"zip_with(x, {_array(f'{s}L' for s in self.sums)}, (x, s) -> try_subtract(try_multiply({self.n}L, x), s))"
        return f"aggregate({off}, 0L, (total, o) -> try_add(total, try_multiply(o, o)))"

    def identity_error(self, entries: DataFrame, components: int) -> float | None:
        """The largest absolute entry of the whitened coordinates' covariance minus the identity."""
        there = [k for k in range(min(components, self.width)) if self.sound(k)]
        if not there:
            return None
        white = entries.selectExpr(*[f"{self.projected(k)} AS w{k}" for k in there])
        pairs = [(a, b) for a in there for b in there if a <= b]
        found = white.selectExpr(_array(f"covar_pop(w{a}, w{b})" for a, b in pairs)).first()[0]
        return max(abs(c - (a == b)) for c, (a, b) in zip(found, pairs, strict=True))


def whitened(embeddings: DataFrame, components: int = 8, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """For each vector and component from 1 to `components`: id_col, component, n, deviation, whitened, explained and
    identity_error, as in the contract: every figure is over all usable vectors, with divisor n.

    Defined cases: vectors that are null or hold null or non-finite entries (or entries from 2^40 on) are dropped. Vectors
    of different widths are fitted apart, n is the number of that width; vectors without entries have no component. There
    are as many components as dimensions at most. A component without variance (one vector only, equal vectors, more
    dimensions than vectors) has whitened null and counts for nothing in identity_error, which is null if all are such;
    explained is null if nothing varies. deviation is null where it passes 2^63. Repeated rows and null ids count as rows
    and are kept. An empty table gives no rows. Only the named columns are read.
    """
    rows = embeddings.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).where(usable(F.col("v")))
    widths = sorted(r[0] for r in rows.select(F.size("v").alias("width")).where("width > 0").distinct().collect())
    out = None
    for width in widths:
        entries = _entries(rows.where(F.size("v") == width))
        fit = Whitening(entries, width)
        error = fit.identity_error(entries, components)
        parts = []
        for k in range(min(components, width)):
            share = float(fit.values[k] / fit.trace) if fit.trace > 0 else None
            parts.append(f"struct({k + 1} AS component, {fit.projected(k)} AS whitened, CAST({'NULL' if share is None else repr(share) + 'D'} AS DOUBLE) AS explained)")
        each = entries.selectExpr("id", f"{fit.deviation()} AS deviation", f"{_array(parts)} AS parts").selectExpr("id", "deviation", "inline(parts)")
        each = each.select(F.col("id").alias(id_col), "component", F.lit(fit.n).cast("long").alias("n"), F.col("deviation").cast("long").alias("deviation"), "whitened", "explained", F.lit(error).cast("double").alias("identity_error"))
        out = each if out is None else out.unionByName(each)
    if out is None:
        empty = "component int, n long, deviation long, whitened double, explained double, identity_error double"
        return embeddings.sparkSession.createDataFrame([], f"`{id_col}` {dict(embeddings.dtypes)[id_col]}, {empty}")
    return out
