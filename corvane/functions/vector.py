"""Vector expressions on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """Divided by its length; a zero vector stays zero."""
    length = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(length == 0, 1.0).otherwise(length))


def cosine(a: Column, b: Column) -> Column:
    scale = norm(a) * norm(b)
    return F.when(scale == 0, 0.0).otherwise(F.try_divide(dot(a, b), scale))


def max_sim(query_tokens: Column, doc_tokens: Column) -> Column:
    """Late interaction: over the query's token vectors, the sum of the best inner product with a document's."""
    return F.aggregate(query_tokens, F.lit(0.0), lambda a, q: a + F.array_max(F.transform(doc_tokens, lambda d: dot(q, d))))


def chunks(a: Column, width: int) -> Column:
    """A long vector as an array of vectors of `width`."""
    return F.transform(F.sequence(F.lit(1), F.size(a), F.lit(width)), lambda k: F.slice(a, k, width))


def pooled(token_vectors: Column, how: str = "mean") -> Column:
    """One vector of a text's token vectors: their mean, the first (a CLS token), or the last. No tokens: null."""
    n = F.size(token_vectors)
    if how == "first":
        return F.get(token_vectors, F.lit(0))
    if how == "last":
        return F.get(token_vectors, n - 1)
    first = F.get(token_vectors, F.lit(0))
    total = F.aggregate(F.slice(token_vectors, 2, F.greatest(n - 1, F.lit(0))), F.transform(first, lambda x: x.cast("double")), lambda a, v: F.zip_with(a, v, lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: x / n)
