"""What the two permutation indexes share: valid vectors as bytes, a bounded sample, pivots spread out in it, permutations.

A vector is described by the order of its nearest pivots. Pivots are drawn from a bounded sample (SAMPLE rows, the first by
a hash) of valid vectors; their number grows with the table. Every vector is indexed. How deep an index is searched is not
a fixed number either: it is measured on a bounded set of the sample's vectors, held against all rows by brute force.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.cluster import session_for_texts
from corvane.llm.sampling import first_by_hash

#: Documented bounds on what is fitted on: rows of the sample, and pivots taken from it.
SAMPLE, PIVOTS = 8192, 1024
#: A sampled vector at this cosine or more to a chosen pivot is chosen only when the others do not suffice.
APART = 0.7


def is_vector(vec: Column) -> Column:
    """Whether a list column is neither null, nor empty, nor zero, and holds only finite numbers."""
    finite = F.forall(vec, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return F.coalesce(finite & F.exists(vec, lambda e: e != 0), F.lit(False))


def dimension(vectors: DataFrame, vec_col: str) -> int:
    """The most common length of valid vectors; a vector of another length has no product with them and takes no part."""
    row = vectors.where(is_vector(F.col(vec_col))).groupBy(F.size(vec_col).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return row["d"] if row else 0


def as_bytes(vectors: DataFrame, keys: list[str], vec_col: str, dim: int) -> DataFrame:
    """The key columns (long), `vec`, the vector's numbers as bytes, and `size`, its length; both null where it takes no part.

    Numbers keep the precision of the column (4 bytes for float), so nothing is rounded.
    """
    kind = "<f4" if dict(vectors.dtypes)[vec_col] == "array<float>" else "<f8"
    valid = is_vector(F.col(vec_col)) & (F.size(vec_col) == dim)
    ready = vectors.select(*keys, F.when(valid, F.col(vec_col).cast("array<float>" if kind == "<f4" else "array<double>")).alias("v"))
    session_for_texts(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(keys))
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, max(dim, 1))
            at = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
            packed: list[bytes | None] = [None] * batch.num_rows
            for i, v in zip(at, flat, strict=True):
                packed[i] = v.tobytes()
            norm = np.full(batch.num_rows, np.nan)
            norm[at] = lengths(flat.astype(np.float64))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keys))), pa.array(packed, pa.binary()), pa.array(norm, mask=np.isnan(norm))], names=[*keys, "vec", "size"])

    return ready.mapInArrow(run, ", ".join(f"{k} long" for k in keys) + ", vec binary, size double")


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Vectors from bytes, in double precision."""
    parts = [x.as_py() for x in column]
    kind = "<f4" if parts and len(parts[0]) == 4 * dim else "<f8"
    return np.frombuffer(b"".join(parts), kind).astype(np.float64).reshape(-1, dim)


def lengths(x: np.ndarray) -> np.ndarray:
    """Euclidean lengths, without squares that overflow or vanish."""
    top = np.abs(x).max(1, initial=0)
    return top * np.sqrt(((x / np.where(top == 0, 1, top)[:, None]) ** 2).sum(1))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows divided by their length; a zero row stays zero."""
    x = x / np.where((top := np.abs(x).max(1, keepdims=True, initial=0)) == 0, 1, top)
    return x / np.where((n := np.sqrt((x * x).sum(1, keepdims=True))) == 0, 1, n)


def sampled(vectors: DataFrame, key: str, dim: int, rows: int = SAMPLE, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Keys and vectors of at most `rows` rows of a table of `vec` bytes, the first by a hash of the key."""
    few = first_by_hash(vectors.select(F.col(key).alias("key"), "vec"), "key", rows, salt=salt, out="h").toArrow().combine_chunks()
    if not few.num_rows:
        return np.zeros(0, np.int64), np.zeros((0, dim))
    few = few.sort_by("h")
    return few.column("key").to_numpy(), matrix(few.column("vec"), dim)


def spread(x: np.ndarray, count: int, apart: float = APART) -> np.ndarray:
    """Positions of at most `count` different unit vectors: first those below cosine `apart` to all before, then others.

    A large group of near copies thus gives one pivot, not its share of them.
    """
    taken, nearest = np.zeros(len(x), bool), np.full(len(x), -np.inf)
    for i in range(len(x)):
        if nearest[i] < apart:
            taken[i] = True
            nearest = np.maximum(nearest, x @ x[i])
            if taken.sum() == count:
                break
    first, rest = np.flatnonzero(taken), np.flatnonzero(~taken & (nearest < 1 - 1e-12))
    _, fresh = np.unique(x[rest], axis=0, return_index=True)
    return np.append(first, rest[np.sort(fresh)][: count - len(first)])


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, most: int) -> np.ndarray:
    """For each row its `most` nearest pivots by inner product, nearest first; ties go to the earlier pivot."""
    s = x @ pivots.T
    if most < s.shape[1]:
        few = np.sort(np.argpartition(-s, most - 1, axis=1)[:, :most], axis=1)
        return np.take_along_axis(few, np.argsort(-np.take_along_axis(s, few, 1), axis=1, kind="stable"), 1)
    return np.argsort(-s, axis=1, kind="stable")[:, :most]
