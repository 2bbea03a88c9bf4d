"""Nearest neighbours by largest inner product, through a permutation index.

Vectors are described by their direction and their length. A direction's order of pivots is its permutation; vectors are
posted to the inverted file of their nearest pivot, lengths in bands of a factor of BAND apart, so a file holds vectors of
like direction and like length, and a pivot scaled to its band's length stands for it. A query reads the files in the
order of its inner product with what stands for them. In each it ranks what it finds by the footrule distance of the
permutations of PERMUTED pivots, and reranks what lies within the footrule radius by the exact inner product in double
precision.

How many files a query reads, of how many pivots, and the footrule radius are measured: a bounded number of queries is held
against all rows by brute force, and each of the two cuts keeps the wanted share of their true neighbours. So vectors with
structure are found in few files, and vectors without any, where no index can rule anything out, in most of them. With
recall 1 or more every file is read and nothing is cut: the result is exact. So it is for the queries that meet fewer than
k vectors: they are searched anew in that way.

Files are read in blocks of bounded size and queries go in parts of bounded size, so a pivot that a third of all vectors
are near is many jobs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.cluster import shared_dir, written
from corvane.llm.pivots import PIVOTS, as_bytes, dimension, lengths, matrix, nearest_pivots, sampled, spread, unit

#: Share of the true neighbours that each of the two cuts keeps, where it is measured.
RECALL = 0.98
#: Queries that the cuts are measured with, and so many of their neighbours.
ASKED = 128
PERMUTED = 64
#: Numbers of pivots to choose from. Sending a query to a file costs as much as so many candidates.
FILES, ROUTE_COST = (16, 64, 256, 1024), 150
BAND, BANDS = 1.3, 16
BLOCK, QUERY_PART = 8192, 4096
#: Entries of a matrix of queries and vectors worked on at once.
TOGETHER = 1 << 21


def footrule(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Sum over pivots of the difference of ranks, for each pair of rows."""
    total = np.zeros((len(queries), len(vectors)), np.int16)
    a, b = queries.astype(np.int8).T.copy(), vectors.astype(np.int8).T.copy()
    for x, y in zip(a, b, strict=True):
        total += np.abs(x[:, None] - y[None, :])
    return total


def permutation(u: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """For each unit vector the rank of each of the first PERMUTED pivots."""
    order = nearest_pivots(u, pivots[:PERMUTED], PERMUTED)
    r = np.empty(order.shape, np.uint8)
    np.put_along_axis(r, order, np.arange(order.shape[1], dtype=np.uint8)[None, :].repeat(len(u), 0), 1)
    return r


class Files:
    """The files of an index: bands of length (longest first) times pivots."""

    def __init__(self, pivots: np.ndarray, tops: list[float]) -> None:
        self.pivots, self.tops = pivots, np.array(tops)

    def of(self, x: np.ndarray) -> np.ndarray:
        """Each vector's file: its band is the last whose top it does not exceed."""
        band = np.maximum(np.searchsorted(-self.tops, -lengths(x), side="right") - 1, 0)
        return band * len(self.pivots) + nearest_pivots(unit(x), self.pivots, 1)[:, 0]

    def order(self, x: np.ndarray, most: int | None = None) -> np.ndarray:
        """For each query the files, best first."""
        stands = (self.tops[:, None, None] * self.pivots[None]).reshape(-1, self.pivots.shape[1])
        return nearest_pivots(unit(x), stands, min(most or len(stands), len(stands)))


def bands(sizes: list[tuple[int, float]]) -> list[float]:
    """Tops of at most BANDS bands, longest first. sizes: (logarithmic band, its longest vector)."""
    return [top for _, top in sorted(sizes, reverse=True)[:BANDS]] or [1.0]


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to the smaller id."""
    if len(scores) > k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))


def _true(sent, dim: int, k: int):
    """Per asked query and task its k best rows: (asked, score, vec)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, asked = sent.value
        best = [(np.zeros(0), []) for _ in rows]
        for batch in batches:
            row, vec = batch.column(0).to_numpy(), batch.column(1)
            if not len(row):
                continue
            scores = asked @ matrix(vec, dim).T
            scores[rows[:, None] == row[None, :]] = -np.inf
            for q, s in enumerate(scores):
                at = best_of(s, row, k)
                at = at[np.isfinite(s[at])]
                s, v = np.append(best[q][0], s[at]), best[q][1] + [vec[i].as_py() for i in at.tolist()]
                keep = np.argsort(-s, kind="stable")[:k]
                best[q] = s[keep], [v[i] for i in keep]
        count = [len(s) for s, _ in best]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(rows)), count)), pa.array(np.concatenate([s for s, _ in best]) if best else []), pa.array([x for _, v in best for x in v], pa.binary())], names=["asked", "score", "vec"])

    return run


def measured(base: DataFrame, sample: np.ndarray, pivots: np.ndarray, tops: list[float], n: int, dim: int, k: int, recall: float) -> tuple[int, int, int]:
    """(pivots, files read, footrule radius): of least cost at which both cuts keep the wanted share of true neighbours."""
    rows, asked = sampled(base.where("asks = 1"), "row", dim, ASKED, salt=3)
    sent = base.sparkSession.sparkContext.broadcast((rows, asked))
    found = base.select("row", "vec").mapInArrow(_true(sent, dim, k), "asked long, score double, vec binary")
    for by in (["asked", "lane"], ["asked"]):  # in two steps, as every task has found k
        w = Window.partitionBy(*by).orderBy(F.desc("score"))
        found = (found.withColumn("lane", F.pmod(F.xxhash64("vec"), F.lit(64))) if "lane" in by else found).withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n")
    got = found.select("asked", "vec").toArrow().combine_chunks()
    if not got.num_rows:
        return min(FILES[0], len(pivots)), len(tops) * len(pivots), 2 * PERMUTED**2
    q, x = got.column("asked").to_numpy(), matrix(got.column("vec"), dim)
    far = np.abs(permutation(unit(asked), pivots)[q].astype(int) - permutation(unit(x), pivots)).sum(1)
    best = None
    for p in sorted({min(p, len(pivots)) for p in FILES}):
        files = Files(pivots[:p], tops)
        order = files.order(asked)
        place = np.argsort(order, axis=1, kind="stable")[q, files.of(x)]
        read = int(np.quantile(place, recall, method="higher")) + 1
        share = np.bincount(files.of(sample), minlength=order.shape[1]) / len(sample)
        cost = read * ROUTE_COST + share[order[:, :read]].sum(1).mean() * n
        if best is None or cost < best[0]:
            best = cost, p, read
    return best[1], best[2], int(np.quantile(far, recall, method="higher"))


def _filed(sent, dim: int):
    """Vectors to their file: (file, row, id, ranks, vec)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, permuted = sent.value
        for batch in batches:
            x = matrix(batch.column(2), dim)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(files.of(x).astype(np.int32)), batch.column(0), batch.column(1), pa.array([r.tobytes() for r in permutation(unit(x), permuted)], pa.binary()), batch.column(2)], names=["file", "row", "id", "ranks", "vec"])

    return run


def _routed(sent, dim: int, read: int):
    """Queries to the files they read: the same columns, a row for each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, permuted = sent.value
        for batch in batches:
            x = matrix(batch.column(2), dim)
            if len(x):
                ranks, to = [r.tobytes() for r in permutation(unit(x), permuted)], files.order(x, read)
                row = np.repeat(np.arange(len(x)), to.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(to.ravel().astype(np.int32)), *(batch.column(c).take(pa.array(row)) for c in (0, 1)), pa.array([ranks[i] for i in row], pa.binary()), batch.column(2).take(pa.array(row))], names=["file", "row", "id", "ranks", "vec"])

    return run


def _search(dim: int, k: int, radius: int):
    """Each query's k best of one block of a file: (query, query_id, vec_id, score)."""

    def run(job: pa.Table) -> pa.Table:
        asking = job.column("asking").to_numpy(zero_copy_only=False)
        ours, queries = job.filter(pa.array(~asking)).sort_by("id"), job.filter(pa.array(asking))
        ranks = [np.frombuffer(b"".join(x.as_py() for x in t.column("ranks")), np.uint8).reshape(t.num_rows, -1) if t.num_rows else np.zeros((0, 1), np.uint8) for t in (ours, queries)]
        y, x = matrix(ours.column("vec"), dim), matrix(queries.column("vec"), dim)
        own, ids, me = ours.column("row").to_numpy(), ours.column("id").to_numpy(), queries.column("row").to_numpy()
        # of equal vectors only the smallest ids can be among the k; one more, as one may be the query itself
        _, same = np.unique(y, axis=0, return_inverse=True)
        by = np.argsort(same, kind="stable")
        first = np.flatnonzero(np.diff(same[by], prepend=-1))
        nth = np.arange(len(by)) - np.repeat(first, np.diff(np.append(first, len(by))))
        keep = np.sort(by[nth <= k])
        y, own, ids, theirs = y[keep], own[keep], ids[keep], ranks[0][keep]
        who, found = [], []
        for c in range(0, len(x) if len(y) else 0, step := max(1, TOGETHER // max(1, len(y)))):
            part = slice(c, c + step)
            s = x[part] @ y.T
            s[(footrule(ranks[1][part], theirs) > radius) | (me[part][:, None] == own[None, :])] = -np.inf
            if len(y) > k:
                floor = np.partition(s, len(y) - k, axis=1)[:, len(y) - k]
                slack = 1e-9 * np.abs(np.where(np.isfinite(floor), floor, 0))
                q, v = np.nonzero(np.isfinite(s) & (s >= (floor - slack)[:, None]))
            else:
                q, v = np.nonzero(np.isfinite(s))
            who.append(q + c)
            found.append(v)
        q, v = (np.concatenate(a) if a else np.zeros(0, np.int64) for a in (who, found))
        # row by row, so that a score does not depend on how a block was put together
        scores = np.concatenate([(x[q[c : c + 65536]] * y[v[c : c + 65536]]).sum(1) for c in range(0, len(q), 65536)] or [np.zeros(0)])
        order = np.lexsort((ids[v], -scores, q))
        q, v, scores = q[order], v[order], scores[order]
        head = np.flatnonzero(np.diff(q, prepend=-1))
        keep = np.arange(len(q)) - np.repeat(head, np.diff(np.append(head, len(q)))) < k
        q, v = q[keep], v[keep]
        return pa.table({"query": pa.array(me[q], pa.int64()), "query_id": queries.column("id").combine_chunks().take(pa.array(q)), "vec_id": pa.array(ids[v], pa.int64()), "score": pa.array(scores[keep], pa.float64())})

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = RECALL, pivots: int = PIVOTS, block: int = BLOCK, query_part: int = QUERY_PART) -> DataFrame:
    """For each query row its k nearest other rows by inner product: query_id, rank (from 1), vec_id, score.

    recall: the share of true neighbours that each cut keeps where it is measured; 1 or more gives the exact result.

    Ties go to the smaller id. Defined cases: vectors that are null, zero, hold null or non-finite numbers, or are not of
    the valid vectors' most common length, and rows without an id, take no part. Rows that share an id are rows of their
    own: each is a candidate (also to the others) and each query row has its own ranks. A query with fewer candidates gets
    all of them. An empty table, or one without queries, gives no rows. Only the named columns are read.
    """
    spark = vectors.sparkSession
    shared_dir(spark)
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).cast("long").alias("asks"), F.col(vec_col).alias("v"))
    dim = dimension(rows, "v")
    base = written(spark, as_bytes(rows, ["row", "id", "asks"], "v", dim).where("vec is not null"), "ann-vectors")
    of_length = base.groupBy(F.floor(F.log("size") / float(np.log(BAND))).alias("band")).agg(F.count("*").alias("n"), F.sum("asks").alias("asks"), F.max("size").alias("top")).collect()
    n, asks = sum(r["n"] for r in of_length), sum(r["asks"] for r in of_length)
    _, sample = sampled(base, "row", dim)
    held = unit(sample)
    held = held[spread(held, pivots)]
    tops = bands([(r["band"], r["top"]) for r in of_length])
    used = min(FILES[0], len(held))
    everything = read, radius = len(tops) * PIVOTS, 2 * PERMUTED**2
    if recall < 1 and asks:
        used, read, radius = measured(base, sample, held, tops, n, dim, k, recall)
    sent = spark.sparkContext.broadcast((Files(held[:used], tops), held[:PERMUTED]))
    columns = "file int, row long, id long, ranks binary, vec binary"
    filed = written(spark, base.select("row", "id", "vec").mapInArrow(_filed(sent, dim), columns), "ann-files")
    in_file = filed.groupBy("file").agg(F.ceil(F.count("*") / block).alias("blocks"))  # as many rows as there are files
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    of = lambda salt, c: F.pmod(F.xxhash64("row", F.lit(salt)), F.col(c))

    def searched(queries: DataFrame, read: int, radius: int) -> DataFrame:
        asking = written(spark, queries.select("row", "id", "vec").mapInArrow(_routed(sent, dim, read), columns), "ann-queries")
        sizes = F.broadcast(asking.groupBy("file").agg(F.ceil(F.count("*") / query_part).alias("parts")).join(in_file, "file"))
        ours = filed.join(sizes, "file").withColumn("block", of(1, "blocks")).withColumn("part", every("parts")).withColumn("asking", F.lit(False))
        asking = asking.join(sizes, "file").withColumn("part", of(2, "parts")).withColumn("block", every("blocks")).withColumn("asking", F.lit(True))
        found = ours.unionByName(asking).groupBy("file", "block", "part").applyInArrow(_search(dim, k, radius), "query long, query_id long, vec_id long, score double")
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")))
        return written(spark, ranked.where(F.col("rank") <= k), "ann-found")

    queries = base.where("asks = 1")
    found = searched(queries, read, radius)
    # a query that met fewer than k reads every file, and nothing is cut
    full = found.groupBy("query").agg(F.count("*").alias("n")).where(F.col("n") >= min(k, n - 1)).select(F.col("query").alias("row"))
    short = queries.join(full, "row", "left_anti")
    if (read, radius) != everything and not short.isEmpty():
        short = written(spark, short, "ann-short")
        found = found.join(short.select(F.col("row").alias("query")), "query", "left_anti").unionByName(searched(short, *everything))
    return found.select("query_id", "rank", "vec_id", "score")
