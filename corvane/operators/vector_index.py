"""Stored vector indexes: an inverted file by cells, and late interaction over token tables on top of it.

    cells      cell, key, vec: a folder for each cell, so that a search reads the folders of probed cells only
    centres    cell, centre, radius, n

Building and searching are calls of their own. Centres are fitted on a bounded sample; every vector is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.retrieval import BLOCK, _keeping, in_slices, top_k
from corvane.sources.files import cached, scratch

#: Vectors of the sample that centres are fitted on, for each cell.
SAMPLE = 256


@dataclass(frozen=True)
class CellIndex:
    path: str

    def cells(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/cells")

    def centres(self, spark: SparkSession) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """cell, centre, radius and size: a row for each cell, a number that the caller chose."""
        rows = spark.read.parquet(f"{self.path}/centres").orderBy("cell").toArrow().combine_chunks()
        width = len(rows.column("centre")[0]) if rows.num_rows else 0
        return rows.column("cell").to_numpy(), rows.column("centre").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, width), rows.column("radius").to_numpy(), rows.column("n").to_numpy()


def _sound(vec: str):
    return F.col(vec).isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda e: F.coalesce(F.abs(e.cast("double")) < F.lit(float("inf")), F.lit(False)))


def _assigned(sent):
    """Per batch of (key, vec): cell, key, vec, distance to the cell's centre. Ships without the library."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        centres = sent.value
        size = (centres * centres).sum(1)
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                cell = (size[None, :] - 2 * (x @ centres.T)).argmin(1)
                away = np.sqrt(((x - centres[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column(0), batch.column(1), pa.array(away)], names=["cell", "key", "vec", "away"])

    return run


def build_cells(vectors: DataFrame, cells: int, path: str | None = None, seed: int = 11, sample: int = SAMPLE) -> CellIndex:
    """Index vectors (doc_id, vec) in at most `cells` cells.

    Centres are k-means of at most cells x sample vectors, the first by a hash of their id. Vectors that are null, empty or
    hold null or non-finite entries, rows without an id and vectors of another width than the most common take no part.
    Repeated rows are kept. Many tasks write the folder of a cell, so a cell that holds a third of all vectors is no hot spot.
    """
    spark = vectors.sparkSession
    path = path or scratch(spark, "cells")
    rows = vectors.where(F.col("doc_id").isNotNull() & _sound("vec")).select(F.col("doc_id").cast("long").alias("key"), F.col("vec").cast("array<double>").alias("vec"))
    common = rows.groupBy(F.size("vec").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").first()
    width, n = (common["width"], common["n"]) if common else (0, 0)
    rows = rows.where(F.size("vec") == width)
    span = 1 << 30
    some = rows if n <= cells * sample else rows.where(F.pmod(F.xxhash64("key"), F.lit(span)) < int(span * cells * sample / n))
    if n:
        model = KMeans(k=min(cells, n), seed=seed, maxIter=10).fit(some.select(array_to_vector("vec").alias("features")))
        centres = np.array(model.clusterCenters())
    else:
        centres = np.zeros((0, 0))
    placed = rows.mapInArrow(_assigned(spark.sparkContext.broadcast(centres)), "cell int, key long, vec array<double>, away double")
    lane = F.pmod(F.xxhash64("key"), F.lit(4))
    placed.repartition("cell", lane).write.partitionBy("cell").parquet(f"{path}/cells") if n else placed.write.parquet(f"{path}/cells")
    sizes = spark.read.schema("cell int, key long, vec array<double>, away double").parquet(f"{path}/cells").groupBy("cell").agg(F.max("away").alias("radius"), F.count("*").alias("n"))
    named = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cell int, centre array<double>")
    named.join(sizes, "cell").coalesce(1).write.parquet(f"{path}/centres")
    return CellIndex(path)


def _probing(sent, metric: str, k: int):
    """Per batch of (cell, key, vec): the k best of each query that probes the cell; and a row for each query with query
    number -1 - q, its products computed in the task. Ships without the library."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        asked, q, probes = sent.value
        sign = 1 if metric == "l2" else -1
        work = np.zeros(len(q), np.int64)

        def best(who, doc, score):
            order = np.lexsort((doc, sign * score, who))
            who, doc, score = who[order], doc[order], score[order]
            first = np.flatnonzero(np.diff(who, prepend=-1))
            keep = np.arange(len(who)) - np.repeat(first, np.diff(np.append(first, len(who)))) < k
            return [who[keep], doc[keep], score[keep]]

        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for batch in batches:
            cell, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = batch.column(2).flatten().to_numpy().reshape(len(ids), -1)
            for c in np.unique(cell):
                here = np.flatnonzero(cell == c)
                whose = probes.get(int(c))
                if whose is None:
                    continue
                step = max(1, (1 << 22) // len(whose))
                for at in range(0, len(here), step):
                    some = here[at : at + step]
                    s = q[whose] @ x[some].T
                    if metric == "l2":
                        s = np.maximum((q[whose] ** 2).sum(1)[:, None] + (x[some] ** 2).sum(1)[None, :] - 2 * s, 0)
                    s = np.round(s, 6)
                    work[whose] += len(some)
                    key = sign * s
                    key[asked[whose][:, None] == ids[some][None, :]] = np.inf
                    limit = np.partition(key, k - 1, axis=1)[:, k - 1 : k] if len(some) > k else np.inf
                    who, i = np.nonzero((key <= limit) & np.isfinite(key))
                    held = best(*(np.concatenate(y) for y in zip(held, [whose[who], ids[some][i], s[who, i]], strict=True)))
        did = np.flatnonzero(work)
        rows = [np.append(held[0], -1 - did), np.append(held[1], work[did]), np.append(held[2], np.zeros(len(did)))]
        yield pa.RecordBatch.from_arrays([pa.array(r) for r in rows], names=["q", "doc_id", "score"])

    return run


def _searched(index: CellIndex, spark: SparkSession, asked: np.ndarray, q: np.ndarray, probes: dict[int, np.ndarray], metric: str, k: int) -> DataFrame:
    """q, doc_id, score of the best, and the work rows of _probing; only the folders of probed cells are read."""
    sent = spark.sparkContext.broadcast((asked, q, probes))
    rows = index.cells(spark).where(F.col("cell").isin([int(c) for c in probes])).select("cell", "key", "vec")
    return rows.mapInArrow(_probing(sent, metric, k), "q long, doc_id long, score double")


def _by_cell(pairs: np.ndarray) -> dict[int, np.ndarray]:
    """(query, cell) marks to the queries of each cell that any query probes."""
    return {int(c): np.flatnonzero(pairs[:, c]) for c in np.flatnonzero(pairs.any(axis=0))}


def search_cells(index: CellIndex, queries: DataFrame, probes: int, k: int, metric: str = "ip", complete: bool = False) -> tuple[DataFrame, DataFrame]:
    """query_id, doc_id, score (6 places), rank of the k best in the `probes` cells nearest to each query (query_id, qvec),
    itself excepted; and query_id, touched: how many vectors it was compared with.

    All cells give the exact result. With `complete`, so do fewer: every other cell that its radius does not rule out,
    given the k-th score, is searched too. metric is `ip` or `l2`. Queries are a stated set, taken in slices of bounded size; for
    a slice the driver holds (query, cell) marks, and in `complete` k rows for a query.
    """
    spark = queries.sparkSession
    cell, centres, radius, _ = index.centres(spark)
    found = tally = None
    for part in in_slices(queries, "query_id"):
        rows = part.where(F.col("query_id").isNotNull() & _sound("qvec")).select(F.col("query_id").cast("long").alias("query_id"), F.col("qvec").cast("array<double>").alias("qvec"))
        rows = rows.where(F.size("qvec") == centres.shape[1]).toArrow().combine_chunks()
        if not rows.num_rows or not len(cell):
            continue
        asked = rows.column("query_id").to_numpy()
        q = rows.column("qvec").combine_chunks().flatten().to_numpy().reshape(len(asked), -1)
        away = np.sqrt(np.maximum((q * q).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * q @ centres.T, 0))
        marks = np.zeros((len(q), int(cell.max()) + 1), bool)
        near = np.argsort(away, axis=1, kind="stable")[:, :probes]
        marks[np.arange(len(q))[:, None], cell[near]] = True
        out = _searched(index, spark, asked, q, _by_cell(marks), metric, k)
        if complete:
            first = out.toArrow().to_pandas()
            best = first[first["q"] >= 0].sort_values(["q", "score", "doc_id"], ascending=[True, metric == "l2", True]).groupby("q").head(k)
            kth = best.groupby("q")["score"].agg(["size", "last"])
            kth = kth[kth["size"] == k]["last"]
            if metric == "ip":
                floor = np.full(len(q), -np.inf)
                floor[kth.index] = kth
                may = q @ centres.T + np.sqrt((q * q).sum(1))[:, None] * radius[None, :] >= floor[:, None] - 1e-5
            else:
                floor = np.full(len(q), np.inf)
                floor[kth.index] = kth
                may = np.maximum(away - radius[None, :], 0) <= np.sqrt(floor + 1e-5)[:, None]
            rest = np.zeros_like(marks)
            rest[:, cell] = may
            rest &= ~marks
            out = spark.createDataFrame(pa.Table.from_pandas(first, preserve_index=False))
            if rest.any():
                out = out.unionByName(_searched(index, spark, asked, q, _by_cell(rest), metric, k))
        names = F.broadcast(spark.createDataFrame(pa.table({"q": pa.array(np.arange(len(asked))), "query_id": asked})))
        best = out.where("q >= 0").join(names, "q").select("query_id", "doc_id", "score")
        work = out.where("q < 0").select((-1 - F.col("q")).alias("q"), "doc_id").join(names, "q").groupBy("query_id").agg(F.sum("doc_id").alias("touched"))
        found, tally = (best, work) if found is None else (found.unionByName(best), tally.unionByName(work))
    if found is None:
        return spark.createDataFrame([], "query_id long, doc_id long, score double, rank long"), spark.createDataFrame([], "query_id long, touched long")
    return top_k(found, k, higher=metric != "l2"), tally  # one shuffle for all slices


# ---- late interaction over token tables


def _interaction(sent):
    """Per batch of (q, doc_id, tokens laid end to end): q, doc_id, MaxSim. Ships without the library."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        vectors, heads = sent.value  # query tokens laid end to end, and where each query's begin
        width = vectors.shape[1]
        for batch in batches:
            if not batch.num_rows:
                continue
            q, flat = batch.column(0).to_numpy(), batch.column(2)
            ends = flat.offsets.to_numpy().astype(np.int64) // width
            ends = ends - ends[0]
            x = flat.flatten().to_numpy().reshape(-1, width)
            score = np.zeros(len(q))
            for one in np.unique(q):
                mine = np.flatnonzero(q == one)
                m = ends[mine + 1] - ends[mine]
                at = np.repeat(ends[mine] - np.cumsum(m) + m, m) + np.arange(m.sum())
                dots = vectors[heads[one] : heads[one + 1]] @ x[at].T
                score[mine] = np.maximum.reduceat(dots, np.cumsum(m) - m, axis=1).sum(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round(score, 6))], names=["q", "doc_id", "score"])

    return run


def _scanned(sent, asked_ids: np.ndarray, k: int):
    """Per batch of (doc_id, tokens): the k best documents of each query over a whole scan. Ships without the library."""
    keeper, size = _keeping(), BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        vectors, heads = sent.value
        width, q_count = vectors.shape[1], len(heads) - 1
        floor, offer, settle = keeper(k, q_count)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                ids, flat = part.column(0).to_numpy(), part.column(1)
                ends = flat.offsets.to_numpy().astype(np.int64) // width
                ends = ends - ends[0]
                x = flat.flatten().to_numpy().reshape(-1, width)
                a = 0
                while a < q_count:
                    z = max(a + 1, int(np.searchsorted(heads, heads[a] + size // max(1, len(x)), side="right")) - 1)
                    # the best of a document for each query token, then the sum over a query's tokens; each has at least one
                    best = np.maximum.reduceat(vectors[heads[a] : heads[z]] @ x.T, ends[:-1], axis=1)
                    key = -np.round(np.add.reduceat(best, heads[a:z] - heads[a], axis=0), 6)
                    who, i = np.nonzero((key <= floor[a:z, None]) & np.isfinite(key))
                    use = asked_ids[who + a] != ids[i]
                    offer(who[use] + a, ids[i[use]].astype(np.int64), key[who[use], i[use]])
                    a = z
        who, doc, key = settle()
        yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(doc), pa.array(-key + 0.0)], names=["q", "doc_id", "score"])

    return run


@dataclass(frozen=True)
class TokenIndex:
    """Documents' unmasked tokens laid end to end (doc_id, tokens, n), and an inverted list of tokens by centre."""

    path: str
    cells: CellIndex
    width: int

    def documents(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/tokens")


def _end_to_end(tokens: DataFrame, key: str, width: int | None) -> DataFrame:
    """key, tokens (doubles, by position), n of the unmasked sound tokens of one width."""
    kept = tokens.where(F.col(key).isNotNull() & F.coalesce(F.col("mask"), F.lit(False)) & _sound("vec"))
    kept = kept.where(F.size("vec") == width) if width else kept
    each = F.struct(F.col("position").alias("position"), F.col("vec").cast("array<double>").alias("vec"))
    groups = kept.groupBy(F.col(key).cast("long").alias(key)).agg(F.sort_array(F.collect_list(each)).alias("t"))
    return groups.select(key, F.flatten("t.vec").alias("tokens"), F.size("t").cast("long").alias("n"))


def build_tokens(tokens: DataFrame, centres: int, path: str | None = None) -> TokenIndex:
    """Index a token table (doc_id, position, vec, mask). A masked token (mask false or null) can be nobody's best, as if it
    were minus infinity; documents without an unmasked token are found by nothing. Of tokens of several widths the most
    common counts. One document's tokens are one value, in one task."""
    spark = tokens.sparkSession
    path = path or scratch(spark, "tokens")
    sound = tokens.where(F.col("doc_id").isNotNull() & F.coalesce(F.col("mask"), F.lit(False)) & _sound("vec"))
    common = sound.groupBy(F.size("vec").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").first()
    width = common["width"] if common else 0
    _end_to_end(tokens, "doc_id", width or 1).write.parquet(f"{path}/tokens")
    return TokenIndex(path, build_cells(sound.select("doc_id", "vec"), centres, f"{path}/lists"), width)


#: Queries that are held against all documents to measure a recall; how often a depth may be doubled.
MEASURED, DOUBLINGS = 64, 2


def _deep_enough(index: TokenIndex, queries: DataFrame, k: int, probes: int, depth: int, recall: float) -> int | None:
    """The least doubled depth that finds this share of the true k best of some queries; None if none does."""
    ids = queries.where("mask").select("query_id").distinct().orderBy(F.xxhash64("query_id"), "query_id").limit(MEASURED)
    some = cached(queries.sparkSession, queries.join(F.broadcast(ids), "query_id", "left_semi"), "measured-queries")
    pairs = lambda df: {(r["query_id"], r["doc_id"]) for r in df.select("query_id", "doc_id").collect()}  # noqa: E731 - MEASURED * k rows
    true = pairs(max_sim(index, some, k))
    for _ in range(DOUBLINGS + 1):
        if len(true & pairs(max_sim(index, some, k, probes, depth))) >= recall * len(true):
            return depth
        depth *= 2
    return None


def max_sim(index: TokenIndex, queries: DataFrame, k: int, probes: int | None = None, depth: int = 100, recall: float | None = None) -> DataFrame:
    """query_id, doc_id, score, rank: the k best by late interaction, the sum over a query's tokens of the best inner product
    with a token of the document. queries: a token table (query_id, position, vec, mask); masked query tokens add nothing.

    probes None is exact: all documents are scanned in place. Otherwise a query's candidates are the documents of the
    `depth` best tokens of each of its tokens, in the `probes` lists nearest to it; they are scored exactly, on all their
    tokens. A document is not found by the query of its own id. Queries are a stated set, taken in slices.

    recall: the depth is doubled, at most DOUBLINGS times, until MEASURED queries held against all documents find this share
    of their true k best. Where that is not enough, lists do not tell these documents apart: all are scanned, which is exact.
    """
    spark = queries.sparkSession
    found = None
    if probes is not None and recall is not None:
        depth = _deep_enough(index, queries, k, probes, depth, recall)
        probes = None if depth is None else probes
    asked = _end_to_end(queries, "query_id", index.width or 1)
    for part in in_slices(asked, "query_id"):
        rows = part.orderBy("query_id").toArrow().combine_chunks()
        if not rows.num_rows or not index.width:
            continue
        ids = rows.column("query_id").to_numpy()
        vectors = rows.column("tokens").combine_chunks().flatten().to_numpy().reshape(-1, index.width)
        heads = np.append(0, np.cumsum(rows.column("n").to_numpy()))
        sent = spark.sparkContext.broadcast((vectors, heads))
        if probes is None:
            scored = index.documents(spark).select("doc_id", "tokens").mapInArrow(_scanned(sent, ids, k), "q long, doc_id long, score double")
        else:
            whose = np.repeat(np.arange(len(ids)), np.diff(heads))
            each = spark.createDataFrame(pa.table({"query_id": pa.array(-1 - np.arange(len(vectors))), "qvec": pa.array(list(vectors))}))
            of = spark.createDataFrame(pa.table({"token": pa.array(-1 - np.arange(len(vectors))), "q": pa.array(whose), "own": pa.array(ids[whose])}))
            hits = search_cells(index.cells, each, probes, depth)[0].select(F.col("query_id").alias("token"), "doc_id")
            pairs = hits.join(F.broadcast(of), "token").where("doc_id <> own").select("q", "doc_id").distinct()
            scored = pairs.join(index.documents(spark).select("doc_id", "tokens"), "doc_id").select("q", "doc_id", "tokens").mapInArrow(_interaction(sent), "q long, doc_id long, score double")
        names = F.broadcast(spark.createDataFrame(pa.table({"q": pa.array(np.arange(len(ids))), "query_id": ids})))
        best = scored.join(names, "q").select("query_id", "doc_id", "score")
        found = best if found is None else found.unionByName(best)
    return spark.createDataFrame([], "query_id long, doc_id long, score double, rank long") if found is None else top_k(found, k)  # one shuffle for all slices
