"""Approximate nearest neighbours by proximity graphs: one for each shard of the vectors, all walked by a beam search.

Distances are squared Euclidean; of unit vectors they rank as inner products do. Vectors are dealt by a hash to shards of a
bounded size, so that a shard's graph is built and walked inside one task, whatever the number of vectors: building takes
one shuffle, a search one more, and neither has rounds. The graph is a table node, level, links: each vector's nearest in
its shard, and the nearest of those that have it among theirs, both of bounded number. Within a shard a walk's work grows
slowly with its vectors; over shards it adds up.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.retrieval import exact, in_slices, top_k
from corvane.sources.files import cached

#: Links of a node, each way, for a level.
DEGREE = 16
#: Numbers in the vectors of a shard, and in those of a slice of queries, about; cells of a task's tables of distances.
NUMBERS, CELLS = 1 << 21, 1 << 22
#: One row in THIN of a level is in the next, until at most ENTRIES are left.
THIN, ENTRIES = 8, 64
#: Queries that are held against all vectors to measure a recall; how often a beam may be doubled.
MEASURED, DOUBLINGS = 64, 3
_GRAPH = "node long, level int, links array<long>, shard int, vec array<double>"


def _ready(vectors: DataFrame) -> DataFrame:
    sound = F.col("vec").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda e: F.coalesce(F.abs(e.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return vectors.where(F.col("doc_id").isNotNull() & sound).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("vec").cast("array<double>").alias("vec"))


def _linked(degree: int, thin: int, entries: int, cells: int):
    """The graph of a shard's rows (shard, doc_id, vec, hash). Ships without the library."""

    def run(table: pa.Table) -> pa.Table:
        import numpy as np
        import pyarrow as pa

        order = np.argsort(table.column("doc_id").to_numpy(), kind="stable")
        ids, draw = table.column("doc_id").to_numpy()[order], table.column("hash").to_numpy()[order]
        vec = table.column("vec").combine_chunks().take(pa.array(order))
        x = vec.flatten().to_numpy().reshape(len(ids), -1)
        size = (x * x).sum(1)

        def nearest(part):
            """Pairs of positions: each row's nearest of the part, and each row with the nearest of those that have it."""
            k, y, s = min(degree, len(part) - 1), x[part], size[part]
            if k <= 0:
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            near, far, step = [], [], max(1, cells // len(part))
            for at in range(0, len(part), step):
                d = y[at : at + step] @ y.T
                d *= -2
                d += s[None, :]
                d += s[at : at + step, None]
                d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
                best = np.argpartition(d, k - 1, axis=1)[:, :k].copy()  # a view would hold the whole block
                near.append(best)
                far.append(np.take_along_axis(d, best, 1))
            a, b, d = np.repeat(np.arange(len(part)), k), np.concatenate(near).ravel(), np.concatenate(far).ravel()
            back = np.lexsort((a, d, b))
            first = np.flatnonzero(np.diff(b[back], prepend=-1))
            place = np.arange(len(back)) - np.repeat(first, np.diff(np.append(first, len(back))))
            back = back[place < degree]
            return part[np.append(a, b[back])], part[np.append(b, a[back])]

        level, pairs, part = np.zeros(len(ids), np.int32), [], np.arange(len(ids))
        for above in range(1, 22):
            a, b = nearest(part)
            pairs.append(a * len(ids) + b)
            upper = part[draw[part] % thin**above == 0]
            if len(part) <= entries or len(upper) < max(1, entries // thin):
                break
            level[upper], part = above, upper
        pairs = np.unique(np.concatenate(pairs))
        at = np.searchsorted(pairs // len(ids), np.arange(len(ids) + 1)).astype(np.int32)
        links = pa.ListArray.from_arrays(pa.array(at), pa.array(ids[pairs % len(ids)]))
        return pa.table({"node": ids, "level": level, "links": links, "shard": table.column("shard").to_numpy(), "vec": vec})

    return run


def knn_graph(vectors: DataFrame, degree: int = DEGREE, rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The graph (node, level, links; shard, vec) of vectors (doc_id, vec), and the vectors it is about: one written table.

    A row's links are its true nearest of its shard, found by comparing all of a shard, whose size is bounded; rounds of
    descent, which `rounds` used to bound, are not needed for that. So that a walk gets from any group of vectors to any
    other, a shard has levels: of each one row in THIN, by a hash, is in the next one, and has links to its nearest there as
    well. The last one, of a few dozen rows, is where walks begin.

    Vectors that are null, empty or hold null or non-finite entries, rows without an id, and those of another width than
    the most common take no part; of rows that share an id one counts. No list is longer than 2 x degree for a level,
    whatever is close to what: a node that very many are close to keeps its closest ones.
    """
    spark = vectors.sparkSession
    base = _ready(vectors).dropDuplicates(["doc_id"])
    widths = base.groupBy(F.size("vec").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").first()
    if widths is None:
        return spark.createDataFrame([], _GRAPH), base
    shards = -(-widths["n"] * widths["width"] // NUMBERS)
    dealt = base.where(F.size("vec") == widths["width"]).select(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(shards)).cast("int").alias("shard"), "doc_id", "vec", F.xxhash64("doc_id").alias("hash"))
    graph = cached(spark, _apart(dealt, shards).applyInArrow(_linked(degree, THIN, ENTRIES, CELLS), _GRAPH), "graph")
    return graph, graph.select(F.col("node").alias("doc_id"), "vec")


def _apart(df: DataFrame, shards: int):
    """Groups by shard, each in a partition of its own: a shard is long work for a task."""
    return df.repartitionById(shards, F.col("shard")).groupBy("shard")


def _walked(sent, k: int, beam: int, expand: int, cells: int):
    """Walks of all queries of a slice over a shard's graph: its k nearest of each query, and in a row without a document
    how many distances that took. Ships without the library."""

    def run(table: pa.Table) -> pa.Table:
        import numpy as np
        import pyarrow as pa

        asked, vectors = sent.value
        order = np.argsort(table.column("node").to_numpy(), kind="stable")
        ids, level = table.column("node").to_numpy()[order], table.column("level").to_numpy()[order]
        n, width = len(ids), max(beam, k)
        x = table.column("vec").combine_chunks().flatten().to_numpy().reshape(n, -1)[order]
        links = table.column("links").combine_chunks().take(pa.array(order))
        heads, links = np.append(0, np.cumsum(links.value_lengths().to_numpy())), np.searchsorted(ids, links.flatten().to_numpy())
        start = np.flatnonzero(level == level.max())
        own = np.minimum(np.searchsorted(ids, asked), n - 1)
        out = []
        step = max(1, cells // n)
        slot = np.zeros(min(step, len(asked)) * n, np.int32)
        for lo in range(0, len(asked), step):
            q, me = vectors[lo : lo + step], own[lo : lo + step]
            m = len(q)
            seen, tally = np.zeros(m * n, bool), np.zeros(m, np.int64)
            itself = np.flatnonzero(ids[me] == asked[lo : lo + step])
            seen[itself * n + me[itself]] = True
            held, dist, done = np.zeros((m, width), np.int64), np.full((m, width), np.inf), np.ones((m, width), bool)
            who, at = np.repeat(np.arange(m), len(start)), np.tile(start, m)
            while True:
                key = who * n + at
                key = key[~seen[key]]
                slot[key] = np.arange(len(key), dtype=np.int32)
                key = key[slot[key] == np.arange(len(key))]  # of equal ones the last
                seen[key] = True
                who, at = key // n, key % n  # by query still
                tally += np.bincount(who, minlength=m)
                d = np.zeros(len(key))
                for a in range(0, len(key), 8192):
                    gap = x[at[a : a + 8192]] - q[who[a : a + 8192]]
                    d[a : a + 8192] = np.einsum("ij,ij->i", gap, gap)
                near = d < dist[who, -1]
                who, at, d = who[near], at[near], d[near]
                if len(who):
                    count = np.bincount(who, minlength=m)
                    rows = np.flatnonzero(count)
                    place = width + np.arange(len(who)) - np.repeat(np.cumsum(count[rows]) - count[rows], count[rows])
                    row = np.repeat(np.arange(len(rows)), count[rows])
                    more = count.max()
                    both = [np.pad(a[rows], ((0, 0), (0, more)), constant_values=v) for a, v in ((held, 0), (dist, np.inf), (done, True))]
                    both[0][row, place], both[1][row, place], both[2][row, place] = at, d, False
                    best = np.argsort(both[1], axis=1, kind="stable")[:, :width]
                    held[rows], dist[rows], done[rows] = (np.take_along_axis(a, best, 1) for a in both)
                going = ~done[:, :beam]
                going &= np.cumsum(going, axis=1) <= expand
                if not going.any():
                    break
                done[:, :beam] |= going
                who, place = np.nonzero(going)
                node = held[who, place]
                many = heads[node + 1] - heads[node]
                at = links[np.repeat(heads[node] - np.cumsum(many) + many, many) + np.arange(many.sum())]
                who = np.repeat(who, many)
            score = np.round(dist, 6)
            best = np.lexsort((ids[held], score))[:, :k]
            score, near = np.take_along_axis(score, best, 1), np.take_along_axis(held, best, 1)
            who, place = np.nonzero(np.isfinite(score))
            out.append((asked[lo + who], ids[near[who, place]], score[who, place], np.zeros(len(who), np.int64)))
            out.append((asked[lo : lo + m], np.full(m, -1), np.zeros(m), tally))
        query, doc, score, distances = (np.concatenate(a) for a in zip(*out, strict=True))
        tallied = np.concatenate([np.full(len(a[0]), i % 2 == 1) for i, a in enumerate(out)])
        return pa.table({"query_id": query, "doc_id": pa.array(doc, mask=tallied), "score": score, "distances": distances})

    return run


def _wide_enough(index: tuple[DataFrame, DataFrame], queries: DataFrame, k: int, beam: int, expand: int | None, recall: float) -> int | None:
    """The least doubled beam that finds this share of the true k nearest of some queries; None if none does, or not without
    a quarter of all distances."""
    base = index[1]
    some = cached(base.sparkSession, queries.orderBy(F.xxhash64("query_id"), "query_id").limit(MEASURED), "measured-queries")
    pairs = lambda df: {(r["query_id"], r["doc_id"]) for r in df.select("query_id", "doc_id").collect()}  # noqa: E731 - MEASURED * k rows
    true, n = pairs(exact(base, some, "l2", k)), base.count()
    for _ in range(DOUBLINGS + 1):
        found, tally = graph_search(index, some, k, beam, expand)
        if len(true & pairs(found)) >= recall * len(true):
            return beam
        if (tally.agg(F.avg("distances")).first()[0] or 0) > n / 4:
            return None
        beam *= 2
    return None


def graph_search(index: tuple[DataFrame, DataFrame], queries: DataFrame, k: int, beam: int, expand: int | None = None, recall: float | None = None, scan: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The k nearest found of each query (query_id, qvec), itself excepted: query_id, doc_id, score (squared distance,
    rounded to 6 places), rank; and query_id, distances: how many each query computed.

    In each shard a query keeps the `beam` closest vectors met, starts at those of the graph's last level and follows the
    links of up to `expand` of them in a step (4, or an eighth of a wide beam), until it has followed all of its beam; the
    best of all shards are the result. A task walks one shard, for a block of queries at a time. Queries are a stated set,
    broadcast in slices of bounded size; none of their walks passes the driver. Queries of another width than the graph's,
    or without a sound vector, find nothing.

    recall: the beam is doubled, at most DOUBLINGS times, until MEASURED queries held against all vectors find this share of
    their true k nearest. Vectors without structure leave a graph nothing to follow: where no such beam is enough, or only one
    that computes over a quarter of all distances, all are scanned, which is exact; scan: that result, where a caller has it.
    """
    graph, base = index
    spark = base.sparkSession
    if recall is not None:
        wide = _wide_enough(index, queries, k, beam, expand, recall)
        if wide is None:
            found = exact(base, queries, "l2", k) if scan is None else scan
            return found, queries.select(F.col("query_id").cast("long").alias("query_id"), F.lit(base.count() - 1).alias("distances"))
        beam = wide
    expand = expand or max(4, beam // 8)
    one = base.select(F.size("vec").alias("width")).first()
    width = one["width"] if one else 0
    asked = _ready(queries.select(F.col("query_id").alias("doc_id"), F.col("qvec").alias("vec"))).where(F.size("vec") == width)
    shards = graph.agg(F.max("shard")).first()[0]
    every = None
    for part in in_slices(asked, "doc_id", max(1, NUMBERS // max(1, width))):
        rows = part.toArrow().combine_chunks()
        if not rows.num_rows or shards is None:
            continue
        vectors = rows.column("vec").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
        sent = spark.sparkContext.broadcast((rows.column("doc_id").to_numpy(), vectors))
        walks = _apart(graph.select("shard", "node", "level", "links", "vec"), shards + 1).applyInArrow(_walked(sent, k, beam, expand, CELLS), "query_id long, doc_id long, score double, distances long")
        every = walks if every is None else every.unionByName(walks)
    if every is None:
        return spark.createDataFrame([], "query_id long, doc_id long, score double, rank long"), spark.createDataFrame([], "query_id long, distances long")
    every = cached(spark, every, "graph-walks")
    found = top_k(every.where("doc_id is not null").select("query_id", "doc_id", "score"), k, higher=False)
    return found, every.where("doc_id is null").groupBy("query_id").agg(F.sum("distances").alias("distances"))
