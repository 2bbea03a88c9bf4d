"""Retrieval channels. Each yields a ranked list: query_id, doc_id, score, rank (from 1, bigint)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions import vector as V
from corvane.sources.files import cached

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Query tables up to this many rows are broadcast to the scan of the corpus; larger ones are joined in slices.
QUERY_SLICE = 2000


def top_k(df: DataFrame, k: int, higher: bool = True, by: Sequence[str] = ("query_id",), score: str = "score", key: str = "doc_id") -> DataFrame:
    """The k best of each group, ties to the smaller key. Spark prunes within each partition before the shuffle."""
    order = F.col(score).desc() if higher else F.col(score).asc()
    w = Window.partitionBy(*by).orderBy(order, F.col(key))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def postings(docs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """term, doc_id, tf of a corpus (doc_id, text)."""
    return docs.select(*by, "doc_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy(*by, "doc_id", "term").agg(F.count("*").alias("tf"))


def in_slices(queries: DataFrame, key: str, most: int | None = None):
    """A stated query set in slices of at most about QUERY_SLICE rows (or `most`), so that what is broadcast has a bounded size."""
    slices = -(-queries.count() // (most or QUERY_SLICE)) or 1
    return [queries if slices == 1 else queries.where(F.pmod(F.xxhash64(key), F.lit(slices)) == s) for s in range(slices)]


def _counted():
    """Per batch of (group, by.., tokens): by, term, df; and for each group a row without a term: its documents and their
    words. Nothing here needs the library on the executors."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            groups = batch.column(0).dictionary_encode()
            group, tokens = groups.indices.to_numpy(), batch.column(batch.num_columns - 1)
            length = np.diff(tokens.offsets.to_numpy())
            words = tokens.flatten().dictionary_encode()
            v = max(1, len(words.dictionary))
            once = np.unique(np.repeat(np.arange(batch.num_rows), length) * v + words.indices.to_numpy())
            key, df = np.unique(group[once // v] * v + once % v, return_counts=True)
            many = len(groups.dictionary)
            _, first = np.unique(group, return_index=True)
            of = pa.array(first[np.append(key // v, np.arange(many))])
            terms = pa.concat_arrays([words.dictionary.take(pa.array(key % v)), pa.nulls(many, pa.string())])
            counts = [np.append(df, np.bincount(group, minlength=many)), np.append(np.zeros(len(df), np.int64), np.bincount(group, length, many).astype(np.int64))]
            names = ["term", "df", "dl"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(of) for c in range(1, batch.num_columns - 1)), terms, *map(pa.array, counts)], names=[*batch.schema.names[1:-1], *names])

    return run


def vocabulary(docs: DataFrame, by: Sequence[str], epsilon: float, group: Column, tokenize: Callable[[Column], Column]) -> DataFrame:
    """by, term, w: Okapi weights. A negative idf becomes epsilon times the mean idf over the vocabulary before that.

    Also n and avgdl of the group. Texts are tokenised once; what is shuffled is counts of terms, combined before.
    """
    kinds = dict(docs.dtypes)
    words = docs.select(group.alias("_group"), *by, F.coalesce(tokenize(F.col("text")), F.array().cast("array<string>")).alias("_words"))
    terms = words.mapInArrow(_counted(), ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "term string, df long, dl long"]))
    terms = cached(docs.sparkSession, terms.groupBy(*by, "term").agg(F.sum("df").alias("df"), F.sum("dl").alias("dl")), "vocabulary")
    stats = terms.where("term is null").select(*by, F.col("df").cast("double").alias("n"), (F.col("dl") / F.col("df")).alias("avgdl"))
    known = terms.where("term is not null").select(*by, "term", "df")
    idf = (known.join(stats, list(by)) if by else known.crossJoin(stats)).withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = idf.groupBy(*by).agg(F.avg("idf").alias("mean_idf"))
    idf = idf.join(mean, list(by)) if by else idf.crossJoin(mean)
    return idf.select(*by, "term", "n", "avgdl", F.when(F.col("idf") < 0, F.lit(epsilon) * F.col("mean_idf")).otherwise(F.col("idf")).alias("w"))


def _lexical(sent, k: int | None, share: float | None, k1: float, b: float):
    """Per batch of (group, doc_id, tokens): the pairs that share a term, the k best of each query or all; with `share`
    also those that hold this share of the query's distinct terms. Nothing here needs the library on the executors."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        grouped, terms, heads, who, weight, distinct, mean = sent.value
        q_count = len(distinct)
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool)]

        def best(q, doc, score, much):
            order = np.lexsort((doc, -score, q))
            q, doc, score, much = q[order], doc[order], score[order], much[order]
            if k is not None:
                first = np.flatnonzero(np.diff(q, prepend=-1))
                keep = (np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q)))) < k) | much
                q, doc, score, much = q[keep], doc[keep], score[keep], much[keep]
            return [q, doc, score, much]

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                tokens, group, ids = part.column(2), part.column(0), part.column(1).to_numpy(zero_copy_only=False)
                length = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(len(length)), length)
                named = pc.binary_join_element_wise(group.take(pa.array(row)), tokens.flatten(), "\x1f") if grouped else tokens.flatten()
                found = pc.index_in(named, value_set=terms)
                ok = found.is_valid().to_numpy(zero_copy_only=False)
                key = row[ok] * len(terms) + found.drop_null().to_numpy()
                key, tf = np.unique(key, return_counts=True)
                row, term = key // max(1, len(terms)), key % max(1, len(terms))
                n = heads[term + 1] - heads[term]
                spot = np.repeat(heads[term] - np.cumsum(n) + n, n) + np.arange(n.sum())
                q, r, tf = who[spot], np.repeat(row, n), np.repeat(tf, n)
                value = weight[spot] * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[r] / mean[q])))
                where = q * len(length) + r  # at most QUERY_SLICE queries times the documents of the part
                total, shared = np.bincount(where, value), np.bincount(where)
                pair = np.flatnonzero(shared)
                score, shared = np.round(total[pair], 6), shared[pair]
                q, r = pair // len(length), pair % len(length)
                much = shared >= share * distinct[q] if share is not None else np.zeros(len(q), bool)
                new = best(q, ids[r].astype(np.int64), score, much)
                if k is None:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in new], names=["q", "doc_id", "score", "much"])
                else:
                    held = best(*(np.concatenate(x) for x in zip(held, new, strict=True)))
        if k is not None and q_count:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["q", "doc_id", "score", "much"])

    return run


def bm25(docs: DataFrame, queries: DataFrame, by: Sequence[str] = (), k1: float = K1, b: float = B, epsilon: float = EPSILON, k: int | None = None, share: float | None = None, tokenize: Callable[[Column], Column] = T.tokens) -> DataFrame:
    """Okapi BM25 of every (query, document) that share a term: by, query_id, doc_id, score rounded to 6 places.

    Documents without words count in N and the mean length. A negative idf becomes epsilon times the mean idf over the
    vocabulary before that. A term the query repeats counts repeatedly. by: compute it apart in each group.

    k: only pairs that can be among the k best of their query, which keeps what leaves a task bounded. share: adds the
    column `much`, and keeps, whatever k is, the pairs where the document holds this share of the query's distinct terms.
    tokenize: text to an array of terms; T.tokens_with_marks counts punctuation as well.

    The corpus is not shuffled: terms are counted and scored where a document lies, against weights of the queries' terms
    that are broadcast in slices.
    """
    by = list(by)
    spark = docs.sparkSession
    group = F.concat_ws("\x1e", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by]) if by else F.lit("")
    words = vocabulary(docs, by, epsilon, group, tokenize)
    tokens = docs.where("doc_id is not null").select(group.alias("group"), F.col("doc_id").cast("long").alias("doc_id"), tokenize(F.col("text")).alias("tokens"))
    out = None
    for part in in_slices(queries, "query_id"):
        asked = part.select(F.col("query_id").cast("long").alias("query_id"), F.explode(tokenize(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
        size = {r["query_id"]: r["n"] for r in asked.groupBy("query_id").agg(F.count("*").alias("n")).collect()} if share is not None else {}
        asked = words.join(asked, "term").select(*by, group.alias("group"), "query_id", "term", "avgdl", (F.col("w") * F.col("qtf")).alias("w"))
        rows = asked.toArrow().combine_chunks().to_pandas().sort_values(["group", "term", "query_id"])
        if not len(rows):
            continue
        ids = rows[[*by, "group", "query_id", "avgdl"]].drop_duplicates(["group", "query_id"]).reset_index(drop=True)
        who = rows.merge(ids.assign(q=ids.index)[["group", "query_id", "q"]], on=["group", "query_id"], how="left")
        named = (who["group"] + "\x1f" + who["term"] if by else who["term"]).to_numpy()
        first = [0, *(i for i in range(1, len(named)) if named[i] != named[i - 1])]
        sent = spark.sparkContext.broadcast((bool(by), pa.array(named[first], pa.string()), np.append(first, len(named)), who["q"].to_numpy(), who["w"].to_numpy(), np.array([size.get(i, 0) for i in ids["query_id"]]), ids["avgdl"].to_numpy()))
        scored = tokens.mapInArrow(_lexical(sent, k, share, k1, b), "q long, doc_id long, score double, much boolean")
        names = spark.createDataFrame(pa.Table.from_pandas(ids.assign(q=ids.index)[["q", *by, "query_id"]], preserve_index=False))
        scored = scored.join(names, "q").select(*by, "query_id", "doc_id", "score", *(["much"] if share is not None else []))
        out = scored if out is None else out.unionByName(scored)
    if out is None:
        kinds = dict(docs.dtypes)
        return spark.createDataFrame([], ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "query_id long, doc_id long, score double", *(["much boolean"] if share is not None else [])]))
    return out


def zero_filled(ranked: DataFrame, docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Lists of exactly k: documents without a shared term follow at score 0, by id.

    Only the k smallest ids plus the list's own can be needed for each query, so the corpus is not crossed with the queries.
    """
    first = docs.select("doc_id").orderBy("doc_id").limit(2 * k)
    spare = queries.select("query_id").crossJoin(F.broadcast(first)).join(ranked.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").withColumn("score", F.lit(0.0))
    return top_k(ranked.select("query_id", "doc_id", "score").unionByName(spare), k)


def _keeping():
    """What keeps the k smallest keys of each query over a task. Made anew for each use, so that it ships without the library."""

    def keeper(k: int, count: int):
        import numpy as np

        floor = np.full(count, np.inf)  # the k-th smallest key of each query when last settled
        held, waiting, size = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)], [], 0

        def settle():
            nonlocal held, waiting, size
            who, doc, key = (np.concatenate(x) for x in zip(held, *waiting, strict=True))
            order = np.lexsort((doc, key, who))
            who, doc, key = who[order], doc[order], key[order]
            first = np.flatnonzero(np.diff(who, prepend=-1))
            place = np.arange(len(who)) - np.repeat(first, np.diff(np.append(first, len(who))))
            floor[who[place == k - 1]] = key[place == k - 1]
            held, waiting, size = [x[place < k] for x in (who, doc, key)], [], 0
            return held

        def offer(who, doc, key):
            nonlocal size
            waiting.append([who, doc, key])
            size += len(who)
            if size > max(1 << 18, len(held[0])):
                settle()

        return floor, offer, settle

    return keeper


#: Numbers in a block of a product of queries and documents: what a task holds does not grow with either.
BLOCK = 1 << 19


def _product(sent, metric: str, k: int, width: int):
    """Per task the k best documents of each query, by blocks of a matrix product. Nothing here needs the library on the
    executors."""
    keeper, size = _keeping(), BLOCK

    def run(batches):
        import numpy as np
        import pyarrow as pa

        asked, q = sent.value
        sign = 1 if metric == "l2" else -1
        floor, offer, settle = keeper(k, len(q))
        step = max(1, size // max(1, len(q) * (q.shape[1] // width if metric == "max_sim" else 1)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids = part.column(0).to_numpy()
                x = part.column(1).flatten().to_numpy().reshape(len(ids), -1)
                if metric == "ip":
                    key = -(q @ x.T)
                elif metric == "l2":
                    key = np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * (q @ x.T), 0)
                else:
                    a, b = q.reshape(len(q), -1, width), x.reshape(len(x), -1, width)
                    key = -sum(np.einsum("qd,nkd->qnk", a[:, i], b, optimize=True).max(2) for i in range(a.shape[1]))
                # rounding moves a key by half of the last place at most
                who, i = np.nonzero(key <= floor[:, None] + 1e-6)
                near = np.round(key[who, i], 6)
                use = np.isfinite(near) & (near <= floor[who]) & (asked[who] != ids[i])
                offer(who[use], ids[i[use]].astype(np.int64), near[use])
        who, doc, key = settle()
        yield pa.RecordBatch.from_arrays([pa.array(asked[who], pa.int64()), pa.array(doc, pa.int64()), pa.array(sign * key + 0.0)], names=["query_id", "doc_id", "score"])

    return run


def _against(docs: DataFrame, queries: DataFrame, k: int, higher: bool, kernel: Callable) -> DataFrame:
    """The k best of each query, by a scan of the documents for each slice of the queries. kernel: the broadcast ids and
    vectors of a slice to what a task does."""
    whole = lambda v: F.col(v).isNotNull() & F.forall(v, lambda e: e.isNotNull())
    docs = docs.where(F.col("doc_id").isNotNull() & whole("vec")).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("vec").cast("array<double>").alias("vec"))
    queries = queries.where(F.col("query_id").isNotNull() & whole("qvec")).select(F.col("query_id").cast("long").alias("query_id"), F.col("qvec").cast("array<double>").alias("qvec"))
    best = None
    for part in in_slices(queries, "query_id"):
        rows = part.toArrow().combine_chunks()
        if not rows.num_rows:
            continue
        q = np.array(rows.column("qvec").to_pylist(), float)
        sent = docs.sparkSession.sparkContext.broadcast((rows.column("query_id").to_numpy(), q))
        found = docs.where(F.size("vec") == q.shape[1]).mapInArrow(kernel(sent), "query_id long, doc_id long, score double")
        best = found if best is None else best.unionByName(found)
    # one shuffle for all slices, dealt by its size: ranked slice by slice, a union's task would sort once for each of them
    return docs.sparkSession.createDataFrame([], "query_id long, doc_id long, score double, rank long") if best is None else top_k(best, k, higher=higher)


def exact(docs: DataFrame, queries: DataFrame, metric: str, k: int, width: int = 1) -> DataFrame:
    """Every query against every document (doc_id, vec), itself excepted; the k best, scores rounded to 6 places.

    metric: `ip` (inner product), `l2` (squared distance, smaller is better) or `max_sim` (late interaction of vectors that
    are rows of `width` numbers each, laid end to end). Queries (query_id, qvec) are a stated set; they are broadcast in
    slices of bounded size, so the corpus is scanned in place and never shuffled, and a task returns k rows for a query.
    Rows without an id, without a vector or with a null in it take no part.
    """
    return _against(docs, queries, k, metric != "l2", lambda sent: _product(sent, metric, k, width))


def mean_pooled(df: DataFrame, group: str, vec: str) -> DataFrame:
    """The mean vector of each group; sums combine before the shuffle."""
    each = df.select(group, F.posexplode(vec).alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("parts")).select(group, F.transform("parts", lambda p: p["x"]).alias(vec))


def rerank_pool(pool: DataFrame, docs: DataFrame, queries: DataFrame, score: Callable[[Column, Column], Column], higher: bool = True) -> DataFrame:
    """Score only the pool's (query_id, doc_id) pairs by vectors, and rank them anew; native_rank stays for comparison."""
    scored = pool.join(docs, "doc_id").join(queries, "query_id").withColumn("score", F.round(score(F.col("qvec"), F.col("vec")), 6))
    order = F.col("score").desc() if higher else F.col("score").asc()
    return scored.select("query_id", "doc_id", F.col("rank").alias("native_rank"), "score", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "doc_id")).cast("long").alias("rank"))


def word_overlap(q: Column, d: Column) -> Column:
    """The share of a query's distinct words (an array) that the document's hold."""
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(d, q)) / F.greatest(F.size(q), F.lit(1)))


def lexical_overlap(query: Column, document: Column) -> Column:
    """A stand-in for a cross-encoder: the share of the query's distinct words that the document holds."""
    return word_overlap(F.array_distinct(T.tokens(query)), F.array_distinct(T.tokens(F.coalesce(document, F.lit("")))))


def rerank_head(ranked: DataFrame, scores: DataFrame, head: int) -> DataFrame:
    """Re-sort the first `head` by a second score (query_id, doc_id, second); the rest keep their order behind it."""
    joined = ranked.join(scores, ["query_id", "doc_id"], "left")
    inside = F.col("rank") <= head
    w = Window.partitionBy("query_id").orderBy(F.when(inside, 0).otherwise(1), F.when(inside, F.col("second")).desc_nulls_last(), F.col("rank"))
    return joined.withColumn("new_rank", F.row_number().over(w).cast("long"))


def _hashed(sent, planes: np.ndarray, k: int, radius: float, bucket: float):
    """Per task the k nearest documents of each query within the radius, of the buckets that its projections do not rule
    out. Nothing here needs the library on the executors."""
    keeper, size = _keeping(), BLOCK

    def run(batches):
        import numpy as np
        import pyarrow as pa

        asked, q = sent.value
        floor, offer, settle = keeper(k, len(q))
        placed, squared = q @ planes.T, (q * q).sum(1)
        step = max(1, size // max(1, len(q)))
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy().reshape(len(ids), -1)
            at = x @ planes.T
            # as many directions as leave a bucket some hundred vectors of the batch; all of them are used to rule it out
            codes = np.floor(at[:, : int(np.log2(max(1, len(ids) // 256)))] / bucket).astype(np.int64)
            order = np.lexsort(codes.T) if codes.shape[1] else np.arange(len(ids))
            edges = np.append(0, np.flatnonzero((np.diff(codes[order], axis=0) != 0).any(1)) + 1)
            for a, z in zip(edges, np.append(edges[1:], len(ids)), strict=True):
                for begin in range(a, z, step):
                    some = order[begin : min(z, begin + step)]
                    # a projection on a unit direction is never longer than the vector
                    gap = np.maximum(at[some].min(0) - placed, placed - at[some].max(0)).max(1)
                    near = np.flatnonzero(gap <= np.minimum(floor, radius) + 1e-9)
                    if not len(near):
                        continue
                    y = x[some]
                    d = squared[near][:, None] + (y * y).sum(1)[None, :] - 2 * (q[near] @ y.T)
                    who, i = np.nonzero(d <= (np.minimum(floor, radius)[near] ** 2 + 1e-9 * (1 + squared[near]))[:, None])
                    who, i = near[who], some[i]
                    # the distance itself, so that equal vectors are equally far
                    far = np.concatenate([np.sqrt(((x[i[c : c + 16384]] - q[who[c : c + 16384]]) ** 2).sum(1)) for c in range(0, len(i), 16384)] or [np.zeros(0)])
                    use = (far < radius) & (far <= floor[who]) & (asked[who] != ids[i])
                    offer(who[use], ids[i[use]].astype(np.int64), far[use])
        who, doc, far = settle()
        yield pa.RecordBatch.from_arrays([pa.array(asked[who], pa.int64()), pa.array(doc, pa.int64()), pa.array(far)], names=["query_id", "doc_id", "score"])

    return run


def lsh_search(docs: DataFrame, queries: DataFrame, k: int, radius: float = 1.6, bucket: float = 1.0, tables: int = 12, seed: int = 5) -> DataFrame:
    """The k nearest of each query within a radius, itself excepted; the score is the Euclidean distance. Exact.

    Random-projection hashing: vectors are hashed, where they lie, to buckets of width `bucket` on random unit directions.
    A query is compared with a bucket's vectors unless its projection on one of `tables` directions is farther from all of
    theirs than the radius, or than its k-th distance so far. Nothing is shuffled but k rows for a query and task. Queries
    and rows without vectors as in exact().
    """
    one = queries.where("qvec is not null").select(F.size("qvec").alias("width")).first()
    planes = np.random.default_rng(seed).normal(size=(tables, one["width"] if one else 1))
    planes /= np.sqrt((planes * planes).sum(1, keepdims=True))
    return _against(docs, queries, k, False, lambda sent: _hashed(sent, planes, k, radius, bucket))
