"""A stored inverted index for BM25, built once and searched without the texts.

    postings   part, grp, term, chunk, docs, tfs, dls: a row is a block, the postings of one term in one chunk of documents;
               part is a hash of the term and a folder of its own; folder -1 has each chunk's documents and words
    terms      grp, term, df, w: Okapi weights;   stats   grp, by, n, avgdl

Blocks are written once, where their documents lie, and not shuffled. An impact is what a posting adds to a score, but for the
weight of its term; it needs the mean length, so a search makes it. A search reads the folders its terms hash to, sends the
blocks of its terms to their chunk, and walks through the chunks with the k-th best score so far: the sum of the highest
impacts bounds what a query can score in a chunk, and blocks that no query needs are skipped (MaxScore by blocks).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators.retrieval import EPSILON, K1, B, in_slices
from corvane.sources.files import scratch, stored

#: Documents and words in a chunk, at most; a longer document is a chunk of its own. Folders that terms are spread over.
CHUNK_DOCS, CHUNK_WORDS, PARTS = 256, 1 << 20, 16
_POSTINGS = "grp string, chunk long, term string, n long, words long, docs array<bigint>, tfs array<int>, dls array<int>"


@dataclass(frozen=True)
class LexicalIndex:
    path: str
    by: tuple[str, ...]

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{name}")


def _chunked(docs: int, words: int):
    """Per batch of (grp, doc_id, tokens): the blocks of each chunk, and a row without a term with its documents and words.
    Nothing here needs the library on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            groups = batch.column(0).dictionary_encode()
            for g, name in enumerate(groups.dictionary.to_pylist()):
                part = batch.filter(pc.equal(groups.indices, g))
                sizes = pc.fill_null(pc.list_value_length(part.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                at = 0
                while at < part.num_rows:
                    to = at + max(1, min(docs, int(np.searchsorted(np.cumsum(sizes[at : at + docs]), words, side="right"))))
                    tokens, ids = part.column(2).slice(at, to - at), part.column(1).to_numpy()[at:to]
                    length = sizes[at:to]
                    coded = tokens.flatten().dictionary_encode()
                    key = coded.indices.to_numpy().astype(np.int64) * len(ids) + np.repeat(np.arange(len(ids)), length)
                    key, tf = np.unique(key, return_counts=True)
                    term, row = key // len(ids), key % len(ids)
                    heads = np.append(np.searchsorted(term, np.arange(len(coded.dictionary))), len(term))
                    heads = np.append(heads, len(term)).astype(np.int32)  # the last row has no postings
                    m = len(coded.dictionary) + 1
                    lists = [pa.ListArray.from_arrays(pa.array(heads), pa.array(x)) for x in (ids[row], tf.astype(np.int32), length[row].astype(np.int32))]
                    n = np.append(np.diff(heads[:-1]), len(ids)).astype(np.int64)
                    total = np.append(np.zeros(m - 1, np.int64), length.sum())
                    names = pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.nulls(1, pa.string())])
                    yield pa.RecordBatch.from_arrays([pa.array([name] * m, pa.string()), pa.array(np.full(m, number)), names, pa.array(n), pa.array(total), *lists], names=["grp", "chunk", "term", "n", "words", "docs", "tfs", "dls"])
                    number += 1
                    at = to

    return run


def _spread(docs: DataFrame) -> DataFrame:
    """Deal rows out where the files split into fewer tasks than there are cores: texts are costly to take apart."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def _write_apart(rows: DataFrame, folders: int, path: str) -> None:
    """Write rows in a folder for each `part`. A task holds a writer for each, so that it need not sort its rows by folder."""
    conf, name = rows.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name)
    conf.set(name, str(folders + 1))  # at as many as the bound Spark turns to sorting
    try:
        rows.write.partitionBy("part").parquet(path)
    finally:
        conf.set(name, before)


def build(docs: DataFrame, by: Sequence[str] = (), k1: float = K1, b: float = B, epsilon: float = EPSILON, tokenize: Callable[[Column], Column] = T.tokens, path: str | None = None, parts: int = PARTS, chunk_docs: int = CHUNK_DOCS) -> LexicalIndex:
    """Index a corpus (by.., doc_id, text): an index for each group of `by`, in one set of tables.

    Documents without words count in N and the mean length; those without an id take no part; null texts have no words.
    Texts are tokenised once, where they lie, into blocks, and each task writes its own into all folders at once; only counts
    of terms are shuffled. A frequent term has as many blocks as chunks.
    """
    spark = docs.sparkSession
    path = path or scratch(spark, "lexical-index")
    kinds = dict(docs.dtypes)
    group = F.concat_ws("\x1e", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by]) if by else F.lit("")
    tokens = _spread(docs.select(*by, "doc_id", "text")).where("doc_id is not null")
    tokens = tokens.select(group.alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(tokenize(F.col("text")), F.array().cast("array<string>")).alias("tokens"))
    blocks = tokens.mapInArrow(_chunked(chunk_docs, CHUNK_WORDS), _POSTINGS)
    part = F.when(F.col("term").isNull(), -1).otherwise(F.pmod(F.xxhash64("term"), F.lit(parts))).cast("int")
    _write_apart(blocks.withColumn("part", part), parts + 1, f"{path}/postings")
    raw = spark.read.schema(f"{_POSTINGS}, part int").parquet(f"{path}/postings")
    stats = raw.where("part = -1").groupBy("grp").agg(F.sum("n").cast("double").alias("n"), (F.sum("words") / F.sum("n")).alias("avgdl"))
    if by:  # a group's own values, with their types
        named = docs.select(group.alias("grp"), F.struct(*by).alias("by")).dropDuplicates(["grp"])
        stats = stats.join(named, "grp")
    stats.coalesce(1).write.parquet(f"{path}/stats")
    stats = spark.read.parquet(f"{path}/stats")
    idf = raw.where("part >= 0").groupBy("grp", "term").agg(F.sum("n").alias("df")).join(stats, "grp")
    idf = idf.withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).select("grp", "term", "df", "idf")
    idf.write.parquet(f"{path}/idf")
    idf = spark.read.parquet(f"{path}/idf")
    mean = idf.groupBy("grp").agg(F.avg("idf").alias("mean_idf"))
    weight = F.when(F.col("idf") < 0, F.lit(epsilon) * F.col("mean_idf")).otherwise(F.col("idf"))
    idf.join(mean, "grp").select("grp", "term", "df", weight.alias("w")).write.parquet(f"{path}/terms")
    made = {"by": list(by), "parts": parts, "k1": k1, "b": b, "kinds": {c: kinds[c] for c in by}}
    spark.createDataFrame([(json.dumps(made),)], "value string").coalesce(1).write.text(f"{path}/index")
    return LexicalIndex(path, tuple(by))


def index_of(docs: DataFrame, by: Sequence[str] = (), **options) -> LexicalIndex:
    """The index of a corpus read from files, built when first asked for."""
    return stored(docs, f"lexical {tuple(by)} {sorted(options.items())}", lambda: build(docs, by, **options))


def _walking(sent, k: int | None, share: float | None, k1: float, b: float):
    """Per task, chunk after chunk: blocks (grp, chunk, term, docs, tfs, dls) to the best k of each query, with the
    number of distinct terms shared, whether that is `share` of the query's, and the blocks met and skipped (query -1).
    Nothing here needs the library on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        codes, means, heads, who, weight, distinct, safe = sent.value
        q_count = len(distinct)
        floor = np.full(q_count, -np.inf)
        met = skipped = 0
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, bool)]

        def best(rows):
            q, doc, score = rows[:3]
            order = np.lexsort((doc, -score, q))
            rows = [x[order] for x in rows]
            first = np.flatnonzero(np.diff(rows[0], prepend=-1))
            place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
            if k is not None:
                full = rows[0][place == k - 1]
                floor[full] = rows[2][place == k - 1]
                rows = [x[(place < k) | rows[4]] for x in rows]
            return rows

        def scored(term, lists, tfs, dls):
            nonlocal met, skipped
            sizes = np.diff(lists.offsets.to_numpy())
            start = np.cumsum(sizes) - sizes
            docs, tf, dl = lists.flatten().to_numpy(), tfs.flatten().to_numpy(), dls.flatten().to_numpy()
            values = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / np.repeat(means[term], sizes)))
            top = np.maximum.reduceat(values, start)
            n = heads[term + 1] - heads[term]
            spot = np.repeat(heads[term] - np.cumsum(n) + n, n) + np.arange(n.sum())
            block = np.repeat(np.arange(len(term)), n)
            # MaxScore. Of a query's blocks, from the least bound up, those whose bounds sum to less than its k-th score are
            # not essential: a document in no other block cannot be among its k best. They are opened only for queries with
            # documents that, with all these bounds added, still can be. Rounding may lift a score by half of the last place.
            bound = weight[spot] * top[block]
            order = np.lexsort((bound, who[spot]))
            spot, block, bound = spot[order], block[order], bound[order]
            q = who[spot]
            total = np.cumsum(bound)
            first = np.flatnonzero(np.diff(q, prepend=-1))
            upto = total - np.repeat((total - bound)[first], np.diff(np.append(first, len(q))))
            essential = upto + 1e-6 >= floor[q] if safe and share is None and k is not None else np.ones(len(q), bool)
            here = np.unique(docs)

            def opened(which):
                m = sizes[block[which]]
                at = np.repeat(start[block[which]] - np.cumsum(m) + m, m) + np.arange(m.sum())
                return np.repeat(q[which], m) * len(here) + np.searchsorted(here, docs[at]), np.repeat(weight[spot[which]], m) * values[at]

            where, value = opened(essential)
            pair, at = np.unique(where, return_inverse=True)
            score, shared = np.bincount(at, value, len(pair)), np.bincount(at, minlength=len(pair))
            used = block[essential]
            if len(pair) and not essential.all():
                rest = np.bincount(q[~essential], bound[~essential], q_count)
                can = score + rest[pair // len(here)] + 1e-6 >= floor[pair // len(here)]
                pair, score, shared = pair[can], score[can], shared[can]
                asking = np.zeros(q_count, bool)
                asking[pair // len(here)] = True
                others = ~essential & asking[q]
                where, value = opened(others)
                at = np.minimum(np.searchsorted(pair, where), max(0, len(pair) - 1))
                ours = pair[at] == where if len(pair) else np.zeros(0, bool)
                score = score + np.bincount(at[ours], value[ours], len(pair))
                shared = shared + np.bincount(at[ours], minlength=len(pair))
                used = np.append(used, block[others])
            met += len(term)
            skipped += len(term) - len(np.unique(used))
            if not len(pair):
                return None
            q = pair // len(here)
            much = shared >= share * distinct[q] if share is not None else np.zeros(len(q), bool)
            return [q, here[pair % len(here)], np.round(score, 6), shared, much]

        def finish(pieces):
            nonlocal held
            whole = pa.Table.from_batches(pieces).combine_chunks().to_batches()[0]
            names = pa.compute.binary_join_element_wise(whole.column(0), whole.column(2), "\x1f")
            new = scored(pa.compute.index_in(names, value_set=codes).to_numpy(), whole.column(3), whole.column(4), whole.column(5))
            if new is not None:
                held = best([np.concatenate(x) for x in zip(held, new, strict=True)])

        import pyarrow.compute  # noqa: F401

        pieces, last = [], None
        for batch in batches:
            chunk = batch.column(1).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
            for a, z in zip(edges, edges[1:], strict=False):
                if a == z:
                    continue
                if pieces and chunk[a] != last:
                    finish(pieces)
                    pieces = []
                pieces.append(batch.slice(a, z - a))
                last = chunk[a]
        if pieces:
            finish(pieces)
        tally = [np.array([-1]), np.array([met]), np.array([0.0]), np.array([skipped]), np.array([False])]
        rows = [np.concatenate(x) for x in zip(held, tally, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["q", "doc_id", "score", "shared", "much"])

    return run


def search(index: LexicalIndex, queries: DataFrame, k: int | None, share: float | None = None, tokenize: Callable[[Column], Column] = T.tokens) -> DataFrame:
    """by.., query_id, doc_id, score, overlap, much: BM25 of pairs that share a term, as retrieval.bm25 gives them.

    k: pairs that can be among the k best of their query; None gives all, skips nothing, and holds a task's pairs in it.
    overlap is the share of the query's distinct words that the document holds, much whether it is at least `share`; such
    pairs are kept whatever k is, so nothing is skipped then. Queries (query_id, text) are a stated set, taken in slices
    of bounded size; their terms are broadcast.
    """
    return walked(index, queries, k, share, tokenize)[0]


def walked(index: LexicalIndex, queries: DataFrame, k: int | None, share: float | None = None, tokenize: Callable[[Column], Column] = T.tokens) -> tuple[DataFrame, DataFrame]:
    """search(), and a table of blocks met and skipped, a row for each task."""
    spark = queries.sparkSession
    by = list(index.by)
    stats = index.table(spark, "stats")
    made = json.loads(spark.read.text(f"{index.path}/index").first()[0])
    parts = made["parts"]
    found = tally = None
    for some in in_slices(queries, "query_id"):
        asked = some.select(F.col("query_id").cast("long").alias("query_id"), F.explode(tokenize(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
        rows = asked.toArrow().to_pandas()
        if not len(rows):
            continue
        size = rows.groupby("query_id").size().to_dict()
        wanted = spark.createDataFrame(pa.table({"term": pa.array(rows["term"].unique(), pa.string())}))
        known = index.table(spark, "terms").join(F.broadcast(wanted), "term").select("grp", "term", "w", F.pmod(F.xxhash64("term"), F.lit(parts)).alias("part"))
        known = known.toArrow().to_pandas()
        rows = rows.merge(known, on="term").sort_values(["grp", "term", "query_id"])
        if not len(rows):
            continue
        ids = rows[["grp", "query_id"]].drop_duplicates().reset_index(drop=True)
        ids["q"] = ids.index
        who = rows.merge(ids, on=["grp", "query_id"], how="left")
        named = (who["grp"] + "\x1f" + who["term"]).to_numpy()
        first = [0, *(i for i in range(1, len(named)) if named[i] != named[i - 1])]
        means = stats.select("grp", "avgdl").toArrow().to_pandas().set_index("grp")["avgdl"]
        means = means.reindex(who["grp"].iloc[first]).to_numpy()
        distinct = np.array([size[i] for i in ids["query_id"]])
        weight = (who["w"] * who["qtf"]).to_numpy()
        sent = spark.sparkContext.broadcast((pa.array(named[first], pa.string()), means, np.append(first, len(named)), who["q"].to_numpy(), weight, distinct, bool((weight >= 0).all())))
        blocks = index.table(spark, "postings").where(F.col("part").isin([int(p) for p in known["part"].unique()]))
        keys = spark.createDataFrame(pa.Table.from_pandas(known[["grp", "term"]], preserve_index=False))
        blocks = blocks.join(F.broadcast(keys), ["grp", "term"]).select("grp", "chunk", "term", "docs", "tfs", "dls")
        pairs = blocks.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_walking(sent, k, share, made["k1"], made["b"]), "q long, doc_id long, score double, shared long, much boolean")
        names = spark.createDataFrame(pa.Table.from_pandas(ids.assign(distinct=distinct), preserve_index=False))
        if by:
            names = names.join(stats.select("grp", "by"), "grp")
        new = pairs.where("q >= 0").join(F.broadcast(names), "q").select(*(F.col(f"by.`{c}`") for c in by), "query_id", "doc_id", "score", (F.col("shared") / F.col("distinct")).alias("overlap"), "much")
        count = pairs.where("q < 0").select(F.col("doc_id").alias("met"), F.col("shared").alias("skipped"))
        found, tally = (new, count) if found is None else (found.unionByName(new), tally.unionByName(count))
    if found is None:
        shape = ", ".join([*(f"`{c}` {made['kinds'][c]}" for c in by), "query_id long, doc_id long, score double, overlap double, much boolean"])
        return spark.createDataFrame([], shape), spark.createDataFrame([], "met long, skipped long")
    return found, tally
