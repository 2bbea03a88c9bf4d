"""Near-duplicate vectors by a pivot-permutation index.

Equal vectors are one node from the start. A node is described by its `posted` nearest pivots, in order of their inner
product with the centred vector, and two nodes are compared if they share at least `shared` of them. The inverted lists are
keyed by every subset of `shared` pivots of a node, so whoever meets in a list has the shared-pivot count; the more pivots
a key has, the shorter the lists. A pair is handled in the list of the smallest subset it shares, hence once, and verified
by its cosine in double precision. What a job returns is not its pairs, but how many vectors each node links to and edges
that connect what links.

`posted` and `shared` are chosen by measurement. A bounded number of sampled nodes is compared with all nodes by brute
force; of the settings that retrieve the wanted share of the links found (and of made pairs at the threshold, the hardest
there are) the one that costs least is taken. Where none does, as in one dense region in which pivots are met in any order,
all nodes are one list: every pair is compared. No pair below the threshold is ever linked.

Lists of any length are cut into blocks, and blocks are compared in pairs, so a job's size is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.cluster import shared_dir, written
from corvane.llm.components import components, min_labels
from corvane.llm.pivots import PIVOTS, as_bytes, dimension, matrix, nearest_pivots, sampled, spread, unit

#: Nodes for each pivot, as long as the bound on pivots allows.
NODES_PER_PIVOT = 64
BLOCK = 1024
#: Postings of short lists that share a job.
JOB_POSTINGS = 4096
#: Sampled nodes held against all nodes, and those of them that measure the cost.
ASKED, COST_ASKED = 512, 32
POSTED = (2, 3, 4, 6, 8, 12, 16, 24, 32)
SHARED = (1, 2, 3)
#: The shares of real links and of made ones that a setting must retrieve. A posting costs as much as so many comparisons.
RECALL, MADE_RECALL, POSTING_COST = 0.995, 0.985, 400
#: Subsets of one node that are too many to post.
MOST_KEYS = 64


def settings(pivots: int) -> list[tuple[int, int]]:
    """(posted, shared) pairs to choose from."""
    return sorted({(min(m, pivots), s) for m in POSTED for s in SHARED if s <= min(m, pivots) and comb(min(m, pivots), s) <= MOST_KEYS})


def _centred(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return unit(unit(x) - centre)


def _ranks_of(tops: np.ndarray, pivots: int) -> np.ndarray:
    """For each row the rank of each pivot among its tops; 255 where it is not among them."""
    r = np.full((len(tops), pivots), 255, np.uint8)
    np.put_along_axis(r, tops, np.arange(tops.shape[1], dtype=np.uint8)[None, :].repeat(len(tops), 0), 1)
    return r


def _common(tops: np.ndarray, ranks: np.ndarray, choices: list[tuple[int, int]]) -> dict[int, np.ndarray]:
    """Row by row (tops of one node, ranks of the other): how many pivots both have among their first m, for each m."""
    met = np.maximum(np.take_along_axis(ranks, tops, 1), np.arange(tops.shape[1], dtype=np.uint8)[None, :])
    return {m: (met < m).sum(1) for m in {m for m, _ in choices}}


def made_pairs(x: np.ndarray, threshold: float) -> np.ndarray:
    """For each unit vector another at a cosine from the threshold to a fifth of the way to 1, in a random direction."""
    r = np.random.default_rng(4)
    side = r.normal(size=x.shape)
    side = unit(side - (side * x).sum(1, keepdims=True) * x)
    c = (threshold + (1 - threshold) * r.uniform(0, 0.2, len(x)))[:, None]
    return c * x + np.sqrt(np.maximum(0, 1 - c * c)) * side


def _measure(sent, dim: int, choices: list[tuple[int, int]], threshold: float):
    """Per asked node, choice and task: links, links that the choice retrieves, and keys met (those that measure cost)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, ids, pivots, centre, most = sent.value
        tops_q = nearest_pivots(_centred(asked, centre), pivots, most)
        ranks_q, u_q = _ranks_of(tops_q, len(pivots)), unit(asked).astype(np.float32)
        links, found = np.zeros(len(asked), np.int64), np.zeros((len(choices), len(asked)), np.int64)
        met = np.zeros(len(choices))
        for batch in batches:
            x, node = matrix(batch.column(1), dim), batch.column(0).to_numpy()
            if not len(x):
                continue
            tops = nearest_pivots(_centred(x, centre), pivots, most)
            q, i = np.nonzero(u_q @ unit(x).astype(np.float32).T >= threshold)
            other = ids[q] != node[i]
            q, i = q[other], i[other]
            for c in range(0, len(q), 1 << 16):
                part, at = q[c : c + (1 << 16)], i[c : c + (1 << 16)]
                both = _common(tops[at], ranks_q[part], choices)
                links += np.bincount(part, minlength=len(asked))
                for k, (m, s) in enumerate(choices):
                    found[k] += np.bincount(part[both[m] >= s], minlength=len(asked))
            few = min(COST_ASKED, len(asked))
            both = _common(np.tile(tops, (few, 1)), np.repeat(ranks_q[:few], len(tops), 0), choices)
            for k, (m, s) in enumerate(choices):
                n = both[m].astype(float)
                met[k] += {1: n, 2: n * (n - 1) / 2, 3: n * (n - 1) * (n - 2) / 6}[s].sum()
        some = np.flatnonzero(links)
        k, q = (a.ravel() for a in np.meshgrid(np.arange(len(choices)), some, indexing="ij"))
        total = np.append(np.arange(len(choices)), k)
        yield pa.RecordBatch.from_arrays([pa.array(total.astype(np.int32)), pa.array(np.append(np.full(len(choices), -1), q).astype(np.int32)), pa.array(np.append(np.zeros(len(choices), np.int64), links[q])), pa.array(np.append(met, found[k, q]).astype(float))], names=["choice", "asked", "links", "found"])

    return run


def chosen_setting(nodes: DataFrame, sample: tuple[np.ndarray, np.ndarray], pivots: np.ndarray, centre: np.ndarray, dim: int, count: int, threshold: float, recall: float) -> tuple[int, int] | None:
    """(posted, shared) of least cost among those that retrieve the wanted share of links; None where none does."""
    choices = settings(len(pivots))
    most = max(m for m, _ in choices)
    ids, asked = (a[:ASKED] for a in sample)
    sent = nodes.sparkSession.sparkContext.broadcast((asked, ids, pivots, centre, most))
    rows = nodes.select("node", "vec").mapInArrow(_measure(sent, dim, choices, threshold), "choice int, asked int, links long, found double")
    rows = rows.groupBy("choice", "asked").agg(F.sum("links").alias("links"), F.sum("found").alias("found")).collect()
    shares: dict[int, list[tuple[float, float]]] = {k: [] for k in range(len(choices))}
    met = dict.fromkeys(range(len(choices)), 0.0)
    for r in rows:
        if r["asked"] < 0:
            met[r["choice"]] = r["found"]
        else:
            shares[r["choice"]].append((r["links"], r["found"]))
    x = unit(asked)
    both = _common(nearest_pivots(_centred(made_pairs(x, threshold), centre), pivots, most), _ranks_of(nearest_pivots(_centred(x, centre), pivots, most), len(pivots)), choices)
    best = None
    for k, (m, s) in enumerate(choices):
        retrieved = [f / n for n, f in shares[k]]
        # the mean over asked nodes and the mean over links: neither a large group nor the many small ones may be lost
        real = min(float(np.mean(retrieved)), sum(f for _, f in shares[k]) / sum(n for n, _ in shares[k])) if retrieved else 1.0
        cost = met[k] / max(1, min(COST_ASKED, len(asked))) / 2 + comb(m, s) * POSTING_COST
        if real >= recall and float((both[m] >= s).mean()) >= min(recall, MADE_RECALL) and (best is None or cost < best[0]):
            best = cost, m, s
    return best[1:] if best else None


def _post(sent, dim: int, posted: int, shared: int):
    """One row for each subset of `shared` of a node's nearest pivots; one in all where shared is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, centre = sent.value
        subsets = np.array(list(combinations(range(posted), shared)), np.int64).reshape(comb(posted, shared), shared)
        for batch in batches:
            x = matrix(batch.column(2), dim)
            if not len(x):
                continue
            tops = np.sort(nearest_pivots(_centred(x, centre), pivots, posted), axis=1) if shared else np.zeros((len(x), 0), np.int64)
            row = np.repeat(np.arange(len(x)), len(subsets))
            seen = [t.tobytes() for t in tops.astype("<u2")]
            yield pa.RecordBatch.from_arrays([pa.array(_keys(tops[:, subsets]).ravel()), *(batch.column(k).take(pa.array(row)) for k in (0, 1)), pa.array([seen[i] for i in row], pa.binary()), batch.column(2).take(pa.array(row))], names=["key", "node", "mult", "tops", "vec"])

    return run


def _keys(subsets: np.ndarray) -> np.ndarray:
    """One number for each ascending subset of pivots (last axis)."""
    key = np.zeros(subsets.shape[:-1], np.int64)
    for k in range(subsets.shape[-1]):
        key = (key << 11) | (subsets[..., k] + 1)
    return key


def first_common_key(a: np.ndarray, b: np.ndarray, shared: int) -> np.ndarray:
    """Row by row the key of the smallest subset of `shared` pivots that two ascending lists have in common."""
    out = np.zeros(len(a), np.int64)
    step = max(1, (1 << 22) // max(1, a.shape[1] ** 2))
    for c in range(0, len(a), step):
        x, y = a[c : c + step], b[c : c + step]
        hit = (x[:, :, None] == y[:, None, :]).any(2)
        at = np.argsort(~hit, axis=1, kind="stable")[:, :shared]
        out[c : c + step] = _keys(np.take_along_axis(x, at, 1).astype(np.int64))
    return out


def candidate_links(u: np.ndarray, tops: np.ndarray, left: np.ndarray, right: np.ndarray, key: int, shared: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of linking nodes that the list `key` is to report: verified, each once over all lists. left is right: within."""
    ok = u[left].astype(np.float32) @ u[right].astype(np.float32).T >= threshold - 1e-4
    i, j = np.nonzero(np.triu(ok, 1) if left is right else ok)
    i, j = left[i], right[j]
    exact = np.einsum("ij,ij->i", u[i], u[j]) >= threshold
    i, j = i[exact], j[exact]
    mine = first_common_key(tops[i], tops[j], shared) == key
    return i[mine], j[mine]


def _compare(dim: int, shared: int, threshold: float):
    """Links within the lists of one job: several short lists, or two blocks of a long one."""

    def run(job: pa.Table) -> pa.Table:
        bi, bj = (job.column(c)[0].as_py() for c in ("bi", "bj"))
        key = job.column("key").to_numpy()
        order = np.argsort(key, kind="stable")
        job, key = job.take(pa.array(order)), key[order]
        node, mult, block = job.column("node").to_numpy(), job.column("mult").to_numpy(), job.column("block").to_numpy()
        u = unit(matrix(job.column("vec"), dim))
        tops = np.frombuffer(b"".join(t.as_py() for t in job.column("tops")), "<u2").reshape(len(node), -1) if shared else np.zeros((len(node), 0), np.int64)
        edges = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        heads = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
        for a, b in zip(heads, np.append(heads[1:], len(key)), strict=True):
            at = np.arange(a, b)
            if bi == bj and len(at) > 1:
                edges.append(candidate_links(u, tops, at, at, key[a], shared, threshold))
            elif bi != bj:
                edges.append(candidate_links(u, tops, at[block[a:b] == bi], at[block[a:b] == bj], key[a], shared, threshold))
        i, j = (np.concatenate(e) for e in zip(*edges, strict=True))
        ids, where = np.unique(node, return_inverse=True)
        i, j, weight = where[i], where[j], np.zeros(len(ids), np.int64)
        weight[where] = mult
        degree = (np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))).astype(np.int64)
        root = min_labels(len(ids), i, j)
        moved, some = np.flatnonzero(root != np.arange(len(ids))), np.flatnonzero(degree)
        return pa.table({"a": pa.array(np.append(ids[moved], ids[some])), "b": pa.array(np.append(ids[root[moved]], np.zeros(len(some), np.int64))), "links": pa.array(np.append(np.zeros(len(moved), np.int64), degree[some]))})

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, recall: float = RECALL, setting: tuple[int, int] | None = None, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """Per row: id_col, n_links (other vectors linked directly), component_id (smallest id reachable), kept.

    recall: the share of links that the search depth must retrieve where it is measured; above 1 every pair is compared
    (the exact setting). setting: (posted, shared), in place of the measurement.

    Defined cases: vectors that are null, zero, hold null or non-finite numbers, or are not of the valid vectors' most
    common length, link with nothing. Equal vectors link with each other. Rows with a null id take part and come out with
    a null id and kept null. Repeated rows are vectors that link. An empty table gives no rows. With fewer different
    vectors than `shared` pivots, fewer are asked for. Only the named columns are read. Nodes are known by a 64-bit hash
    of the vector: two different vectors are one node with probability 2**-64 a pair.
    """
    spark = vectors.sparkSession
    shared_dir(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    dim = dimension(rows, "v")
    rows = as_bytes(rows, ["id"], "v", dim).select("id", "vec", F.when(F.col("vec").isNotNull(), F.xxhash64("vec")).alias("node"))
    rows = written(spark, rows, "neardup-rows")
    nodes = rows.where("vec is not null").groupBy("node").agg(F.min("id").alias("rep"), F.count("*").alias("mult"), F.first("vec").alias("vec"))
    nodes = written(spark, nodes, "neardup-nodes")
    count = nodes.count()
    sample = sampled(nodes, "node", dim)
    centre = unit(sample[1]).mean(0) if len(sample[1]) else np.zeros(dim)
    held = _centred(sample[1], centre)
    held = held[spread(held, min(pivots, max(16, count // NODES_PER_PIVOT)))]
    if not len(held) or recall > 1:
        setting = (0, 0)
    elif setting is None:
        setting = chosen_setting(nodes, sample, held, centre, dim, count, threshold, recall) or (0, 0)
    posted, shared = min(setting[0], len(held)), min(setting[1], len(held))
    sent = spark.sparkContext.broadcast((held, centre))
    listed = nodes.select("node", "mult", "vec").mapInArrow(_post(sent, dim, posted, shared), "key long, node long, mult long, tops binary, vec binary")
    listed = written(spark, listed, "neardup-lists")
    sizes = listed.groupBy("key").agg(F.count("*").alias("len")).where("len > 1")
    zero = F.lit(0).cast("long")
    jobs = max(1, count * comb(posted, shared) // JOB_POSTINGS)
    cut = listed.join(sizes, "key").withColumn("nb", F.ceil(F.col("len") / block)).withColumn("block", F.when(F.col("nb") > 1, F.pmod(F.xxhash64("node"), F.col("nb"))).otherwise(zero))
    cut = cut.withColumn("other", F.explode(F.sequence(zero, F.col("nb") - 1))).withColumn("job", F.when(F.col("nb") > 1, F.col("key")).otherwise(-1 - F.pmod(F.xxhash64("key"), F.lit(jobs))))
    cut = cut.select("job", "key", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "node", "mult", "tops", "vec")
    found = cut.groupBy("job", "bi", "bj").applyInArrow(_compare(dim, shared, threshold), "a long, b long, links long")
    found = written(spark, found, "neardup-links")
    joined = components(found.where("links = 0").select("a", "b"), "a", "b").select("node", F.col("component").alias("comp"))
    degree = found.where("links > 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    classes = nodes.select("node", "rep", "mult").join(joined, "node", "left").join(degree, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    # both written, so that what joins is two plain shuffles: the partition of a large component can then be split
    classes = written(spark, classes, "neardup-classes")
    least = written(spark, classes.groupBy("comp").agg(F.min("rep").alias("component_id")), "neardup-components")
    classes = classes.join(least, "comp").select("node", "component_id", (F.coalesce("links", zero) + F.col("mult") - 1).alias("n_links"))
    out = rows.select("id", "node").join(classes, "node", "left").select("id", F.coalesce("n_links", zero).alias("n_links"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
