"""Exact Jaccard self-join of documents on word shingles: a size-aware heavy-light join.

Two sets that link share at least ceil(0.8 n) elements, n the size of either. In one global order (rare first) they
therefore share at least k of their first n - ceil(0.8 n) + k elements. Small sets post every 2-subset of such a prefix
with k = 2 (few, and very selective). Large sets post its single elements with k growing with n; their inverted lists
are scanned and the shared elements of each pair counted, and a pair with fewer than k is no candidate: texts that only
share a passage fall out here. The boundary between small and large minimises the estimated cost over the corpus. Sets
that can meet a set over the boundary post in both forms, so no link is lost.

Only the order uses statistics that are not exact: a fixed-size counting sketch over all shingles of all documents puts
those that many documents share last. Any order gives the same links; this one keeps the lists short.

Pairs are only made from lists of bounded length. A longer (heavy) list ties its sets to the smallest of them. Pairs and
ties make candidate components. One of bounded size is compared within one task, each set shipped once. A larger one is
compared by blocks of it, or falls apart into its pairs, by their first set, and its heavy lists, by pairs of blocks of
each, whichever ships less: no task ever holds an unbounded group. Every comparison is on the whole sets.

Links are counted only where asked for. Without, a large component is compared in two steps: each block within itself and
with a few hubs, which in a group of near copies connects nearly all; then what the largest part lacks with everything. Two
sets that are connected already need not be compared, so a group of near copies costs in proportion to its size.

Sets are known by a 64-bit hash of their 64-bit shingle hashes; equal sets are one node from the start, so copies never
meet each other. Two different sets share a node id with probability 2**-64 a pair.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm import shingling as S
from corvane.llm.cluster import session_for_texts, shared_dir, written
from corvane.llm.components import components, min_labels

WORDS = 5
SKETCH_BITS = 22
SKETCH_BLOCKS = 128
#: Bits of the bit set for each id it holds, and the bounds of its size as a power of 2 (at most 128 MB).
BLOOM_PER_ID, BLOOM_LEAST, BLOOM_MOST = 16, 20, 30
#: From this sketch level on (each level doubles the count) a shingle's postings are spread over all buckets, and so are
#: those of a 2-subset of two such shingles.
HOT_LEVEL = 5
BUCKET_BYTES = 24 << 20
#: A candidate component up to this many sets and elements is compared in one task.
JOB_SETS, JOB_ELEMENTS = 2048, 2_000_000
#: Lists up to this many sets are scanned for pairs; longer ones are heavy, and cut into blocks of this many sets.
LIST_SETS = 64
BLOCK_SETS = 256
SMALL_MOST = 64
#: Sets of a large component that each of its blocks is compared with first.
HUBS = 16


def _blocks(counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    for k, part in enumerate(np.split(counts, SKETCH_BLOCKS)):
        yield k, zlib.compress(part.tobytes(), 1)


def _profile(k: int):
    """Per document its set size and set id; per partition one counting sketch of all its shingles, in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, n_held = np.zeros(1 << SKETCH_BITS, np.uint32), [], 0
        shift = np.uint64(64 - SKETCH_BITS)

        def flush() -> None:
            nonlocal counts, held, n_held
            if held:
                counts += np.bincount(np.concatenate(held), minlength=1 << SKETCH_BITS).astype(np.uint32)
            held, n_held = [], 0

        for batch in batches:
            data, offs = S.text_buffer(batch.column(1))
            sizes, ids = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for r, s in enumerate(S.shingle_sets(data, offs, k)):
                sizes[r], ids[r] = len(s), S.set_id(s)
                held.append((s >> shift).astype(np.int32))
                n_held += len(s)
                if n_held >= 1 << 21:
                    flush()
            none = pa.nulls(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes), pa.array(ids), none.cast(pa.int32()), none.cast(pa.int32()), none.cast(pa.binary())], names=["doc_id", "n", "sid", "part", "block", "payload"])
        flush()
        rows = list(_blocks(counts)) if counts.any() else []
        none, part = pa.nulls(len(rows), pa.int64()), pa.array([TaskContext.get().partitionId()] * len(rows), pa.int32())
        yield pa.RecordBatch.from_arrays([none, none, none, part, pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["doc_id", "n", "sid", "part", "block", "payload"])

    return run


def _in_lanes(rows: DataFrame, merge, shape: str) -> DataFrame:
    """Merge (part, block, payload) rows to (lane, block, payload): as many lanes as rows in each, so that neither this step
    nor the next, by block, gathers a row of every partition."""
    parts = (rows.agg(F.max("part")).first()[0] or 0) + 1
    lanes = rows.withColumn("lane", F.pmod("part", F.lit(ceil(parts**0.5))))
    return lanes.groupBy("lane", "block").applyInPandas(merge, shape)


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    c = np.zeros((1 << SKETCH_BITS) // SKETCH_BLOCKS, np.uint64)
    for p in rows["payload"]:
        got = zlib.decompress(p)
        c += np.frombuffer(got, np.uint32 if len(got) == 4 * len(c) else np.uint64)
    return pd.DataFrame({"block": [rows["block"].iloc[0]], "payload": [zlib.compress(c.tobytes(), 1)]})


def _levels(mean: float):
    """Merge one block of the sketches; return its level bytes and what the cost model needs."""
    noise = mean + 4 * mean**0.5 + 4

    def run(block: pd.DataFrame) -> pd.DataFrame:
        c = np.frombuffer(zlib.decompress(_added(block)["payload"].iloc[0]), np.uint64)
        f = c.astype(float)
        level = np.where(f > noise, np.floor(np.log2(np.maximum(f, 1) / noise)) + 1, 0).clip(0, 255).astype(np.uint8)
        low = f[level == 0]
        return pd.DataFrame({"block": [block["block"].iloc[0]], "payload": [zlib.compress(level.tobytes())], "c1": [low.sum()], "c2": [(low**2).sum()], "m": [len(low)]})

    return run


def _prefix(s: np.ndarray, levels: np.ndarray, length: int) -> np.ndarray:
    """The first `length` elements by (level, hash); s is sorted by hash."""
    lv = levels[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    low = s[lv == 0]
    return low[:length] if len(low) >= length else s[np.argsort(lv, kind="stable")[:length]]


def _least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def shared_least(n: int) -> int:
    """k of a large set: how many elements of its prefix a linking set shares at least."""
    return max(2, n // 16)


#: A posting: signature, set id, and how many shared signatures make a pair a candidate.
POSTING = np.dtype([("sig", "<i8"), ("sid", "<i8"), ("k", "<i4")])


def _postings(k: int, percent: int, levels_of, boundary: int, buckets: int):
    """Packed postings by bucket. Signatures of hot shingles, and of 2-subsets of them, are spread over the buckets by set id,
    and flagged as such."""
    both_from = ceil(percent * (boundary + 1) / 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = levels_of()

        def frequent(s: np.ndarray) -> np.ndarray:
            return levels[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] >= HOT_LEVEL

        def packed(held: list[tuple[np.ndarray, int, int]], hot: bool) -> tuple[list, list]:
            lens = [len(sig) for sig, *_ in held]
            post = np.empty(sum(lens), POSTING)
            if not len(post):
                return [], []
            sig = np.concatenate([x for x, *_ in held])
            post["sig"], post["sid"], post["k"] = sig.view(np.int64), np.repeat([x for _, x, _ in held], lens), np.repeat([x for *_, x in held], lens)
            lane = S.mix(sig ^ (post["sid"].view(np.uint64) if hot else np.uint64(0))) % np.uint64(buckets)
            order = np.argsort(lane, kind="stable")
            lane, post = lane[order], post[order]
            cut = np.flatnonzero(np.diff(lane, prepend=np.uint64(buckets + 1)))
            return lane[cut].astype(np.int64).tolist(), [x.tobytes() for x in np.split(post, cut[1:])]

        for batch in batches:
            data, offs = S.text_buffer(batch.column(0))
            cool, hot = [], []
            for s in S.shingle_sets(data, offs, k):
                n = len(s)
                if not n:
                    continue
                sid, need = S.set_id(s), _least_overlap(n, percent)
                if n <= boundary and need >= 2:
                    p = np.sort(_prefix(s, levels, n - need + 2))
                    x, y = np.triu_indices(len(p), 1)
                    pair, often = S.mix(p[x] * np.uint64(3) + S.mix(p[y] + np.uint64(11))), frequent(p)
                    # a pair is at most as frequent as the rarer of its two
                    both = often[x] & often[y]
                    cool.append((pair[~both], sid, 1))
                    hot.append((pair[both], sid, 1))
                if n > boundary or need < 2 or n >= both_from:
                    least = min(shared_least(n), need)
                    p = _prefix(s, levels, n - need + least)
                    warm = frequent(p)
                    cool.append((p[~warm], sid, least))
                    hot.append((p[warm], sid, least))
            for held, flag in ((cool, False), (hot, True)):
                lane, payload = packed(held, flag)
                yield pa.RecordBatch.from_arrays([pa.array(lane, pa.int64()), pa.array([flag] * len(lane), pa.bool_()), pa.array(payload, pa.binary())], names=["bucket", "hot", "payload"])

    return run


def _spans(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The positions first .. first + length - 1 of each span, one after the other."""
    return np.repeat(first - np.cumsum(length) + length, length) + np.arange(length.sum())


def _scan(list_sets: int):
    """Scan one bucket's inverted lists. light: (a, b, shared here, k) of each pair in a list; heavy: (signature, set)."""

    def run(bucket: pa.Table) -> pa.Table:
        hot = bucket.column("hot")[0].as_py()
        post = np.concatenate([np.frombuffer(p.as_buffer(), POSTING) for p in bucket.column("payload")])
        post = post[np.lexsort((post["sid"], post["sig"]))]
        head = np.append(True, post["sig"][1:] != post["sig"][:-1])
        fresh = head | np.append(True, post["sid"][1:] != post["sid"][:-1])
        post, head = post[fresh], head[fresh]
        heads = np.flatnonzero(head)
        length = np.diff(heads, append=len(post))
        heavy = np.repeat((length > list_sets) | hot, length)
        light = heads[(length >= 2) & (length <= list_sets) & (not hot)]
        size = length[(length >= 2) & (length <= list_sets) & (not hot)]
        left, right = [], []
        for d in range(1, int(size.max()) if len(size) else 0):
            x = _spans(light[size > d], size[size > d] - d)
            left.append(x)
            right.append(x + d)
        left, right = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        a, b, k = post["sid"][left], post["sid"][right], np.minimum(post["k"][left], post["k"][right])
        order = np.lexsort((b, a))
        a, b, k = a[order], b[order], k[order]
        one = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, np.int64)
        count = np.diff(one, append=len(a))
        least = np.minimum.reduceat(k, one) if len(a) else k
        n, m = len(one), int(heavy.sum())
        return pa.table({"heavy": pa.array(np.repeat([False, True], [n, m])), "a": pa.array(np.append(a[one], post["sig"][heavy])), "b": pa.array(np.append(b[one], post["sid"][heavy])), "shared": pa.array(np.append(count, np.zeros(m, np.int64))), "k": pa.array(np.append(least.astype(np.int64), np.zeros(m, np.int64)))})

    return run


def boundary_by_cost(sizes: dict[int, int], list_length: float, percent: int) -> int:
    """The largest set size that is small: posting 2-subsets up to it costs least in all.

    sizes: number of sets by size, all sizes over SMALL_MOST under one key. A posting costs 1; scanning an inverted list
    costs its expected length once more.
    """

    def light(n: int) -> float:
        p = n - _least_overlap(n, percent) + 2
        return p * (p - 1) / 2 if _least_overlap(n, percent) >= 2 else heavy(n)

    def heavy(n: int) -> float:
        need = _least_overlap(n, percent)
        return (n - need + min(shared_least(n), need)) * (1 + list_length)

    def total(b: int) -> float:
        return sum(c * ((light(n) if n <= b else 0) + (heavy(n) if n >= percent * (b + 1) / 100 else 0)) for n, c in sizes.items())

    return min(range(SMALL_MOST + 1), key=lambda b: (total(b), -b))


def _pairs(a: list[np.ndarray], b: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs with a common element, and how many: of all pairs within a (b None), or between a and b.

    Columns are the elements at least two sets have. Where they are dense, blocks are multiplied; else pairs are counted
    from the columns' lists.
    """
    sets = a + (b or [])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    element = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    order = np.argsort(element, kind="stable")
    element, owner = element[order], owner[order]
    heads = np.flatnonzero(np.diff(element, prepend=~element[:1]) != 0)
    lengths = np.diff(heads, append=len(element))
    keep = np.repeat(lengths >= 2, lengths)
    owner, lengths = owner[keep], lengths[lengths >= 2]
    column = np.repeat(np.arange(len(lengths)), lengths)
    na, n = len(a), len(sets)
    if not len(lengths):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if (lengths.astype(float) ** 2).sum() / 2 > n * n * len(lengths) / 200 or n <= 2:
        total = np.zeros((na, n if b is None else n - na), np.float32)
        for c in range(0, len(lengths), 4096):
            lo, hi = np.searchsorted(column, (c, c + 4096))
            m = np.zeros((n, min(4096, len(lengths) - c)), np.float32)
            m[owner[lo:hi], column[lo:hi] - c] = 1
            total += m[:na] @ (m if b is None else m[na:]).T
        i, j = np.nonzero(np.triu(total, 1) if b is None else total)
        return i, j if b is None else j + na, total[i, j if b is None else j].astype(np.int64)
    codes, first = [], np.cumsum(lengths) - lengths
    for d in range(1, int(lengths.max())):
        at = first[lengths > d]
        span = lengths[lengths > d] - d
        left = _spans(at, span)
        x, y = owner[left], owner[left + d]
        if b is not None:
            across = (np.minimum(x, y) < na) & (np.maximum(x, y) >= na)
            x, y = x[across], y[across]
        codes.append(np.minimum(x, y) * n + np.maximum(x, y))
    code, common = np.unique(np.concatenate(codes), return_counts=True)
    return code // n, code % n, common


def linked_pairs(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None, block: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of linking sets, by blocks. side: 1 and 2 for the halves of a long list's block pair."""
    size = np.array([len(s) for s in sets])
    groups = [np.flatnonzero(side == 1), np.flatnonzero(side == 2)] if side is not None else [np.arange(k, min(k + block, len(sets))) for k in range(0, len(sets), block)]
    for x, left in enumerate(groups):
        for y in range(x, len(groups)) if side is None else range(1, 2) if x == 0 else ():
            right = groups[y]
            i, j, common = _pairs([sets[r] for r in left], None if x == y else [sets[r] for r in right])
            at = left if x == y else np.concatenate([left, right])
            i, j = at[i], at[j]
            link = 100 * common >= percent * (size[i] + size[j] - common)
            yield i[link], j[link]


def _compare(percent: int, count_links: bool):
    """Links of one job's sets. Jobs: 0 a whole component, or a part of one, 3 two blocks of one, 1 a set and its candidates,
    2 two blocks of a heavy list. Out: 0 (set, set) edges that connect what links; and if links are counted: 1 links of a
    set, weighted by copies, from jobs that meet each pair once (0, 3); 2 every link, from the others."""

    def run(job: pa.Table) -> pa.Table:
        job = job.sort_by("sid")
        sid = job.column("sid").to_numpy()
        first = np.diff(sid, prepend=~sid[:1]) != 0
        job, sid = job.filter(pa.array(first)), sid[first]
        mult = job.column("mult").to_numpy()
        kind, li, lj = (job.column(c)[0].as_py() for c in ("kind", "bi", "bj"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in job.column("elements")]
        side = np.where(job.column("block").to_numpy() == li, 1, 2) if li != lj else None
        labels, degree, links = np.arange(len(sets)), np.zeros(len(sets), np.int64), []
        for i, j in linked_pairs(sets, percent, side):
            labels = min_labels(len(sets), i, j, labels)
            if not count_links:
                if not labels.any():
                    break
            elif kind in (0, 3):
                degree += np.bincount(i, mult[j], len(sets)).astype(np.int64) + np.bincount(j, mult[i], len(sets)).astype(np.int64)
            else:
                links.append((np.minimum(i, j), np.maximum(i, j)))
        moved = np.flatnonzero(labels != np.arange(len(sets)))
        out = [(0, sid[moved], sid[labels[moved]])]
        if count_links and kind in (0, 3):
            some = np.flatnonzero(degree)
            out.append((1, sid[some], degree[some]))
        out += [(2, sid[i], sid[j]) for i, j in links]
        return pa.table({"kind": pa.array(np.repeat([k for k, *_ in out], [len(a) for _, a, _ in out]), pa.int32()), "a": pa.array(np.concatenate([a for _, a, _ in out])), "b": pa.array(np.concatenate([b for *_, b in out]))})

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(S.shingle_sets(*S.text_buffer(batch.column(0)), k))
            yield pa.RecordBatch.from_arrays([pa.array([S.set_id(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["sid", "elements"])

    return run


def _bits(ids: np.ndarray, bits: int) -> np.ndarray:
    h = S.mix(ids.astype(np.int64).view(np.uint64))
    return np.concatenate([h >> np.uint64(64 - bits), h & np.uint64((1 << bits) - 1)]).astype(np.int64)


def bloom_of(spark: SparkSession, ids: DataFrame, column: str):
    """A broadcast (bits, bit set) that holds every id of the column; false hits only cost time. Its size follows from the
    number of ids, up to a bound past which false hits grow."""
    bits = min(BLOOM_MOST, max(BLOOM_LEAST, (BLOOM_PER_ID * ids.count()).bit_length()))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, some = np.zeros(1 << (bits - 3), np.uint8), False
        for batch in batches:
            at = _bits(batch.column(0).drop_null().to_numpy(), bits)
            np.bitwise_or.at(held, at >> 3, (128 >> (at & 7)).astype(np.uint8))
            some |= len(at) > 0
        parts = [(i, zlib.compress(p.tobytes(), 1)) for i, p in enumerate(np.split(held, SKETCH_BLOCKS)) if some and p.any()]
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()] * len(parts), pa.int32()), pa.array([i for i, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())], names=["part", "block", "payload"])

    def join(part: pd.DataFrame) -> pd.DataFrame:
        both = np.bitwise_or.reduce([np.frombuffer(zlib.decompress(p), np.uint8) for p in part["payload"]])
        return pd.DataFrame({"block": [part["block"].iloc[0]], "payload": [zlib.compress(both.tobytes())]})

    shape = "block int, payload binary"
    filled = written(spark, ids.select(F.col(column).cast("long")).mapInArrow(fill, "part int, " + shape), "jaccard-bits")
    rows = _in_lanes(filled, join, shape).groupBy("block").applyInPandas(join, shape).collect()
    held = np.zeros((SKETCH_BLOCKS, (1 << bits) // 8 // SKETCH_BLOCKS), np.uint8)
    for r in rows:
        held[r["block"]] = np.frombuffer(zlib.decompress(r["payload"]), np.uint8)
    return spark.sparkContext.broadcast((bits, held.reshape(-1)))


def jaccard_components(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, words: int = WORDS, job_sets: int = JOB_SETS, list_sets: int = LIST_SETS, block_sets: int = BLOCK_SETS, boundary: int | None = None, count_links: bool = False) -> DataFrame:
    """Per row of documents: id_col, n_shingles, component_id; and n_links if links are to be counted.

    Two rows link when 100 * |intersection| >= percent * |union| of their sets of `words`-word shingles (words as runs
    of bytes outside space and \\t..\\r, A-Z folded). n_links counts the other rows a row links to, copies included.

    Defined cases: null, empty or blank text gives an empty set, no links, and the row's own id as component. Fewer than
    `words` words: the whole sequence is the one shingle. Repeated rows are rows that link. Rows with a null id take part
    and come out with a null id; a component of such rows alone has a null component_id. An empty table gives an empty
    table. Columns other than the two named are not read, so clashing names do not matter.
    """
    spark = documents.sparkSession
    session_for_texts(spark)
    shared_dir(spark)
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    profile = written(spark, docs.mapInArrow(_profile(words), "doc_id long, n long, sid long, part int, block int, payload binary"), "jaccard-profile")
    rows = profile.where("block is null").select("doc_id", "n", "sid")
    total = rows.agg(F.sum("n")).first()[0] or 0
    merged = _in_lanes(profile.where("block is not null").select("part", "block", "payload"), _added, "block int, payload binary").groupBy("block").applyInPandas(_levels(total / (1 << SKETCH_BITS)), "block int, payload binary, c1 double, c2 double, m long").collect()
    per_block = (1 << SKETCH_BITS) // SKETCH_BLOCKS
    held, c1, c2, m = {r["block"]: r["payload"] for r in merged}, sum(r["c1"] for r in merged), sum(r["c2"] for r in merged), sum(r["m"] for r in merged)
    levels = spark.sparkContext.broadcast([held.get(k) for k in range(SKETCH_BLOCKS)])

    def levels_of() -> np.ndarray:
        return np.concatenate([np.frombuffer(zlib.decompress(p), np.uint8) if p else np.zeros(per_block, np.uint8) for p in levels.value])

    if boundary is None:
        sizes = {r["s"]: r["c"] for r in rows.groupBy(F.least("n", F.lit(SMALL_MOST + 1)).alias("s")).agg(F.count("*").alias("c")).collect() if r["s"]}
        boundary = boundary_by_cost(sizes, max(0.0, (c2 - c1 * c1 / max(m, 1)) / max(c1, 1)), percent)
    posting_bytes = POSTING.itemsize * total * (100 - percent + 7) // 100
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), posting_bytes // BUCKET_BYTES + 1)
    packed = docs.select("text").mapInArrow(_postings(words, percent, levels_of, boundary, buckets), "bucket long, hot boolean, payload binary")
    scanned = written(spark, packed.groupBy("bucket", "hot").applyInArrow(_scan(list_sets), "heavy boolean, a long, b long, shared long, k long"), "jaccard-lists")

    near = scanned.where("not heavy").groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("k").alias("k")).where("shared >= k").select("a", "b")
    near = written(spark, near, "jaccard-candidates")
    posted = scanned.where("heavy").select(F.col("a").alias("sig"), F.col("b").alias("sid"))
    lists = posted.groupBy("sig").agg(F.min("sid").alias("centre"), F.count("*").alias("len"), F.bit_xor(F.xxhash64("sid")).alias("who")).where("len > 1")
    lists = written(spark, lists, "jaccard-heavy-lists")
    tied = posted.join(lists, "sig").where("sid <> centre").select(F.col("centre").alias("a"), F.col("sid").alias("b")).distinct()
    candidate = components(near.unionByName(tied), "a", "b").select(F.col("node").alias("sid"), F.col("component").alias("comp"))
    nodes = rows.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.count("*").alias("mult"))
    # near copies share many lists with the very same sets: one of them is enough
    distinct_lists = lists.groupBy("len", "who", "centre").agg(F.min("sig").alias("sig"))
    member = written(spark, candidate.join(nodes, "sid"), "jaccard-candidate-sets")
    blocks = lambda n: F.ceil(n / F.lit(block_sets)).cast("long")
    by_lists = distinct_lists.select(F.col("centre").alias("sid"), (F.col("len") * blocks(F.col("len"))).alias("cost")).unionByName(near.select(F.col("a").alias("sid"), F.lit(2).cast("long").alias("cost")))
    by_lists = by_lists.groupBy("sid").agg(F.sum("cost").alias("cost")).join(candidate, "sid").groupBy("comp").agg(F.sum("cost").alias("cost"))
    comps = member.groupBy("comp").agg(F.count("*").alias("sets"), F.sum("n").alias("elements")).join(by_lists, "comp", "left")
    way = F.when((F.col("sets") <= job_sets) & (F.col("elements") <= JOB_ELEMENTS), "whole").when(F.col("sets") * blocks(F.col("sets")) <= F.coalesce("cost", F.lit(0)), "tiles").otherwise("lists")
    # written, so that what joins it is two plain shuffles: the partition of a large component can then be split
    comps = written(spark, comps.select("comp", way.alias("way"), blocks(F.col("sets")).alias("nb")), "jaccard-components")
    member = written(spark, member.join(comps, "comp").select("sid", "rep", "mult", "comp", "way", "nb"), "jaccard-members")

    none = F.lit(0).cast("long")
    one = F.lit(1).cast("long")

    def dealt(df: DataFrame, kind: int, job: str) -> DataFrame:
        """Each set to the jobs of its block with every block, its own among them."""
        df = df.withColumn("block", F.pmod(F.xxhash64("sid"), F.col("nb"))).withColumn("other", F.explode(F.sequence(none, F.col("nb") - 1)))
        return df.select(F.lit(kind).alias("kind"), F.col(job).alias("job"), F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "sid", "mult")

    def shipped(jobs: DataFrame, some: DataFrame, name: str) -> DataFrame:
        """The jobs' links. A set is shipped once to each of its jobs, whichever of its copies come through."""
        bloom = bloom_of(spark, some, "rep")

        @F.pandas_udf("boolean")
        def wanted(ids: pd.Series) -> pd.Series:
            (bits, held), known = bloom.value, ids.notna().to_numpy()
            out = ~known
            at = _bits(ids[known].to_numpy(np.int64), bits)
            hit = (held[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
            out[known] = (hit[: known.sum()] & hit[known.sum() :]).astype(bool)
            return pd.Series(out)

        sets = docs.where(wanted("doc_id")).select("text").mapInArrow(_sets(words), "sid long, elements binary")
        found = jobs.join(sets, "sid").groupBy("kind", "job", "bi", "bj").applyInArrow(_compare(percent, count_links), "kind int, a long, b long")
        return written(spark, found, name)

    def in_one(df: DataFrame, block) -> DataFrame:
        return df.select(F.lit(0).alias("kind"), F.col("comp").alias("job"), block.alias("bi"), block.alias("bj"), block.alias("block"), "sid", "mult")

    whole = in_one(member.where("way = 'whole'"), none)
    large = member.where("way = 'tiles'")
    own = F.pmod(F.xxhash64("sid"), F.col("nb"))
    if count_links:
        tiles = dealt(large, 3, "comp")
    else:
        hub = F.row_number().over(Window.partitionBy("comp").orderBy(F.xxhash64("sid", F.lit(1)), "sid"))
        hubs = large.withColumn("nth", hub).where(F.col("nth") <= HUBS).withColumn("other", F.explode(F.sequence(none, F.col("nb") - 1)))
        tiles = in_one(large, own).unionByName(in_one(hubs, F.col("other")))
    apart = member.where("way = 'lists'").select("sid", "mult")
    firsts = near.join(apart.select(F.col("sid").alias("a")), "a")
    stars = firsts.select("a", F.col("a").alias("sid"), none.alias("block")).distinct().unionByName(firsts.select("a", F.col("b").alias("sid"), one.alias("block")))
    stars = stars.join(apart, "sid").select(F.lit(1).alias("kind"), F.col("a").alias("job"), none.alias("bi"), one.alias("bj"), "block", "sid", "mult")
    long = dealt(posted.join(apart, "sid").join(distinct_lists.select("sig", "len"), "sig").withColumn("nb", blocks(F.col("len"))), 2, "sig")
    found = shipped(whole.unionByName(tiles).unionByName(stars).unionByName(long), member, "jaccard-links")

    if not count_links and not large.isEmpty():
        # what is not in the largest part of its component yet
        part = components(found.where("kind = 0"), "a", "b").select(F.col("node").alias("sid"), F.col("component").alias("part"))
        parts = written(spark, large.join(part, "sid", "left").withColumn("part", F.coalesce("part", "sid")), "jaccard-parts")
        main = parts.groupBy("comp", "part").agg(F.count("*").alias("n")).groupBy("comp").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("n"))
        main = written(spark, main.where(F.col("n") < F.col("all")).select("comp", "main", blocks(F.col("all") - F.col("n")).alias("nr")), "jaccard-largest-parts")
        parts = written(spark, parts.join(main, "comp"), "jaccard-open-parts")
        rest, most = parts.where(F.col("part") != F.col("main")), parts.where(F.col("part") == F.col("main"))
        if not rest.isEmpty():
            spot = F.pmod(F.xxhash64("sid"), F.col("nr"))
            job = lambda df, bi, bj, block: df.select(F.lit(3).alias("kind"), F.col("comp").alias("job"), bi.alias("bi"), bj.alias("bj"), block.alias("block"), "sid", "mult")
            of_rest = rest.withColumn("block", spot).withColumn("other", F.explode(F.sequence(F.col("nr"), F.col("nr") + F.col("nb") - 1)))
            of_most = most.withColumn("block", F.col("nr") + own).withColumn("other", F.explode(F.sequence(none, F.col("nr") - 1)))
            across = job(of_rest, F.col("block"), F.col("other"), F.col("block")).unionByName(job(of_most, F.col("other"), F.col("block"), F.col("block")))
            within = dealt(rest.withColumn("nb", F.col("nr")), 3, "comp")
            found = found.unionByName(shipped(across.unionByName(within), parts, "jaccard-rest-links"))

    linked = components(found.where("kind = 0"), "a", "b").select(F.col("node").alias("sid"), F.col("component").alias("comp"))
    classes = written(spark, nodes.join(linked, "sid", "left").withColumn("comp", F.coalesce("comp", "sid")).select("sid", "comp", "rep", "mult"), "jaccard-sets")
    least = written(spark, classes.groupBy("comp").agg(F.min("rep").alias("component_id")), "jaccard-classes")
    classes = classes.join(least, "comp").select("sid", "component_id", (F.col("mult") - 1).alias("copies"))
    out = rows.join(classes, "sid", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    if count_links:
        mult = member.select("sid", "mult")
        pairs = found.where("kind = 2").select("a", "b").distinct()
        pairs = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(mult.withColumnRenamed("sid", "b"), "b").select(F.col("a").alias("sid"), F.col("mult").alias("links"))
        links = found.where("kind = 1").select(F.col("a").alias("sid"), F.col("b").alias("links")).unionByName(pairs).groupBy("sid").agg(F.sum("links").alias("links"))
        out = out.join(links, "sid", "left").withColumn("n_links", F.when(F.col("n") > 0, F.coalesce("links", F.lit(0)) + F.col("copies")).otherwise(none))
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", *(["n_links"] if count_links else []))
