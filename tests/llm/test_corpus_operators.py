"""Whitening, importance resampling and web archives against plain versions, and on their defined corner cases."""

import base64
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.llm import resampling, rows, warc, whitening
from corvane.llm.cluster import scratch
from corvane.llm.queries import op11_embedding_whitening

SF = "/root/testdata/sf0.01"
CLASHING = ("n", "id", "v", "x", "x0", "d0", "component", "score", "fit", "bucket", "words", "rank", "payload", "sha1", "first", "revisit", "r", "bytes")


def clashing(df):
    for c in CLASHING:
        df = df.withColumn(c, F.lit("x"))
    return df


def vectors(spark, values, ids=None):
    ids = list(range(len(values))) if ids is None else ids
    return clashing(spark.createDataFrame(list(zip(ids, values, strict=True)), "vec_id long, embedding array<double>"))


# ---- whitening


def plain_whitening(vecs):
    x = np.floor(1024 * np.array(vecs, float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    c = x - s / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1], axes[:, ::-1]
    return ((n * x - s) ** 2).sum(1), c @ axes / np.sqrt(np.maximum(values, 1e-300)), values / values.sum()


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(1)
    vecs = (rng.normal(size=(300, 12)) * np.linspace(0.2, 3, 12)).tolist()
    found = whitening.whitened(vectors(spark, vecs), 8).toPandas()
    deviation, white, explained = plain_whitening(vecs)
    assert len(found) == 300 * 8 and set(found.n) == {300}
    for r in found.itertuples():
        assert r.deviation == deviation[r.vec_id]
        assert abs(abs(r.whitened) - abs(white[r.vec_id, r.component - 1])) < 1e-9
        assert abs(r.explained - explained[r.component - 1]) < 1e-12
    assert set(found.identity_error) == {found.identity_error[0]} and found.identity_error[0] < 1e-9


def test_whitening_query_is_the_identity(spark):
    found = op11_embedding_whitening(spark, SF)
    wide = found.groupBy("vec_id").pivot("component").agg(F.first("whitened")).toPandas().set_index("vec_id").to_numpy()
    assert np.abs(np.cov(wide.T, bias=True) - np.eye(8)).max() < 1e-4


def test_whitening_of_more_pairs_than_one_aggregation_holds(spark, monkeypatch):
    rng = np.random.default_rng(2)
    df = vectors(spark, rng.normal(size=(50, 9)).tolist())
    whole = sorted(map(tuple, whitening.whitened(df).collect()))
    monkeypatch.setattr(whitening, "PAIRS", 7)
    parts = sorted(map(tuple, whitening.whitened(df).collect()))
    assert all(abs(a - b) < 1e-9 for x, y in zip(whole, parts, strict=True) for a, b in zip(x, y, strict=True))


def test_whitening_corners(spark):
    inf, nan = math.inf, math.nan
    bad = [None, [], [1.0, None], [nan, 1.0], [inf, 1.0], [1e300, 1.0]]
    good = [[1.0, 2.0], [1.0, 2.0], [3.0, 1.0], [0.0, 0.5], [7.0]]
    found = whitening.whitened(vectors(spark, bad + good, [*range(6), 10, 10, None, 11, 12]), 8).collect()
    assert Counter(r.vec_id for r in found) == {10: 4, None: 2, 11: 2, 12: 1}  # repeated rows stay, no more components than dimensions
    alone = next(r for r in found if r.vec_id == 12)  # another width is fitted apart; one vector does not vary
    assert (alone.n, alone.deviation, alone.whitened, alone.explained, alone.identity_error) == (1, 0, None, None, None)
    assert {r.n for r in found if r.vec_id != 12} == {4}
    line = whitening.whitened(vectors(spark, [[float(k), 2.0 * k, 0.0] for k in range(5)]), 8).collect()
    assert {r.component for r in line if r.whitened is not None} == {1}
    assert whitening.whitened(vectors(spark, []).limit(0)).collect() == []
    huge = whitening.whitened(vectors(spark, [[1e9 * k] for k in range(4)])).collect()
    assert {r.deviation for r in huge} == {None} and all(r.whitened is not None for r in huge)


# ---- importance resampling


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_runs(text, longest, buckets):
    w = plain_words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def plain_resampled(docs, target, longest, buckets, seed, min_words, percent):
    s, t = (Counter(b for x in texts for b in plain_runs(x, longest, buckets)) for texts in ([x for _, x in docs], target))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets))))
    out, fit = [], []
    for k, (i, x) in enumerate(docs):
        found = plain_runs(x, longest, buckets)
        weight = math.floor(sum(map(gain, found)) / len(found)) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
        if len(plain_words(x)) >= min_words:
            fit.append(k)
    order = sorted(fit, key=lambda k: (-out[k][3], out[k][0] is None, out[k][0] or 0, out[k][1], out[k][2]))
    for rank, k in enumerate(order[: len(fit) * percent // 100], 1):
        out[k][4] = rank
    return out


TEXTS = [None, "", "  ", "Word", "one TWO three", "é ü 你好 x1\x00y2", "a-b_c d", "w" * 70_000 + " z", "long text " * 5000]


def test_checksums_of_runs_equal_those_of_strings():
    rnd = random.Random(3)
    texts = TEXTS + ["".join(rnd.choice("aB1 é.\n你") for _ in range(rnd.randint(0, 80))) for _ in range(300)]
    whole = pa.array(["skipped", *texts]).fill_null("")
    for longest in (1, 2, 3, 6):
        words, row, bucket = resampling.features(whole.slice(1), longest, 10_000)
        assert words.tolist() == [len(plain_words(t)) for t in texts]
        assert Counter(zip(row.tolist(), bucket.tolist(), strict=True)) == Counter((k, b) for k, t in enumerate(texts) for b in plain_runs(t, longest, 10_000))


def test_a_shift_by_any_length_is_a_checksum_of_zeros():
    lengths = np.array([0, 1, 2, 3, 255, 4096, 1_000_003])
    tail = [bytes(n) for n in lengths]
    got = resampling.shifted(np.full(len(lengths), zlib.crc32(b"start"), np.uint32), lengths) ^ np.array([zlib.crc32(x) for x in tail], np.uint32)
    assert got.tolist() == [zlib.crc32(b"start" + x) for x in tail]


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_equals_the_plain_version(spark, longest, monkeypatch):
    monkeypatch.setattr(rows, "UNROLL", 3)
    rnd = random.Random(longest)
    texts = TEXTS + [" ".join(rnd.choice("alpha beta gamma delta eps".split()) for _ in range(rnd.randint(0, 30))) for _ in range(150)]
    docs = list(enumerate(texts)) + [(7000, "same words here again")] * 11 + [(None, "no id has this one")] * 9
    target = ["alpha beta", "beta gamma alpha", None, ""]
    df = clashing(spark.createDataFrame(docs, "doc_id long, text string"))
    aim = clashing(spark.createDataFrame([(t,) for t in target], "text string"))
    got = resampling.resampled(df, aim, longest=longest, buckets=500, min_words=4, percent=50).collect()
    want = plain_resampled(docs, target, longest, 500, 2024, 4, 50)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


def test_resampling_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    assert resampling.resampled(docs.limit(0), docs).collect() == []
    (row,) = resampling.resampled(docs, docs.limit(0), min_words=1, percent=100).collect()
    assert (row.n_features, row.rank) == (2, 1)


# ---- web archives


def test_chunk_framing_round_trip():
    rnd = random.Random(5)
    for _ in range(200):
        payload = b"".join(rnd.choice([b"a", b"\r\n", b"WARC/1.1\r\n", b"0\r\n\r\n", b"\xff", b"WARC/1."]) for _ in range(rnd.randint(0, 40)))
        framed = warc.chunked(payload, rnd.choice([1, 3, 7, 4096]))
        assert warc.dechunked(framed) == payload and b"WARC/1.1" not in framed
    assert warc.dechunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for broken in (b"", b"5\r\nabc\r\n0\r\n\r\n", b"zz\r\n", b"3\r\nabcd\r\n0\r\n\r\n", b"3\r\nabc\r\n"):
        assert warc.dechunked(broken) is None


def pages(spark, rows_):
    return clashing(spark.createDataFrame([(i, u, h) for i, u, h in rows_], "page_id long, url string, html string"))


HTML = ["", None, "<p>short</p>", "x" * 50_000, "WARC/1.1\r\n" * 3000, "é你\r\n\r\n0\r\n\r\n" * 900, "tail WARC/1.1", "same", "same", "same"]


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_archives_round_trip(spark, compression):
    table = pages(spark, [(i, f"http://h/{i}\r\nWARC/1.1\r\n" if i % 2 else None, h) for i, h in enumerate(HTML)])
    path = scratch(spark, "archive")
    warc.write_warc(table, path, segment_bytes=4000, chunk_bytes=700, compression=compression)
    kinds = Counter(r.type for r in warc.read_records(spark, path).collect())
    assert kinds["response"] == 7 and kinds["revisit"] == 3 and kinds["continuation"] > 20
    found = {r.page_id: r for r in warc.read_warc(spark, path).collect()}
    assert len(found) == len(HTML) and {r.damage for r in found.values()} == {None}
    for i, h in enumerate(HTML):
        assert found[i].type == ("revisit" if i in (1, 8, 9) else "response")
        if found[i].type == "response":
            assert bytes(found[i].payload).decode() == (h or "")
    by_id = {r.page_id: r for r in warc.resolved(warc.read_warc(spark, path, False)).collect()}
    for i, h in enumerate(HTML):
        raw = (h or "").encode()
        assert (by_id[i].payload_bytes, by_id[i].payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert by_id[i].refers_to == {1: 0, 8: 7, 9: 7}.get(i)


def test_small_payloads_are_no_revisits(spark):
    path = scratch(spark, "archive")
    warc.write_warc(pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]), path, least_bytes=3)
    assert {r.page_id: r.record_type for r in warc.resolved(warc.read_warc(spark, path)).collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_repeated_rows_null_ids_and_empty_tables(spark):
    path = scratch(spark, "archive")
    big = "long page " * 3000
    warc.write_warc(pages(spark, [(5, "u", big)] * 4 + [(6, "u", big), (None, "u", big), (None, None, "alone"), (None, None, "alone")]), path, segment_bytes=5000)
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.resolved(warc.read_warc(spark, path, False)).collect())
    assert got == {(5, 30_000, "response", None): 4, (6, 30_000, "revisit", 5): 1, (None, 30_000, "revisit", 5): 1, (None, 5, "response", None): 2}
    path = scratch(spark, "archive")
    warc.write_warc(pages(spark, [(1, "u", "x")]).limit(0), path)
    assert warc.resolved(warc.read_warc(spark, path)).collect() == []


def foreign(tmp_path, records, compressed=False):
    whole = b"".join(r + b"\r\n\r\n" for r in records)
    (tmp_path / ("a.warc.gz" if compressed else "a.warc")).write_bytes(gzip.compress(whole) if compressed else whole)
    return f"file://{tmp_path}"


@pytest.mark.parametrize("compressed", [False, True])
def test_scattered_and_damaged_segments(spark, tmp_path, compressed):
    digest = warc.base32_sha1
    made = {i: list(warc.page_records(i, "u", f"page {i} ".encode() * 500, digest(f"page {i} ".encode() * 500), None, False, 900, 300)) for i in range(1, 7)}
    made[2][1:] = reversed(made[2][1:])  # out of order
    del made[3][2]  # one is missing
    made[4][1] = made[4][1][:-5]  # one is cut short
    del made[5][0]  # the first one is missing
    made[6].append(made[6][2])  # one came twice
    records = [r for group in made.values() for r in group]
    random.Random(1).shuffle(records)
    found = warc.read_warc(spark, foreign(tmp_path, records, compressed)).collect()
    state = {r.page_id: (r.type, r.damage, None if r.payload is None else bytes(r.payload)) for r in found}
    assert {i: state[i] for i in (1, 2, 6)} == {i: ("response", None, f"page {i} ".encode() * 500) for i in (1, 2, 6)}
    assert state[3] == state[4] == ("response", "segments", None)
    assert [(r.type, r.damage) for r in found if r.page_id is None] == [("continuation", "segments")] and len(found) == 6


def test_records_of_other_writers(spark, tmp_path):
    plain = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Length: 46\r\n\r\nHTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\nab"
    broken = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <b>\r\n\r\nno length"
    wrong = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <c>\r\nWARC-Payload-Digest: sha1:AAAA\r\nContent-Length: 21\r\n\r\nHTTP/1.1 200 OK\r\n\r\nab"
    found = {r.record_id: r for r in warc.read_warc(spark, foreign(tmp_path, [plain, broken, wrong])).collect()}
    assert bytes(found["<a>"].payload) == b"ab" and found["<a>"].damage is None
    assert found["<b>"].damage == "head" and found["<c>"].damage == "digest"


# ---- shared helpers


def test_fresh_names_ignore_case(spark):
    from corvane.llm.quality import with_quality
    from corvane.llm.toxicity import with_toxicity

    docs = spark.createDataFrame([(1, "good text", "a", "b"), (2, "bad text", "c", "d")], "doc_id long, text string, Toxicity string, QUALITY string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    for scored, name in ((with_toxicity(docs, labels), "toxicity_"), (with_quality(docs, labels), "quality_")):
        assert scored.columns == [*docs.columns, name]
        assert sorted((r.Toxicity, r.QUALITY) for r in scored.collect()) == [("a", "b"), ("c", "d")]


def test_unrolled_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(rows, "UNROLL", 4)
    df = spark.createDataFrame([("a", 9), ("b", 0), ("c", 4), ("d", 1)], "k string, n long")
    assert sorted(map(tuple, rows.unrolled(df, "n", "at").select("k", "at").collect())) == [("a", i) for i in range(9)] + [("c", i) for i in range(4)] + [("d", 0)]


def test_rows_without_an_id_are_spread_over_windows(spark):
    from corvane.llm.sharding import sharded

    docs = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    out = sharded(docs, 4, bucket_rows=100)
    assert out.count() == 20_000 and {(r.lo, r.hi == r.n - 1) for r in out.groupBy("shard").agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.count_distinct("slot").alias("n")).collect()} == {(0, True)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(shard" in plan and "bucket" in plan
    row = F.coalesce("doc_id", F.lit(0).cast("long")).bitwiseXOR(F.shiftleft("text_crc32", 21)).bitwiseXOR(F.col("size"))
    from corvane.llm.sharding import _advance, _halves

    largest = out.groupBy("shard", (_advance(*_halves(row))[0] % 50).alias("b")).count().agg(F.max("count")).first()[0]
    assert largest < 600  # half of all rows lie in one shard, in 50 windows of it
