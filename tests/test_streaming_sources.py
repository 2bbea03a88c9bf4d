"""Streams run to their end give what tables give; the paged source dedupes, stops and retries."""

import json

import pytest
from pyspark.sql import functions as F

from corvane.sources import files, paged
from corvane.streaming import ingest


def test_stream_dedup_over_files(spark, tmp_path):
    path = f"file://{tmp_path}/in"
    rows = spark.range(50).select(F.col("id"), F.timestamp_seconds(F.col("id") * 60 + 1_700_000_000).alias("ts"))
    rows.unionByName(rows.where("id < 20")).write.parquet(path)
    out = ingest.replay(spark, path, lambda s: ingest.deduplicated(s, "id", "ts", "10 days"), "t")
    assert sorted(r.id for r in out.collect()) == list(range(50))


def test_upsert_keeps_the_latest_and_may_run_twice(spark, tmp_path):
    target = f"file://{tmp_path}/table"
    put = ingest.upsert(target, "k", "v")
    one = spark.createDataFrame([(1, 1), (2, 5)], "k int, v int")
    two = spark.createDataFrame([(1, 3), (2, 4), (3, 0)], "k int, v int")
    put(one, 0)
    put(two, 1)
    put(two, 1)
    assert sorted(tuple(r) for r in spark.read.parquet(f"{target}/v1").collect()) == [(1, 3), (2, 5), (3, 0)]


def test_windows_and_sessions(spark):
    df = spark.createDataFrame([(0, "a", 1.0), (50, "a", 2.0), (70, "a", 4.0), (500, "b", 1.0)], "s long, user string, value double").withColumn("ts", F.timestamp_seconds("s"))
    out = {(r.window_start.timestamp(), r.user): (r.n, r.total) for r in ingest.windowed(df, "ts", "1 minute", "user", "value").collect()}
    assert sorted(out.values()) == [(1, 1.0), (1, 4.0), (2, 3.0)]
    assert sorted(r.n for r in ingest.sessions(df, "ts", "user", "60 seconds").collect()) == [1, 3]


def test_paged_source(spark, tmp_path):
    rows = {"q": [{"doc_id": i % 30, "score": float(i)} for i in range(90)], "none": []}
    path = tmp_path / "pages.json"
    path.write_text(json.dumps(rows))
    spark.dataSource.register(paged.PagedSearch)
    read = spark.read.format("paged_search").options(queries=json.dumps(list(rows)), fetch="corvane.sources.paged:json_pages", file=str(path), size="20", target="25")
    out = sorted(read.load().collect(), key=lambda r: r["rank"])
    assert [r.doc_id for r in out] == list(range(25)) and [r["rank"] for r in out] == list(range(1, 26))


def test_retries_but_not_on_a_spent_quota():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert paged.with_retries(flaky, wait=0) == "ok"

    def spent():
        calls.append(1)
        raise paged.Quota

    calls.clear()
    with pytest.raises(paged.Quota):
        paged.with_retries(spent, wait=0)
    assert len(calls) == 1


def test_nested_json_round_trip(spark, tmp_path):
    flat = spark.createDataFrame([(1, 10, 0.5, 1), (1, 11, 0.4, 2), (2, 10, 0.1, 1)], "query_id long, doc_id long, score double, rank long")
    path = f"file://{tmp_path}/nested"
    files.write_json(files.nested_results(flat).withColumn("query", F.lit("q")), path)
    back = files.flattened_results(files.read_json(spark, path, "query_id long, query string, results array<struct<rank: long, doc_id: long, score: double>>"))
    assert sorted(tuple(r) for r in back.select("query_id", "doc_id", "score", "rank").collect()) == sorted(tuple(r) for r in flat.collect())


def test_csv_keeps_quotes_and_lines(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c\nd'), (2, None)], "id long, t string")
    path = f"file://{tmp_path}/csv"
    files.write_csv(df, path)
    assert sorted((r.id, r.t) for r in files.read_csv(spark, path, "id long, t string").collect()) == [(1, 'a "b", c\nd'), (2, None)]


def test_profile(spark):
    out = {r.column: r for r in files.profile(spark.createDataFrame([(1, None), (1, "x")], "a long, b string")).collect()}
    assert (out["a"].nulls, out["a"].distinct_values, out["b"].nulls, out["b"].null_rate) == (0, 1, 1, 0.5)


def matrix_rows(n=1000):
    return [(i, i % 100, float(i) / 3, [float(i), float(-i), 0.5]) for i in range(n)]


def test_matrix_round_trip(spark, tmp_path):
    import numpy as np

    from corvane.sources import matrix as M

    path = f"file://{tmp_path}/m"
    M.write_matrix(spark.createDataFrame(matrix_rows(), "id long, band int, x double, v array<float>").repartition(3), path)
    assert sorted(tuple(r) for r in M.read_matrix(spark, path, rows=70).collect()) == matrix_rows()
    some = M.read_matrix(spark, path, ["v", "id"], {"band": (20, 23), "id": (None, 500)}, rows=150)
    assert some.columns == ["v", "id"]
    assert sorted((r.id, r.v) for r in some.collect()) == [(i, v) for i, b, _, v in matrix_rows() if 20 <= b < 23 and i < 500]
    # other programs can map the files
    parts = M.manifest(path)["parts"]
    mapped = np.concatenate([np.load(f"{tmp_path}/m/{p['name']}.v.npy", mmap_mode="r") for p in parts])
    assert sorted(mapped[:, 0].tolist()) == [float(i) for i in range(1000)]
    assert M.read_matrix(spark, path, ["id"], {"id": (5000, None)}).count() == 0


def test_masked_matrix_read_opens_only_its_ranges(spark, tmp_path, monkeypatch):
    from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

    from corvane.sources import matrix as M

    path, wide = f"file://{tmp_path}/m", [(i, i // 100, [float(i)] * 4096) for i in range(400)]
    M.write_matrix(spark.createDataFrame(wide, "id long, band int, v array<float>").coalesce(1), path)
    read = []
    plain = M._Reader._read
    monkeypatch.setattr(M._Reader, "_read", lambda self, store, root, part, column, rows: read.append((column, rows)) or plain(self, store, root, part, column, rows))
    reader = M._Reader(path, StructType([StructField("v", ArrayType(FloatType()))]), {"id": (250, 253)}, 100)
    got = [v[0] for p in reader.partitions() for b in reader.read(p) for v in b.column(0).to_pylist()]
    assert got == [250.0, 251.0, 252.0]
    assert [(c, rows) for c, rows in read if c == "v"] == [("v", [(250, 253)])]
    assert all(c in ("v", "id") for c, _ in read)
    assert reader.partitions()[0].part["rows"] == 400 and M._Reader(path, reader.schema, {"id": (400, None)}, 100).partitions()[0].part == {}


def test_runs_join_over_short_gaps():
    import numpy as np

    from corvane.sources.matrix import runs

    assert runs(np.array([0, 1, 4, 9]), 0) == [(0, 2), (4, 5), (9, 10)]
    assert runs(np.array([0, 1, 4, 9]), 2) == [(0, 5), (9, 10)] and runs(np.zeros(0, int), 3) == []


def test_matrix_refuses_what_it_cannot_hold(spark, tmp_path):
    from corvane.sources import matrix as M

    with pytest.raises(ValueError):
        M._dtype("string")
    for k, rows in enumerate(([(1, None)], [(1, [1.0]), (2, [1.0, 2.0])])):
        with pytest.raises(Exception, match="matrix"):
            M.write_matrix(spark.createDataFrame(rows, "id long, v array<float>").coalesce(1), f"file://{tmp_path}/bad{k}")
    M.write_matrix(spark.createDataFrame([], "id long, v array<float>"), path := f"file://{tmp_path}/none")
    assert M.read_matrix(spark, path).count() == 0
