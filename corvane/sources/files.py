"""Readers and writers with declared schemas, and the scratch folder they may use."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANKED_SCHEMA = "channel string, query_id long, doc_id long, score double, rank long"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder named by spark.checkpoint.dir, which all executors share. Where it is unset a temporary
    one is set, in local mode only: on a cluster each executor would write to a disk of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^,]*(,\d+)?\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corvane-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/corvane-scratch/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def fingerprint(df: DataFrame) -> int:
    """What a table read from files is known by: its plan, and the names, sizes and times of its files."""
    spark = df.sparkSession
    seen = []
    for name in sorted(df.inputFiles()):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
        seen.append((name, status.getLen(), status.getModificationTime()))
    return hash((df.semanticHash(), tuple(seen)))


_STORED: dict[tuple, object] = {}


def stored(df: DataFrame, kind: str, build: Callable[[], object]) -> object:
    """What `build` makes of a table read from files, made when first asked for in an application. A table whose files have
    changed since gets a new one. It lives as long as the application's scratch folder."""
    key = (df.sparkSession.sparkContext.applicationId, kind, fingerprint(df))
    if key not in _STORED:
        _STORED[key] = build()
    return _STORED[key]


def sweep(spark: SparkSession) -> None:
    """Delete all that this application has written to the scratch folder. Results not yet written elsewhere are lost."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch(spark, "x")).getParent()
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    _STORED.clear()


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, escape='"')


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, escape='"', multiLine=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path, ignoreNullFields=False)


def read_json(spark: SparkSession, path: str, schema: str, records: bool = False) -> DataFrame:
    """JSON lines, or (records) files that hold one array of records."""
    return spark.read.json(path, schema=schema, multiLine=records)


def flattened_results(df: DataFrame) -> DataFrame:
    """{query_id, query, results: [{doc_id, rank, similarity_score}]} to one row for each result."""
    return df.select("query_id", "query", F.inline("results"))


def nested_results(ranked: DataFrame) -> DataFrame:
    """The reverse: one row for each query, results in rank order."""
    item = F.struct("rank", "doc_id", "score")
    return ranked.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("results"))


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def cached(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Keep an intermediate result as Parquet in the shared folder; the committer makes it whole or absent."""
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lookup(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key is listed."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def profile(df: DataFrame) -> DataFrame:
    """For each column its type, nulls, null rate and distinct values, in one pass over the table."""
    types = dict(df.dtypes)
    row = df.agg(F.count("*").alias("n"), *[F.count(c).alias(f"c_{c}") for c in types], *[F.count_distinct(c).alias(f"d_{c}") for c in types])
    each = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), (F.col("n") - F.col(f"c_{c}")).alias("nulls"), F.round(F.try_divide(F.col("n") - F.col(f"c_{c}"), "n"), 6).alias("null_rate"), F.col(f"d_{c}").alias("distinct_values")) for c, t in types.items()]
    return row.select(F.inline(F.array(*each)))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts and shares of a column's values. The total is one row."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("_all")))).select(column, "n", F.round(F.col("n") / F.col("_all"), 6).alias("share"))
