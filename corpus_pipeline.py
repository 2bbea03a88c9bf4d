"""From raw documents to packed training sequences: STAGES in order, each written as Parquet and read by the next.

SQL cannot express the learned stages, so ORACLE_SQL is None and the tests hold each stage against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.cluster import written
from corvane.llm.jaccard import jaccard_components
from corvane.llm.packing import packed
from corvane.llm.pii import with_pii_redacted
from corvane.llm.quality import quality
from corvane.llm.queries import GOOD_FROM, TOXIC_FROM, table
from corvane.llm.toxicity import toxicity


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Rows are judged by their text alone, so repeated rows stay or go together and ids may be null. Null and empty texts
    are judged as an empty text. An empty table gives an empty table. Columns pass through, whatever their names.
    """
    score = quality(docs, table(spark, sf_dir, "labels"))
    return docs.where(score(F.col("text")) >= GOOD_FROM)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not flag. Corner cases as in keep_good."""
    score = toxicity(docs, table(spark, sf_dir, "labels"))
    return docs.where(score(F.col("text")) < TOXIC_FROM)


def _fresh(name: str, columns: list[str]) -> str:
    """A column name that is not taken."""
    while name.lower() in (c.lower() for c in columns):
        name += "_"
    return name


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked rows one: that with the smallest id, rows without an id last, ties by a hash of the row.

    Rows are told apart by a key of their own, so repeated rows, rows without an id and ids with several texts are right.
    Null, empty and blank texts link with nothing and stay. An empty table gives an empty table. Columns pass through,
    whatever their names.
    """
    key = _fresh("row_key", docs.columns)
    keyed = written(spark, docs.withColumn(key, F.monotonically_increasing_id()), "stage-row-keys")
    linked = jaccard_components(keyed, key).select(F.col(key).alias("row_key"), "component_id")
    linked = written(spark, linked, "stage-classes")
    # written, so that what joins it is two plain shuffles: the partition of a large class can then be split
    several = written(spark, linked.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select("component_id"), "stage-large-classes")
    linked = written(spark, linked.join(several, "component_id"), "stage-linked-rows")
    named = linked.join(keyed.select(F.col(key).alias("row_key"), F.col("doc_id").alias("id"), F.xxhash64(*docs.columns).alias("h")), "row_key")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "h", "row_key")).alias("first")).select("first.row_key")
    others = linked.select("row_key").join(first, "row_key", "left_anti").withColumnRenamed("row_key", key)
    return keyed.join(others, key, "left_anti").select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data replaced by the kind's name; n_chars follows the text.

    Null texts stay null (n_chars null), empty ones empty. Rows are independent, so repeated rows and null ids need no
    rule. An empty table gives an empty table. Columns pass through, whatever their names.
    """
    clean = with_pii_redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in which training sequence. Corner cases as in packed()."""
    return packed(docs)


STAGES = [
    ("quality_classifier", keep_good),
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("best_fit_packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents; every stage but the last is written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(spark, docs, f"stage-{name}")
    return docs
