"""Joins with a meaning of their own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lists of a facet's value are split into so many lanes by document.
LANES = 16


def facet_lists(docs: DataFrame, doc_key: str, facets: Sequence[str]) -> DataFrame:
    """The inverted lists of a corpus: facet, value, lane, doc; a row for each document and facet. A value that a third of
    the corpus has is LANES keys, none of which gathers its list. Nulls are in no list."""
    each = F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets])
    lane = F.pmod(F.xxhash64(doc_key), F.lit(LANES)).cast("int")
    return docs.select(F.col(doc_key).alias("doc"), lane.alias("lane"), F.inline(each)).where("value is not null")


def prefilter(lists: DataFrame, asked: DataFrame, least: int = 100) -> tuple[DataFrame, DataFrame]:
    """The documents that meet all of a query's conditions (query, facet, value); and the queries with how many they are
    and whether that is fewer than `least`, so that they fall back to the whole corpus.

    Conditions meet lists by an equality join on facet, value and lane; the documents of all of a query's lists are those
    counted as often as it has conditions. The corpus is never paired with the queries, and the fallback is a flag: who
    searches takes the whole corpus for such a query, as it lies. Several values of a facet in one query are alternatives.
    Null values of a condition are met by nothing.
    """
    conditions = asked.select("query", "facet", F.col("value").cast("string").alias("value")).distinct()
    wanted = conditions.groupBy("query").agg(F.count_distinct("facet").alias("conditions"))
    spread = conditions.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(LANES - 1))))
    met = lists.join(spread, ["facet", "value", "lane"]).groupBy("query", "doc").agg(F.count_distinct("facet").alias("met"))
    hits = met.join(wanted, "query").where("met = conditions").select("query", "doc")
    counts = wanted.join(hits.groupBy("query").agg(F.count("*").alias("n")), "query", "left").select("query", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    return hits, counts.withColumn("falls_back", F.col("n") < least)


def compared(a: DataFrame, b: DataFrame, group: str, key: str) -> DataFrame:
    """Per group how many keys both lists have, and each alone."""
    x = a.select(group, key, F.lit(1).alias("_a"))
    y = b.select(group, key, F.lit(1).alias("_b"))
    both = x.join(y, [group, key], "full_outer")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    in_a, in_b = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    return both.groupBy(group).agg(count(in_a & in_b).alias("both"), count(in_a & ~in_b).alias("left_only"), count(~in_a & in_b).alias("right_only"))


def by_reviewer(labels: DataFrame, keys: Sequence[str], reviewer: str, label: str, reviewers: Sequence[str]) -> DataFrame:
    """One column for each reviewer; rows that any of them left open are dropped."""
    wide = labels.groupBy(*keys).pivot(reviewer, list(reviewers)).agg(F.first(label, ignorenulls=True))
    return wide.na.drop(subset=list(reviewers))
