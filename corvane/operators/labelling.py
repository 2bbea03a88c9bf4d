"""Pools, judge agreement, label merging, uncertainty queues and review exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T


def pool(ranked: DataFrame, docs: DataFrame, depth: int = 20, text: str = "text") -> DataFrame:
    """First `depth` of each source, each document once with its sources; documents without a text are left out."""
    once = ranked.where(F.col("rank") <= depth).groupBy("query_id", "doc_id").agg(F.array_sort(F.collect_set("channel")).alias("sources"))
    have = docs.where(T.filled(F.col(text)).isNotNull()).select("doc_id")
    return once.join(have, "doc_id").select("query_id", "doc_id", F.array_join("sources", ",").alias("sources"), F.size("sources").cast("long").alias("n_sources"))


def agreed(judged: DataFrame, keys: Sequence[str] = ("query_id", "doc_id"), least: int = 2) -> DataFrame:
    """From (keys, judge, label): the label where at least `least` judges gave one and all the same; else status review."""
    out = judged.groupBy(*keys).agg(F.count("label").alias("n_labels"), F.count_distinct("label").alias("n_values"), F.min("label").alias("label"))
    gold = (F.col("n_labels") >= least) & (F.col("n_values") == 1)
    return out.select(*keys, "n_labels", F.when(gold, F.col("label")).alias("gold_label"), F.when(gold, "gold").otherwise("review").alias("status"))


def merged_labels(gold: DataFrame, decisions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Agreed labels and human decisions (decision: a label or SKIP), with their source; an agreed label stands."""
    human = decisions.where("decision <> 'SKIP'").select(*keys, F.col("decision").try_cast("long").alias("gold_label"), F.lit("human").alias("source"))
    both = gold.where("status = 'gold'").select(*keys, F.col("gold_label").cast("long").alias("gold_label"), F.lit("judges").alias("source"))
    return both.unionByName(human.join(both, list(keys), "left_anti"))


def kept_reviews(queue: DataFrame, earlier: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """A fresh review queue that keeps what was filled in before."""
    return queue.join(earlier.select(*keys, F.col(column).alias("_old")), list(keys), "left").withColumn(column, F.coalesce("_old", column)).drop("_old")


def silver(df: DataFrame, gold: DataFrame, keys: Sequence[str], probability: str = "p") -> DataFrame:
    """Model labels at 0.5, tier gold where a person or the judges labelled the pair."""
    marks = gold.select(*keys).distinct().withColumn("_g", F.lit(True))
    return df.join(marks, list(keys), "left").select(*keys, probability, (F.col(probability) >= 0.5).cast("long").alias("silver_label"), F.when(F.col("_g"), "gold").otherwise("silver").alias("tier"))


def gold_first(df: DataFrame, k: int, probability: str = "p") -> DataFrame:
    w = Window.partitionBy("query_id").orderBy((F.col("tier") == "gold").desc(), F.desc(probability), "doc_id")
    return df.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def uncertain(df: DataFrame, labelled: DataFrame, n: int, keys: Sequence[str] = ("query_id", "doc_id"), probability: str = "p") -> DataFrame:
    """The n least certain unlabelled rows of each query."""
    open_rows = df.join(labelled.select(*keys).distinct(), list(keys), "left_anti").withColumn("doubt", F.round(F.abs(F.col(probability) - 0.5), 9))
    w = Window.partitionBy(keys[0]).orderBy("doubt", *keys[1:])
    return open_rows.withColumn("n", F.row_number().over(w).cast("long")).where(F.col("n") <= n)


def round_history(rounds: DataFrame, value: str, stop_below: float = 0.03) -> DataFrame:
    """Change from round to round, and whether it is small enough to stop. Rounds are few."""
    w = Window.partitionBy(F.lit(0)).orderBy("round")
    delta = F.round(F.col(value) - F.lag(value).over(w), 6)
    return rounds.withColumn("delta", delta).withColumn("stop", F.coalesce(F.abs("delta") < stop_below, F.lit(False)))


def band_export(ranked: DataFrame, band: Column, known: DataFrame, quota: int) -> DataFrame:
    """At most `quota` rows of each rank band, those not in `known` first."""
    rows = ranked.withColumn("band", band).where("band is not null").join(known.select("query_id", "doc_id", F.lit(1).alias("_in")), ["query_id", "doc_id"], "left")
    rows = rows.withColumn("in_known", F.coalesce("_in", F.lit(0)).cast("long")).drop("_in")
    w = Window.partitionBy("query_id", "band").orderBy("in_known", "rank")
    return rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= quota).drop("n")


def judge_status(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), "not judged").when(a == b, "unanimous").otherwise("disagreement")


def spot_check(df: DataFrame, strong: str, model: str) -> DataFrame:
    """Accuracy of model labels against a strong judge's, and of always naming the most common class."""
    whole = df.where(f"`{strong}` is not null and `{model}` is not null")
    top = whole.groupBy(strong).count().agg(F.max("count").alias("top"))
    hit = whole.agg(F.count("*").alias("n"), F.sum(F.when(F.col(strong) == F.col(model), 1).otherwise(0)).alias("hits"))
    return hit.crossJoin(top).select("n", F.round(F.try_divide("hits", "n"), 6).alias("accuracy"), F.round(F.try_divide("top", "n"), 6).alias("majority"))


def counts_for(dim: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """Counts for each key of a dimension, 0 where there are none."""
    return dim.select(key).join(df.groupBy(key).agg(F.count("*").alias("n")), key, "left").fillna(0, ["n"])
