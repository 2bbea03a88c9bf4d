"""Deduplication, set operations, sampling and splits. Every choice among rows has an explicit order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.sources.files import cached


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Of each key the first row in the order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def ranked_unique(df: DataFrame, group: str, key: str, position: Sequence[Column], most: int | None = None) -> DataFrame:
    """Results gathered over pages: each key once, at its first position, ranked anew from 1."""
    once = first_by(df, [group, key], position)
    out = once.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*position, F.col(key))).cast("long"))
    return out.where(F.col("rank") <= most) if most else out


def union_first_seen(frames: Sequence[DataFrame], group: str, key: str, position: str) -> DataFrame:
    """Distinct keys of several lists, in the order of first sight: list by list, then by position."""
    both = None
    for k, f in enumerate(frames):
        f = f.select(group, key, F.struct(F.lit(k).alias("list"), F.col(position).cast("long").alias("pos")).alias("seen"))
        both = f if both is None else both.unionByName(f)
    once = both.groupBy(group, key).agg(F.min("seen").alias("seen"))
    return once.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy("seen", key)).cast("long")).drop("seen")


def excluded(df: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(known.select(*keys).distinct(), list(keys), "left_anti")


def kept(df: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(known.select(*keys).distinct(), list(keys), "left_semi")


def flagged(df: DataFrame, known: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    marks = known.select(*keys).distinct().withColumn(flag, F.lit(True))
    return df.join(marks, list(keys), "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def shared_flag(df: DataFrame, key: str, flag: str) -> DataFrame:
    """Whether another row has the same key."""
    counts = df.groupBy(F.col(key).alias("_key")).agg((F.count("*") > 1).alias(flag))
    return df.join(counts, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def name_audit(df: DataFrame, name: str, key: str, least: int = 2) -> DataFrame:
    """Names that several different keys carry."""
    return df.groupBy(name).agg(F.count_distinct(key).alias("keys"), F.count("*").alias("rows")).where(F.col("keys") >= least)


def hash_order(*keys: str, seed: int = 0) -> Column:
    """A fixed shuffle: an order that depends on the key and the seed alone, expressible in any engine with md5."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """A simple random sample of n rows, the same wherever it is drawn."""
    return df.orderBy(hash_order(key, seed=seed), key).limit(n)


def sample_by_group(df: DataFrame, group: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """At most n random rows of each group."""
    w = Window.partitionBy(group).orderBy(hash_order(key, seed=seed), F.col(key))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


#: Leading hex digits by which hashes are counted.
DIGITS = 5


def nested_tiers(df: DataFrame, key: str, existing: Column, targets: dict[str, int], seed: int = 0) -> DataFrame:
    """One flag column for each target size: all existing rows and a prefix of one fixed shuffle of the others.

    The prefix ends at a hash threshold. Rows are counted by the hash's first digits, 16^DIGITS ranges at most; only the
    one range that the threshold lies in is sorted.
    """
    shuffled = df.withColumn("_h", hash_order(key, seed=seed)).withColumn("_p", F.substring("_h", 1, DIGITS))
    fresh = shuffled.where(~existing).select(key, "_h", "_p")
    n_existing = df.where(existing).count()
    counts = cached(df.sparkSession, fresh.groupBy("_p").agg(F.count("*").alias("_c")), "hash-ranges")
    starts = counts.withColumn("_to", F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)))
    out = shuffled.drop("_p")
    for name, size in targets.items():
        room = max(0, size - n_existing)
        at = starts.where(F.col("_to") >= room).orderBy("_p").first() if room else None
        if not room:
            out = out.withColumn(name, existing)
        elif at is None:
            out = out.withColumn(name, F.lit(True))
        else:
            inside = fresh.where(F.col("_p") == at["_p"]).orderBy("_h", key).limit(room - at["_to"] + at["_c"])
            last = inside.agg(F.max(F.struct("_h", key)).alias("last"))
            out = out.crossJoin(F.broadcast(last)).withColumn(name, existing | F.coalesce(F.struct("_h", key) <= F.col("last"), F.lit(False))).drop("last")
    return out.drop("_h")


def fold_of(key: str, folds: int, seed: int = 0) -> Column:
    """Group-disjoint folds: the same key is always in the same fold."""
    return (F.conv(F.substring(hash_order(key, seed=seed), 1, 8), 16, 10).cast("long") % folds).cast("long")


def noisy_copies(df: DataFrame, key: str, vec: str, copies: int, spread: float = 0.15, seed: int = 7) -> DataFrame:
    """Filler vectors: copies of rows with Gaussian noise whose deviation is `spread` times the mean length."""
    scale = df.agg((F.avg(F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))) * spread).alias("sd"))
    many = df.crossJoin(F.broadcast(scale)).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    # Box-Muller on hashes: the noise belongs to (key, copy, dimension), not to a partition
    unit = lambda salt, i: (F.pmod(F.xxhash64(F.col(key), F.col("copy"), i, F.lit(seed + salt)), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    noise = F.transform(vec, lambda x, i: x.cast("double") + F.col("sd") * F.sqrt(-2 * F.log(unit(0, i))) * F.cos(2 * 3.141592653589793 * unit(1, i)))
    return many.select(key, "copy", noise.alias(vec))
