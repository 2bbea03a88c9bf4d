"""Agreement and significance: kappa, confusion, Wilcoxon, bootstrap, Spearman."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.sources.files import cached


def confusion(df: DataFrame, a: str, b: str, classes: Sequence[int]) -> DataFrame:
    """Rows of a, columns of b, absent cells 0; null labels are left out."""
    cells = df.where(f"`{a}` is not null and `{b}` is not null").groupBy(F.col(a).cast("long").alias("label_a")).agg(*[F.sum(F.when(F.col(b) == c, 1).otherwise(0)).alias(f"b_{c}") for c in classes])
    all_rows = df.sparkSession.createDataFrame([(int(c),) for c in classes], "label_a long")
    return all_rows.join(cells, "label_a", "left").fillna(0)


def kappa(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Cohen's kappa in each group: n, observed, expected, kappa (null where all labels agree by necessity)."""
    by = list(by)
    pairs = df.where(f"`{a}` is not null and `{b}` is not null")
    cell = pairs.groupBy(*by, F.col(a).alias("la"), F.col(b).alias("lb")).agg(F.count("*").alias("c"))
    total = cell.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("la") == F.col("lb"), F.col("c")).otherwise(0)).alias("same"))
    left = cell.groupBy(*by, F.col("la").alias("l")).agg(F.sum("c").alias("ca"))
    right = cell.groupBy(*by, F.col("lb").alias("l")).agg(F.sum("c").alias("cb"))
    chance = left.join(right, [*by, "l"]).groupBy(*by).agg(F.sum(F.col("ca") * F.col("cb")).alias("chance"))
    out = total.join(chance, by, "left") if by else total.crossJoin(chance)
    po, pe = F.col("same") / F.col("n"), F.coalesce("chance", F.lit(0)) / (F.col("n") * F.col("n"))
    return out.select(*by, "n", F.round(po, 6).alias("observed"), F.round(pe, 6).alias("expected"), F.round(F.try_divide(po - pe, 1 - pe), 6).alias("kappa"))


def agreement(df: DataFrame, a: str, b: str, group: str) -> DataFrame:
    """Agreement and disagreement in each group and over all (group null)."""
    same = (F.col(a) == F.col(b)).cast("double")
    return df.rollup(group).agg(F.count("*").alias("n"), F.round(F.avg(same), 6).alias("agreement"), F.round(1 - F.avg(same), 6).alias("disagreement"))


def _running(df: DataFrame, value: str) -> DataFrame:
    """value, _c, _upto: how often each value occurs and how many rows are not above it.

    Ranges of values lie in partitions of their own, written so that they stay as they are; each starts where the last
    ended, so no task sorts all values.
    """
    counts = df.groupBy(value).agg(F.count("*").alias("_c"))
    counts = cached(df.sparkSession, counts.repartitionByRange(F.col(value)).withColumn("_part", F.spark_partition_id()), "ranks")
    starts = counts.groupBy("_part").agg(F.sum("_c").alias("_n"))  # as many rows as partitions
    starts = starts.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")
    w = Window.partitionBy("_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return counts.join(F.broadcast(starts), "_part").select(value, "_c", (F.col("_before") + F.sum("_c").over(w)).alias("_upto"))


def average_rank(df: DataFrame, value: str, by: Sequence[str], out: str) -> DataFrame:
    """Ranks from 1, ties sharing the mean of theirs. Equal values are counted before they are ranked."""
    by = list(by)
    if by:
        counts = df.groupBy(*by, value).agg(F.count("*").alias("_c"))
        counts = counts.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    else:
        counts = _running(df, value)
    return df.join(counts.select(*by, value, (F.col("_upto") - (F.col("_c") - 1) / 2.0).alias(out)), [*by, value])


def percentiles(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row: a column for each share between 0 and 1, the exact percentile with linear interpolation; null without
    values. Nulls are left out. Values are counted in ranges, so nothing gathers them."""
    placed = _running(df.where(F.col(value).isNotNull()), value)
    total = df.agg(F.count(value).alias("_n"))
    at = placed.crossJoin(F.broadcast(total))
    holds = lambda i: F.max(F.when((F.col("_upto") - F.col("_c") <= i) & (i < F.col("_upto")), F.col(value).cast("double")))
    cells = []
    for name, share in shares.items():
        spot = (F.col("_n") - 1) * share
        cells += [holds(F.floor(spot)).alias(f"{name}_lo"), holds(F.ceil(spot)).alias(f"{name}_hi"), F.max(spot - F.floor(spot)).alias(f"{name}_part")]
    row = at.agg(*cells)
    return row.select(*[(F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * F.col(f"{n}_part")).alias(n) for n in shares])


#: Up to so many differences the signed-rank distribution is counted out, above it is taken as normal.
EXACT_UP_TO = 50
# Abramowitz and Stegun 7.1.26, the error function to 1.5e-7.
_ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
_ERF_P = 0.3275911


def _two_sided(z: Column) -> Column:
    """2 x the normal probability below z, which is not positive."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + _ERF_P * x)
    poly = F.lit(0.0)
    for c in reversed(_ERF):
        poly = (poly + c) * t
    return poly * F.exp(-x * x)


def _counted_out(ranks: Column, statistic: Column) -> Column:
    """2 x the share of the 2^n ways to sign the ranks whose positive sum is at most the statistic. Ranks come doubled, so
    that tied ones are whole. ways[s], built up rank by rank, is how many ways give the sum s."""
    sums = F.sequence(F.lit(0), F.aggregate(ranks, F.lit(0), lambda t, r: t + r))
    first = F.transform(sums, lambda s: F.when(s == 0, 1.0).otherwise(0.0))
    ways = F.aggregate(ranks, first, lambda w, r: F.transform(sums, lambda s: F.get(w, s) + F.coalesce(F.when(s >= r, F.get(w, s - r)), F.lit(0.0))))
    below = F.aggregate(F.slice(ways, 1, (2 * statistic).cast("int") + 1), F.lit(0.0), lambda t, w: t + w)
    return F.least(F.lit(1.0), 2 * below / F.pow(F.lit(2.0), F.size(ranks)))


def wilcoxon(df: DataFrame, a: str, b: str) -> DataFrame:
    """Paired signed-rank test, zero differences dropped: n, w_plus, w_minus, statistic, the normal z (tie-corrected) and
    the two-sided p: counted out for up to EXACT_UP_TO differences, which is right with ties as well, normal with a
    continuity correction above. No differences give p 1."""
    d = df.select((F.col(a) - F.col(b)).alias("d")).where("d <> 0").withColumn("size", F.abs("d"))
    ranked = cached(df.sparkSession, average_rank(d, "size", [], "r"), "signed-ranks")
    ties = d.groupBy("size").agg(F.count("*").alias("c")).agg(F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("ties"))
    sums = ranked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("r"))), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum(F.when(F.col("d") < 0, F.col("r"))), F.lit(0.0)).alias("w_minus"))
    # empty above EXACT_UP_TO, so that one row never gathers many ranks
    few = ranked.crossJoin(sums.where(F.col("n") <= EXACT_UP_TO).select(F.lit(1).alias("few"))).agg(F.sort_array(F.collect_list((2 * F.col("r")).cast("int"))).alias("doubled"))
    n = F.col("n").cast("double")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.coalesce("ties", F.lit(0)) / 48.0)
    out = sums.crossJoin(ties).crossJoin(few).withColumn("statistic", F.least("w_plus", "w_minus"))
    off = F.col("statistic") - n * (n + 1) / 4
    normal = _two_sided(F.least(F.lit(0.0), F.try_divide(off + 0.5, spread)))
    p = F.when(F.col("n") == 0, 1.0).when(F.col("n") <= EXACT_UP_TO, _counted_out(F.col("doubled"), F.col("statistic"))).otherwise(F.coalesce(normal, F.lit(1.0)))
    return out.select("n", "w_plus", "w_minus", "statistic", F.round(F.try_divide(off, spread), 6).alias("z"), F.round(p, 6).alias("p"))


# The steps of the splitmix64 generator, which any engine with 64-bit numbers can repeat.
GOLDEN, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: Poisson(1): the chance of at most 0, 1, .. 8 draws; the rest counts as 9.
POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(9)]


def _resampled(resamples: int, seed: int):
    """Per batch of (key as text, difference): for each resample the number of draws and their sum. Ships without the library."""
    golden, a, b, steps = GOLDEN, MIX_A, MIX_B, POISSON

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        import numpy as np
        import pyarrow as pa

        number = np.arange(1, resamples + 1, dtype=np.uint64) * np.uint64(golden)
        drawn, total, edges = np.zeros(resamples, np.int64), np.zeros(resamples), np.array(steps)
        for batch in batches:
            values = batch.column(1).to_numpy()
            for at in range(0, batch.num_rows, 64):  # a matrix of 64 x resamples at a time
                keys = [hashlib.md5(f"{seed}:{k}".encode()).digest()[:8] for k in batch.column(0).slice(at, 64).to_pylist()]
                z = np.array([int.from_bytes(k, "little") for k in keys], np.uint64)[:, None] + number[None, :]
                z = (z ^ (z >> np.uint64(30))) * np.uint64(a)
                z = (z ^ (z >> np.uint64(27))) * np.uint64(b)
                z ^= z >> np.uint64(31)
                draws = np.searchsorted(edges, ((z >> np.uint64(12)).astype(float) + 0.5) / float(1 << 52), side="right")
                drawn += draws.sum(0)
                total += values[at : at + 64] @ draws
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, resamples + 1)), pa.array(drawn), pa.array(total)], names=["s", "drawn", "total"])

    return run


def bootstrap(df: DataFrame, a: str, b: str, key: str, resamples: int = 10_000, seed: int = 1) -> DataFrame:
    """95 % interval of the mean paired difference: low, high, mean, rounded to 6 places.

    Each row's number of draws in a resample is Poisson(1), from a hash of its key and the resample's number. A task
    multiplies its differences by the matrix of draws, a block of rows at a time, and sends one row for each resample, so
    what is shuffled does not depend on the table's size. Pairs with a null are left out; rows that share a key are drawn together.
    """
    pairs = df.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), (F.col(a) - F.col(b)).cast("double").alias("d")).where("d is not null")
    sums = pairs.mapInArrow(_resampled(resamples, seed), "s long, drawn long, total double").groupBy("s").agg(F.sum("drawn").alias("drawn"), F.sum("total").alias("total"))
    means = sums.select(F.try_divide("total", "drawn").alias("m"))
    return means.agg(*[F.round(c, 6).alias(n) for c, n in ((F.percentile("m", F.lit(0.025)), "low"), (F.percentile("m", F.lit(0.975)), "high"), (F.avg("m"), "mean"))])


def spearman(df: DataFrame, a: str, b: str, by: str, least: int = 6) -> DataFrame:
    """Rank correlation in each group of at least `least` pairs without nulls."""
    pairs = df.where(f"`{a}` is not null and `{b}` is not null").select(by, a, b)
    ranked = average_rank(average_rank(pairs, a, [by], "_rank_a"), b, [by], "_rank_b")
    return ranked.groupBy(by).agg(F.count("*").alias("n"), F.round(F.corr("_rank_a", "_rank_b"), 6).alias("spearman")).where(F.col("n") >= least)
