"""Small helpers on rows and columns that several operators need."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The longest array that one row is unrolled from.
UNROLL = 10_000


def fresh(name: str, taken: Iterable[str]) -> str:
    """A column name that is not taken; Spark compares names without case."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name += "_"
    return name


def unrolled(df: DataFrame, count: str | Column, at: str) -> DataFrame:
    """`count` rows for each row, numbered from 0 in the column `at`, which is new; rows with a count under 1 go.

    They are made in chunks, so that no array grows with the count.
    """
    count = F.col(count) if isinstance(count, str) else count
    zero = F.lit(0).cast("long")
    chunk = fresh("_chunk", [*df.columns, at])
    chunks = df.where(count >= 1).withColumn(chunk, F.explode(F.sequence(zero, F.floor((count - 1) / UNROLL))))
    begin = F.col(chunk) * UNROLL
    return chunks.withColumn(at, F.explode(F.sequence(begin, F.least(count.cast("long") - 1, begin + UNROLL - 1)))).drop(chunk)
