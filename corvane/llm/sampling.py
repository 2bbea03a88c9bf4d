"""Bounded training samples, the same wherever they are drawn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPAN = 1 << 40


def first_by_hash(df: DataFrame, key: str, rows: int, salt: int = 0, out: str = "order") -> DataFrame:
    """At most `rows` rows, the first by a hash of the key, with the hash as column `out`.

    Rows that cannot be among them are dropped by a threshold on the hash before anything is sorted, so that what reaches
    the last task is a few times `rows` and does not grow with the number of partitions.
    """
    df = df.withColumn(out, F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(_SPAN)))
    share = 4 * rows / max(1, df.count())
    if share < 1:
        df = df.where(F.col(out) < int(_SPAN * share))
    return df.orderBy(out, key).limit(rows)
