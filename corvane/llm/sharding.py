"""Sharding by jump consistent hashing (Lamping and Veach 2014), in DataFrame functions only.

A 64-bit key seeds a linear congruential sequence; its values make the key jump from shard to shard, and the last jump
below the shard count is the key's shard. No table of shards exists: key and count decide, and with one more shard a key
either stays or moves into the new one. The loop is a fold with as many steps as shards at most, which is exact, as every
jump goes up; products modulo 2**64 are put together from 16-bit parts, so nothing overflows.

Slots number a shard's rows from 0 without gaps. They come from running counts in sub-buckets of a shard, whose number
grows with the table, plus the counts of the sub-buckets before: no task sorts a whole shard, and equal rows are counted,
not moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.rows import unrolled

#: Multiplier of the sequence; fixed by the published method.
MULTIPLIER = 2862933555777941757
_HIGH, _LOW = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
_MASK = 0xFFFFFFFF
#: Rows of a sub-bucket, on average.
BUCKET_ROWS = 4000


def _low32(a: Column, b: int) -> Column:
    """The low 32 bits of a * b, both below 2**32."""
    upper = F.shiftleft((F.shiftright(a, 16) * b).bitwiseAND(0xFFFF), 16)
    return (a.bitwiseAND(0xFFFF) * b + upper).bitwiseAND(_MASK)


def _advance(high: Column, low: Column) -> tuple[Column, Column]:
    """The next state, key * MULTIPLIER + 1 modulo 2**64, of a state in two 32-bit halves."""
    upper = F.shiftright(low, 16) * _LOW
    first = low.bitwiseAND(0xFFFF) * _LOW + F.shiftleft(upper.bitwiseAND(0xFFFF), 16) + 1
    carry = F.shiftright(first, 32) + F.shiftright(upper, 16)
    return (carry + _low32(low, _HIGH) + _low32(high, _LOW)).bitwiseAND(_MASK), first.bitwiseAND(_MASK)


def _halves(key: Column) -> tuple[Column, Column]:
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    return F.shiftrightunsigned(key, 32), key.bitwiseAND(_MASK)


def jump_shards(key: Column, shards: int) -> Column:
    """struct(shard, grown): the key's shard of `shards`, and of one more. A null key counts as 0."""
    high, low = _halves(key)
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("at"), high.alias("high"), low.alias("low"), zero.alias("shard"), zero.alias("grown"))

    def jump(state: Column, _: Column) -> Column:
        high, low = _advance(state["high"], state["low"])
        to = F.floor((state["at"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1).cast("double")))
        moved = F.struct(to.cast("long").alias("at"), high.alias("high"), low.alias("low"), F.when(state["at"] < shards, state["at"]).otherwise(state["shard"]).alias("shard"), state["at"].alias("grown"))
        return F.when(state["at"] <= shards, moved).otherwise(state)

    end = F.aggregate(F.sequence(F.lit(0), F.lit(shards + 1)), start, jump)
    return F.struct(end["shard"].cast("int").alias("shard"), end["grown"].cast("int").alias("grown"))


def sharded(documents: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per document: id_col, size, text_crc32, law, shard, slot, grown_shard.

    Size is the text's UTF-8 bytes plus 8. law is always `key`. Slots go by sub-bucket, id, size and checksum.

    Defined cases: a null text has no bytes and the checksum of none; a null id is placed like 0. Repeated rows are
    placed together in neighbouring slots, each with its own. An empty table gives no rows. Only the named columns are
    read.
    """
    rows = documents.select(F.col(id_col).cast("long").alias("id"), (F.coalesce(F.octet_length(text_col), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("crc"))
    rows = rows.groupBy("id", "size", "crc").agg(F.count("*").alias("n"))
    total = documents.select(F.lit(1)).count()
    buckets = max(1, -(-total // (bucket_rows * shards)))
    # the shard goes by the id alone, the sub-bucket by the whole row: rows without an id do not meet in one window
    row = F.coalesce("id", F.lit(0).cast("long")).bitwiseXOR(F.shiftleft("crc", 21)).bitwiseXOR(F.col("size"))
    rows = rows.withColumn("to", jump_shards(F.col("id"), shards)).withColumn("bucket", (_advance(*_halves(row))[0] % buckets).cast("long"))
    rows = rows.select("id", "size", "crc", "n", F.col("to.shard").alias("shard"), F.col("to.grown").alias("grown_shard"), "bucket")
    counts = rows.groupBy("shard", "bucket").agg(F.sum("n").alias("of_bucket"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "bucket", F.coalesce(F.sum("of_bucket").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "bucket").orderBy("id", "size", "crc").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("upto", F.sum("n").over(within)).join(counts, ["shard", "bucket"])
    slot = F.col("base") + F.col("upto") - F.col("n") + F.col("copy")
    return unrolled(placed, "n", "copy").select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard", slot.alias("slot"), "grown_shard")
