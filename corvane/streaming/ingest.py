"""Incremental forms: resumable ingest with deduplication, upserts by batch, and windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def deduplicated(stream: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """Each key once; state older than the watermark is dropped, so it stays bounded."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed(events: DataFrame, time: str, width: str, by: str, value: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Tumbling (or sliding) window counts and sums; works on streams and tables alike."""
    source = events.withWatermark(time, late) if events.isStreaming else events
    w = F.window(time, width, slide) if slide else F.window(time, width)
    out = source.groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.round(F.sum(value), 6).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), by, "n", "total")


def sessions(events: DataFrame, time: str, user: str, gap: str, late: str = "10 minutes") -> DataFrame:
    source = events.withWatermark(time, late) if events.isStreaming else events
    out = source.groupBy(F.session_window(time, gap).alias("w"), user).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), user, "n")


def upsert(target: str, key: str, order: str):
    """A foreachBatch function that keeps, at `target`, the latest row of each key. Each version is written anew and
    named by its batch, so a batch that is run twice writes the same version twice."""

    def run(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        known = batch
        if number > 0:
            known = spark.read.parquet(f"{target}/v{number - 1}").unionByName(batch, allowMissingColumns=True)
        w = Window.partitionBy(key).orderBy(F.desc(order))
        known.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").write.mode("overwrite").parquet(f"{target}/v{number}")

    return run


def replay(spark: SparkSession, path: str, transform, name: str) -> DataFrame:
    """Run a file stream to its end through `transform` into a table, with its checkpoint in the shared folder."""
    from corvane.sources.files import scratch

    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "*.parquet").parquet(path)
    out = scratch(spark, name)
    query = transform(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)
