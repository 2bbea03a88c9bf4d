"""Which texts to trust: junk phrases, boilerplate, keyword alignment, contamination and its effect."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators.relevance import Classes
from corvane.operators.retrieval import in_slices


def template_similarity(vectors: DataFrame, templates: DataFrame) -> DataFrame:
    """doc_id and its largest cosine to a template (tvec); templates are a stated list, broadcast in slices of a bounded size.

    A matrix product for each batch of vectors, of which one number each is kept. A zero vector has cosine 0.
    """

    def best(sent):
        def run(batches):
            import numpy as np
            import pyarrow as pa

            def unit(x):
                n = np.sqrt((x * x).sum(1, keepdims=True))
                return x / np.where(n == 0, 1, n)

            few = unit(sent.value)
            for batch in batches:
                if batch.num_rows:
                    x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((unit(x) @ few.T).max(1))], names=["doc_id", "similarity"])

        return run

    rows, out = vectors.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("vec").cast("array<double>").alias("vec")), None
    for part in in_slices(templates, "tvec"):
        few = np.array(part.select(F.col("tvec").cast("array<double>").alias("v")).toArrow().column("v").to_pylist(), float)
        if len(few):
            found = rows.mapInArrow(best(vectors.sparkSession.sparkContext.broadcast(few)), "doc_id long, similarity double")
            out = found if out is None else out.unionByName(found)
    out = rows.select("doc_id", F.lit(None).cast("double").alias("similarity")) if out is None else out
    return out.groupBy("doc_id").agg(F.round(F.max("similarity"), 6).alias("similarity"))


def verdict(text: Column, similarity: Column, phrases: Sequence[str], least_words: int = 15, boilerplate_from: float = 0.97) -> Column:
    """Reasons against a text, joined; the one reason `empty` for a blank text; an empty string where it may be trusted."""
    reasons = F.array_compact(F.array(F.when(T.word_count(text) < least_words, "short"), F.when(T.any_phrase(text, phrases), "junk"), F.when(similarity >= boilerplate_from, "boilerplate")))
    return F.when(T.filled(text).isNull(), "empty").otherwise(F.array_join(reasons, ","))


def keyword_verdict(keywords: Column, alignment: Column, least: float = 0.25) -> Column:
    """Whether keywords can be trusted: there are some, and they are near the text."""
    return F.when(F.coalesce(F.size(keywords), F.lit(0)) <= 0, False).otherwise(F.coalesce(alignment >= least, F.lit(False)))


def repeated_texts(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = 5) -> DataFrame:
    """Texts that at least `least` different keys carry, by a hash of the text so that long texts are not shuffled."""
    marks = docs.where(T.filled(F.col(text)).isNotNull()).select(F.md5(text).alias("text_md5"), key)
    return marks.groupBy("text_md5").agg(F.count_distinct(key).alias("n")).where(F.col("n") >= least)


def contamination(relevant: DataFrame, junk: DataFrame) -> DataFrame:
    """Per query: relevant documents, how many are junk, and the share in percent."""
    marks = relevant.join(junk.select("doc_id", F.lit(1).alias("bad")).distinct(), "doc_id", "left")
    return marks.groupBy("query_id").agg(F.count("*").alias("relevant"), F.count("bad").alias("junk")).withColumn("pct", F.round(100.0 * F.col("junk") / F.col("relevant"), 6))


def contamination_by_class(relevant: Classes, junk: str) -> DataFrame:
    """contamination() of judgements by classes whose documents hold the mark `junk`; rows without a mark count as neither."""
    n = relevant.counted([junk]).where(F.col(junk).isNotNull())
    out = n.groupBy("query_id").agg(F.sum("n").alias("relevant"), F.sum(F.when(F.col(junk), F.col("n")).otherwise(0)).alias("junk"))
    return out.withColumn("pct", F.round(100.0 * F.col("junk") / F.col("relevant"), 6))


def contamination_by_tier(docs: DataFrame, tiers: Sequence[str], source: str = "source", junk: str = "junk") -> DataFrame:
    """Junk share by tier and source, and over all sources of a tier (source `all`)."""
    each = docs.select(source, junk, F.explode(F.array_compact(F.array(*[F.when(F.col(t), t) for t in tiers]))).alias("tier"))
    out = each.groupBy("tier", source).agg(F.count("*").alias("n"), F.sum(F.col(junk).cast("long")).alias("bad"))
    total = out.groupBy("tier").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).select("tier", F.lit("all").alias(source), "n", "bad")
    return out.unionByName(total).withColumn("pct", F.round(100.0 * F.col("bad") / F.col("n"), 6))


def sensitivity(original: DataFrame, cleaned: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """The same metrics on two truths in long form: original, cleaned, delta and delta in percent."""
    long = lambda df, name: df.unpivot(list(by), list(metrics), "metric", name)
    both = long(original, "original").join(long(cleaned, "cleaned"), [*by, "metric"])
    delta = F.col("cleaned") - F.col("original")
    return both.withColumn("delta", F.round(delta, 6)).withColumn("delta_pct", F.round(F.when(F.col("original") != 0, 100 * delta / F.col("original")), 4))
