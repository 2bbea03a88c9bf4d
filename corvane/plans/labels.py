"""Queries of labelling, trust, remote search and streaming."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import evaluation as E
from corvane.operators import labelling as L
from corvane.operators import stats as S
from corvane.operators import trust as X
from corvane.plans import base as B
from corvane.plans.registry import query
from corvane.sources import files
from corvane.sources.paged import PagedSearch
from corvane.streaming import ingest


@query("""SELECT 'q0' AS query, i AS doc_id, 1.0::DOUBLE / (1 + i) AS score, (i + 1)::INTEGER AS rank, i::INTEGER AS position FROM range(40) r(i)
UNION ALL SELECT 'q1', i, 1.0::DOUBLE / (1 + i), (i + 1)::INTEGER, i::INTEGER FROM range(7) r(i)""")
def s8_s9_paged_search(spark, t):
    """Cursor paging over rows that stand for the remote service, duplicates across pages removed."""
    rows = {"q0": [{"doc_id": i % 40, "score": 1 / (1 + i)} for i in range(60)], "q1": [{"doc_id": i, "score": 1 / (1 + i)} for i in range(7)]}
    spark.dataSource.register(PagedSearch)
    return spark.read.format("paged_search").options(queries=json.dumps(list(rows)), fetch="corvane.sources.paged:json_pages", rows=json.dumps(rows), size="25", target="50").load()


@query("SELECT event_type, user_id, count(*) AS n FROM events WHERE event_type IN ('view', 'click') AND value >= 5 AND user_id NOT IN (1, 2, 3) GROUP BY ALL")
def s8_filtered_search(spark, t):
    """must_one, must_not and range filters of the remote search, over a local table."""
    hits = t("events").where(F.col("event_type").isin("view", "click") & (F.col("value") >= 5) & ~F.col("user_id").isin(1, 2, 3))
    return hits.groupBy("event_type", "user_id").agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id, value FROM events")
def s11_resumable_ingest(spark, t):
    """A file stream run to its end, each key once; its checkpoint and output lie in the shared folder."""
    path = files.scratch(spark, "events")
    t("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value").write.parquet(path)
    return ingest.replay(spark, path, lambda s: ingest.deduplicated(s, "event_id", "ts", "3650 days"), "ingested").select("event_id", "user_id", "value")


@query(f"WITH {B.JUDGES}, f AS (SELECT event_id, (props->>'k')::BIGINT AS k FROM events) SELECT CASE WHEN k >= 50 THEN 'keyword' ELSE 'none' END AS filter, count(*) AS n FROM f GROUP BY ALL")
def f6_extracted_filter(spark, t):
    """A filter that a model wrote as JSON, parsed and applied."""
    k = F.from_json("props", "k long")["k"]
    return t("events").groupBy(F.when(k >= 50, "keyword").otherwise("none").alias("filter")).agg(F.count("*").alias("n"))


@query(f"WITH {B.DENSE}, s AS (SELECT DISTINCT channel, query_id, doc_id FROM ranked WHERE rank <= 20) SELECT query_id, doc_id, string_agg(channel, ',' ORDER BY channel) AS sources, count(*) AS n_sources FROM s GROUP BY ALL")
def l1_trec_pool(spark, t):
    docs = t("embeddings").select(F.col("vec_id").alias("doc_id"), F.lit("x").alias("text"))
    return L.pool(B.ranked(t), docs, 20)


_REASONS = "concat_ws(',', CASE WHEN len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+')) < 15 THEN 'short' END, CASE WHEN " + " OR ".join(f"contains(lower(text), '{p}')" for p in B.JUNK) + " THEN 'junk' END, CASE WHEN doc_id % 7 = 0 THEN 'boilerplate' END)"


@query(f"SELECT doc_id, CASE WHEN trim(text) = '' OR text IS NULL THEN 'empty' ELSE {_REASONS} END AS reasons FROM documents")
def l2_trust_verdict(spark, t):
    similarity = F.when(F.col("doc_id") % 7 == 0, 0.99).otherwise(0.1)
    return t("documents").select("doc_id", X.verdict(F.col("text"), similarity, B.JUNK).alias("reasons"))


@query("SELECT vec_id, label <> 0 AND round(list_cosine_similarity(embedding[1:32]::DOUBLE[], embedding[33:64]::DOUBLE[]), 6) >= 0.05 AS trusted FROM embeddings")
def l3_keyword_verdict(spark, t):
    from corvane.functions import vector as V

    words = F.when(F.col("label") != 0, F.array(F.col("label").cast("string"))).otherwise(F.array().cast("array<string>"))
    align = F.round(V.cosine(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)), 6)
    return t("embeddings").select("vec_id", X.keyword_verdict(words, align, 0.05).alias("trusted"))


@query("SELECT md5(text) AS text_md5, count(DISTINCT doc_id) AS n FROM documents GROUP BY text HAVING n >= 2")
def l4_boilerplate_audit(spark, t):
    return X.repeated_texts(t("documents"), least=2)


_AGREED = "ag AS (SELECT query_id, doc_id, count(label) AS n_labels, CASE WHEN count(label) >= 2 AND count(DISTINCT label) = 1 THEN min(label) ELSE -1 END AS gold_label, CASE WHEN count(label) >= 2 AND count(DISTINCT label) = 1 THEN 'gold' ELSE 'review' END AS status FROM jl GROUP BY ALL)"


@query(f"WITH {B.JUDGES}, {_AGREED} SELECT query_id, doc_id, n_labels, gold_label, status FROM ag")
def l5_judge_agreement(spark, t):
    return L.agreed(B.judged_long(t)).withColumn("gold_label", F.coalesce("gold_label", F.lit(-1)))


def _merged(t):
    gold = L.agreed(B.judged_long(t))
    human = gold.where("status = 'review'").select("query_id", "doc_id", F.when(F.col("doc_id") % 3 == 0, "SKIP").otherwise((F.col("doc_id") % 2).cast("string")).alias("decision"))
    return L.merged_labels(gold, human, ["query_id", "doc_id"])


_MERGED = f"{_AGREED}, me AS (SELECT query_id, doc_id, gold_label::BIGINT AS gold_label, 'judges' AS source FROM ag WHERE status = 'gold' UNION ALL SELECT query_id, doc_id, doc_id % 2, 'human' FROM ag WHERE status = 'review' AND doc_id % 3 <> 0)"


@query(f"WITH {B.JUDGES}, {_MERGED} SELECT query_id, doc_id, gold_label, source FROM me")
def l6_tie_break_merge(spark, t):
    return _merged(t)


@query(f"WITH {B.JUDGES} SELECT query_id, doc_id, CASE WHEN doc_id % 4 = 0 THEN 'kept' ELSE '' END AS label FROM j")
def l6_kept_reviews(spark, t):
    queue = B.judges(t).select("query_id", "doc_id", F.lit("").alias("label"))
    earlier = queue.where("doc_id % 4 = 0").select("query_id", "doc_id", F.lit("kept").alias("label"))
    return L.kept_reviews(queue, earlier, ["query_id", "doc_id"], "label")


_SILVER = "si AS (SELECT query_id, doc_id, p, (p >= 0.5)::BIGINT AS silver_label, CASE WHEN a = b THEN 'gold' ELSE 'silver' END AS tier FROM j)"


def _silver(t):
    j = B.judges(t)
    return L.silver(j, j.where("a = b"), ["query_id", "doc_id"])


@query(f"WITH {B.JUDGES}, {_SILVER} SELECT query_id, doc_id, round(p, 9) AS p, silver_label, tier FROM si")
def l7_silver_tiering(spark, t):
    return _silver(t).withColumn("p", F.round("p", 9))


@query(f"WITH {B.JUDGES}, {_SILVER} SELECT query_id, doc_id, tier, row_number() OVER (PARTITION BY query_id ORDER BY tier = 'gold' DESC, p DESC, doc_id) AS rank FROM si QUALIFY rank <= 10")
def l8_gold_first(spark, t):
    return L.gold_first(_silver(t), 10).select("query_id", "doc_id", "tier", "rank")


@query(f"WITH {B.JUDGES} SELECT query_id, doc_id, round(abs(p - 0.5), 9) AS doubt, row_number() OVER (PARTITION BY query_id ORDER BY round(abs(p - 0.5), 9), doc_id) AS n FROM j WHERE a <> b QUALIFY n <= 10")
def l9_uncertainty_queue(spark, t):
    j = B.judges(t)
    return L.uncertain(j, j.where("a = b"), 10).select("query_id", "doc_id", "doubt", "n")


@query("""WITH r AS (SELECT user_id % 6 AS round, round(avg(value), 6) AS v FROM events GROUP BY ALL), d AS (SELECT *, round(v - lag(v) OVER (ORDER BY round), 6) AS delta FROM r)
SELECT round, v, coalesce(delta, 0) AS delta, coalesce(abs(delta) < 0.03, FALSE) AS stop FROM d""")
def l10_round_history(spark, t):
    rounds = t("events").groupBy((F.col("user_id") % 6).alias("round")).agg(F.round(F.avg("value"), 6).alias("v"))
    return L.round_history(rounds, "v").withColumn("delta", F.coalesce("delta", F.lit(0.0)))


@query(f"""WITH {B.DENSE}, x AS (SELECT a.query_id, a.doc_id, a.rank, CASE WHEN a.rank <= 20 THEN '1-20' WHEN a.rank <= 50 THEN '21-50' ELSE '51-100' END AS band, CASE WHEN b.doc_id IS NULL THEN 0 ELSE 1 END AS in_known FROM ip a LEFT JOIN l2 b USING (query_id, doc_id))
SELECT query_id, doc_id, rank, band, in_known::BIGINT AS in_known FROM x QUALIFY row_number() OVER (PARTITION BY query_id, band ORDER BY in_known, rank) <= 5""")
def l11_rank_band_export(spark, t):
    band = E.rank_band(F.col("rank"), ((1, 20), (21, 50), (51, 100)))
    return L.band_export(B.ip_channel(t), band, B.l2_channel(t), 5).select("query_id", "doc_id", "rank", "band", "in_known")


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 20 = 0), d AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v FROM embeddings WHERE label >= 5),
s AS (SELECT query_id, doc_id, round(list_dot_product(qv, v), 6) AS score FROM q, d WHERE query_id <> doc_id) SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10""")
def l12_independent_pool(spark, t):
    from corvane.operators.retrieval import exact

    fresh = B.vectors(t).where("label >= 5").select("doc_id", "vec")
    return exact(fresh, B.vector_queries(t).select("query_id", "qvec"), "ip", 10).select("query_id", "doc_id", "rank")


@query(f"WITH {B.JUDGES}, m AS (SELECT a, (p >= 0.5)::BIGINT AS s FROM j) SELECT count(*) AS n, round(count(*) FILTER (a = s) / count(*), 6) AS accuracy, round((SELECT max(c) FROM (SELECT count(*) AS c FROM m GROUP BY a)) / count(*), 6) AS majority FROM m")
def l13_spot_check(spark, t):
    return L.spot_check(B.judges(t).withColumn("s", (F.col("p") >= 0.5).cast("long")), "a", "s")


@query("""SELECT d.doc_id, coalesce(quality, -1) AS human, coalesce(1 - toxic, -1) AS judge, CASE WHEN quality IS NULL OR toxic IS NULL THEN 'not judged' WHEN quality = 1 - toxic THEN 'unanimous' ELSE 'disagreement' END AS status FROM documents d LEFT JOIN labels USING (doc_id)""")
def l14_four_way_table(spark, t):
    j = t("documents").select("doc_id").join(t("labels"), "doc_id", "left").select("doc_id", F.col("quality").alias("h"), (1 - F.col("toxic")).alias("j"))
    return j.select("doc_id", F.coalesce("h", F.lit(-1)).alias("human"), F.coalesce("j", F.lit(-1)).alias("judge"), L.judge_status(F.col("h"), F.col("j")).alias("status"))


@query("SELECT item_id AS query_id, (SELECT count(*) FROM labels WHERE labels.doc_id = item_id AND quality = 1) AS n FROM benchmark")
def l15_counts_with_zero(spark, t):
    done = t("labels").where("quality = 1").select(F.col("doc_id").alias("query_id"))
    return L.counts_for(B.benchmark(t), done, "query_id")


@query("SELECT role, count(*) AS n, round(avg(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+'))), 6) AS mean_words FROM conversations GROUP BY role")
def p7_words_by_role(spark, t):
    return t("conversations").groupBy("role").agg(F.count("*").alias("n"), F.round(F.avg(T.word_count(F.col("text"))), 6).alias("mean_words"))


@query(f"WITH {B.JUDGES}, x AS (SELECT a, b, count(*) AS c FROM j GROUP BY ALL), t AS (SELECT sum(c)::DOUBLE AS n, coalesce(sum(c) FILTER (a = b), 0)::DOUBLE AS s FROM x), e AS (SELECT sum(l * r)::DOUBLE AS ch FROM (SELECT a AS k, sum(c) AS l FROM x GROUP BY a) JOIN (SELECT b AS k, sum(c) AS r FROM x GROUP BY b) USING (k)) SELECT n::BIGINT AS n, round(s / n, 6) AS observed, round(ch / (n * n), 6) AS expected, round((s / n - ch / (n * n)) / (1 - ch / (n * n)), 6) AS kappa FROM t, e")
def e19_kappa_pooled(spark, t):
    return S.kappa(B.judges(t), "a", "b")
