"""Queries of the corpus layer: sources, projections, filters, deduplication, sampling, joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import dedup as D
from corvane.plans import base as B
from corvane.plans.registry import query
from corvane.sources import files as S
from corvane.sources import matrix as M
from corvane.sources import workbook as W

# ---- sources and sinks


@query("SELECT item_id, text, length(text) AS chars FROM benchmark")
def s1_workbook_round_trip(spark, t):
    path = S.scratch(spark, "review") + ".xlsx"
    W.write_workbook(t("benchmark").select("item_id", "text", F.length("text").alias("chars")), path)
    return W.read_workbook(spark, path, "item_id long, text string, chars long")


@query("SELECT doc_id, lang, source, n_chars, text FROM documents")
def s2_csv_round_trip(spark, t):
    path = S.scratch(spark, "csv")
    S.write_csv(t("documents").select("doc_id", "lang", "source", "n_chars", "text"), path)
    return S.read_csv(spark, path, "doc_id long, lang string, source string, n_chars long, text string")


@query("SELECT item_id, text FROM benchmark")
def s3_json_round_trip(spark, t):
    path = S.scratch(spark, "json")
    S.write_json(t("benchmark"), path)
    return S.read_json(spark, path, "item_id long, text string")


@query(f"WITH {B.DENSE} SELECT query_id, rank, doc_id, score FROM ip")
def s4_nested_json_flatten(spark, t):
    path = S.scratch(spark, "nested")
    S.write_json(S.nested_results(B.ip_channel(t)).withColumn("query", F.concat(F.lit("q"), "query_id")), path)
    nested = S.read_json(spark, path, "query_id long, query string, results array<struct<rank: long, doc_id: long, score: double>>")
    return S.flattened_results(nested).select("query_id", "rank", "doc_id", "score")


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem WHERE l_returnflag = 'R'")
def s5_parquet_pruned(spark, t):
    return t("lineitem").where("l_returnflag = 'R'").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))


@query("SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings WHERE label < 5")
def s6_embedding_scan_masked(spark, t):
    return t("embeddings").where("label < 5").select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


def _matrix(spark, t) -> str:
    """Where the embeddings are stored as a matrix, made once for each state of the table."""

    def build():
        path = S.scratch(spark, "matrix")
        M.write_matrix(t("embeddings").where("embedding is not null").select("vec_id", F.col("label").cast("long").alias("label"), "embedding"), path)
        return path

    return S.stored(t("embeddings"), "matrix", build)


@query("SELECT vec_id, label::BIGINT AS label, embedding::DOUBLE[] AS embedding FROM embeddings WHERE embedding IS NOT NULL")
def s6_matrix_round_trip(spark, t):
    return M.read_matrix(spark, _matrix(spark, t)).withColumn("embedding", F.col("embedding").cast("array<double>"))


@query("SELECT vec_id, embedding::DOUBLE[] AS embedding FROM embeddings WHERE embedding IS NOT NULL AND label < 5")
def s6_matrix_masked(spark, t):
    """The mask is a stored column: vectors of other rows are not read but for short gaps."""
    return M.read_matrix(spark, _matrix(spark, t), ["vec_id", "embedding"], {"label": (None, 5)}).withColumn("embedding", F.col("embedding").cast("array<double>"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def s7_cached_result(spark, t):
    return S.cached(spark, t("documents").groupBy("source").agg(F.count("*").alias("n")), "cache")


@query("SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def s10_keyed_lookup(spark, t):
    return S.lookup(t("documents").select("doc_id", "text"), t("labels"), "doc_id")


@query("SELECT lang, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 6) AS share FROM documents GROUP BY lang")
def s12_value_counts(spark, t):
    return S.value_counts(t("documents"), "lang")


def _profile_sql(table: str, columns: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{k}' AS type, count(*) - count({c}) AS nulls, round((count(*) - count({c})) / count(*), 6) AS null_rate, count(DISTINCT {c}) AS distinct_values FROM {table}" for c, k in columns.items())


@query(_profile_sql("documents", {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}))
def s12_profile(spark, t):
    return S.profile(t("documents").select("doc_id", "text", "lang", "source", "n_chars"))


# ---- projections and filters

_RICH = "concat_ws(' | ', CASE WHEN trim(c_name) <> '' THEN 'Company: ' || c_name END, CASE WHEN trim(n_name) <> '' THEN 'Country: ' || n_name END, CASE WHEN trim(c_mktsegment) <> '' THEN 'Segment: ' || c_mktsegment END)"


@query(f"SELECT c_custkey, {_RICH} AS rich_text FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def p1_rich_text(spark, t):
    joined = t("customer").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.select("c_custkey", T.rich_text([("Company:", F.col("c_name")), ("Country:", F.col("n_name")), ("Segment:", F.col("c_mktsegment"))]).alias("rich_text"))


@query("SELECT doc_id, lang || ', ' || source AS keywords FROM documents")
def p2_keyword_text(spark, t):
    listed = F.concat(F.lit("['"), "lang", F.lit("', '"), "source", F.lit("']"))
    return t("documents").select("doc_id", T.keyword_text(listed).alias("keywords"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 'Unknown company' ELSE lang END AS title, text AS body FROM documents")
def p3_title_body(spark, t):
    return t("documents").select("doc_id", T.with_default(F.when(F.col("lang") != "en", F.col("lang")), "Unknown company").alias("title"), F.col("text").alias("body"))


@query("SELECT doc_id, coalesce(text, '') AS body FROM documents")
def p4_summary_only(spark, t):
    return t("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("body"))


@query("SELECT item_id, 'Instruct: find passages' || chr(10) || 'Query: ' || text AS prompt FROM benchmark")
def p5_instruction_prefix(spark, t):
    return t("benchmark").select("item_id", F.concat(F.lit("Instruct: find passages\nQuery: "), "text").alias("prompt"))


@query(r"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents) GROUP BY ALL")
def p6_tokens(spark, t):
    from corvane.operators.retrieval import postings

    return postings(t("documents"))


@query(r"SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')) AS tokens FROM documents")
def p6_tokens_with_marks(spark, t):
    return t("documents").select("doc_id", F.size(T.tokens_with_marks(F.col("text"))).cast("long").alias("tokens"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[^ \t\n\r\f\x0B]+')) AS words FROM documents")
def p7_word_count(spark, t):
    return t("documents").select("doc_id", T.word_count(F.col("text")).alias("words"))


@query("SELECT page_id, " + " OR ".join(f"contains(lower(html), '{p}')" for p in B.JUNK) + " AS junk FROM pages")
def p8_junk_phrases(spark, t):
    return t("pages").select("page_id", T.any_phrase(F.col("html"), B.JUNK).alias("junk"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'thin') OR contains(lower(source), 'thin')")
def p9_contains(spark, t):
    return t("documents").where(T.contains_fold(F.col("text"), "Thin") | T.contains_fold(F.col("source"), "Thin")).select("doc_id")


@query("SELECT doc_id, [lang, source] AS keywords FROM documents")
def p10_keyword_array(spark, t):
    listed = F.concat(F.lit("['"), "lang", F.lit("', '"), "source", F.lit("']"))
    return t("documents").select("doc_id", T.keyword_array(listed).alias("keywords"))


@query("SELECT doc_id, 'Query: ' || lang || chr(10) || 'Candidate: ' || CASE WHEN trim(source) = '' OR source IS NULL OR source = 'src0' THEN 'unknown' ELSE source END AS prompt FROM documents")
def p11_judge_prompt(spark, t):
    return t("documents").select("doc_id", T.judge_prompt("Query: {q}\nCandidate: {c}", q=F.col("lang"), c=F.when(F.col("source") != "src0", F.col("source"))).alias("prompt"))


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN -1 ELSE (props->>'k')::INTEGER % 3 END AS label,
  CASE WHEN event_type = 'error' THEN 'UNPARSEABLE: no answer' ELSE event_type END AS reason FROM events""")
def p12_judge_reply(spark, t):
    k = F.get_json_object("props", "$.k").cast("int") % 3
    reply = F.when(F.col("event_type") == "error", "no answer").otherwise(F.concat(F.lit('Sure: {"label": '), k.cast("string"), F.lit(', "reason": "'), "event_type", F.lit('"} done')))
    return t("events").select("event_id", T.judge_reply(reply).alias("r")).select("event_id", F.coalesce("r.label", F.lit(-1)).alias("label"), "r.reason")


@query("SELECT doc_id, doc_id % 10 AS query_id, 'k::' || doc_id AS key FROM labels")
def p13_pair_key(spark, t):
    made = t("labels").select("doc_id", T.pair_key(F.col("doc_id") % 10, F.concat(F.lit("k::"), "doc_id")).alias("pair"))
    return made.select("doc_id", T.split_pair_key(F.col("pair")).alias("s")).select("doc_id", "s.query_id", "s.key")


@query(r"""SELECT item_id, list_filter(list_transform(string_split_regex(trim(lower(text)), '\s+'), lambda w: regexp_replace(w, '^[.,;()]+|[.,;()]+$', '', 'g')), lambda w: length(w) > 2 AND w NOT IN ('the', 'and', 'der', 'die', 'les', 'des', 'los', 'las')) AS terms FROM benchmark""")
def p14_query_terms(spark, t):
    return t("benchmark").select("item_id", T.query_terms(F.col("text"), ("the", "and", "der", "die", "les", "des", "los", "las")).alias("terms"))


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def p15_normalised_name_match(spark, t):
    loud = t("customer").join(F.broadcast(t("nation").select("n_nationkey", F.concat(F.lit(" "), F.upper("n_name"), F.lit(" ")).alias("asked"))), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "asked")
    names = t("nation").select("n_name", F.lower(F.trim("n_name")).alias("key"))
    return loud.join(F.broadcast(names), F.lower(F.trim("asked")) == F.col("key")).select("c_custkey", "n_name")


@query("SELECT l_orderkey, l_linenumber::BIGINT AS line, round(l_extendedprice * (1 - l_discount), 6) AS price FROM lineitem")
def p16_rounding(spark, t):
    return t("lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 6).alias("price"))


@query(f"WITH {B.DENSE} SELECT channel, query_id, doc_id, rank FROM ranked WHERE rank <= 10")
def f1_rank_cutoff(spark, t):
    return B.ranked(t).where("rank <= 10").select("channel", "query_id", "doc_id", "rank")


@query(f"WITH {B.DENSE} SELECT query_id, doc_id, score FROM ip WHERE score >= 0.3")
def f2_threshold_relevance(spark, t):
    return B.ip_channel(t).where("score >= 0.3").select("query_id", "doc_id", "score")


@query(f"WITH {B.DENSE}, th AS (SELECT unnest([0.2, 0.3, 0.4, 0.5, 0.75, 0.9])::DOUBLE AS threshold) SELECT threshold, count(*) FILTER (score >= threshold) AS n, round(100 * avg(CASE WHEN score >= threshold THEN 1.0::DOUBLE ELSE 0 END), 6) AS pct FROM ip, th GROUP BY threshold")
def f3_threshold_sweep(spark, t):
    from corvane.operators.evaluation import passing

    return passing(B.ip_channel(t), "score", (0.2, 0.3, 0.4, 0.5, 0.75, 0.9))


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def f4_tier_mask(spark, t):
    tier = D.flagged(t("documents").select("doc_id", "source"), t("labels").where("quality = 1"), ["doc_id"], "in_tier")
    return tier.where("in_tier").select("doc_id", "source")


_ASKED = """asked AS (SELECT lang AS query, 'lang' AS facet, lang AS value FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL) UNION ALL SELECT lang, 'source', 'src' || s FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL), unnest([1, 2]) r(s)
  UNION ALL SELECT lang, 'size', '2' FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)),
hit AS (SELECT q.lang AS query, d.doc_id FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL) q JOIN documents d ON d.lang = q.lang AND d.source IN ('src1', 'src2') AND floor(log10(greatest(d.n_chars, 1)))::BIGINT = 2)"""


def _prefiltered(t):
    from corvane.operators.joins import facet_lists, prefilter

    docs = t("documents").withColumn("size", F.floor(F.log10(F.greatest("n_chars", F.lit(1)))).cast("long"))
    condition = lambda facet, value: F.struct(F.lit(facet).alias("facet"), value.alias("value"))
    each = F.array(condition("lang", F.col("lang")), condition("source", F.lit("src1")), condition("source", F.lit("src2")), condition("size", F.lit("2")))
    asked = docs.where("lang is not null").select("lang").distinct().select(F.col("lang").alias("query"), F.inline(each))
    return prefilter(facet_lists(docs, "doc_id", ["lang", "source", "size"]), asked, least=5)


@query(f"WITH {_ASKED} SELECT query, doc_id AS doc FROM hit")
def f5_facet_lists(spark, t):
    """Documents of a language, one of two sources and a size band, by inverted lists of the three facets."""
    return _prefiltered(t)[0]


@query(f"WITH {_ASKED} SELECT query, count(doc_id) AS n, count(doc_id) < 5 AS falls_back FROM (SELECT DISTINCT query FROM asked) LEFT JOIN hit USING (query) GROUP BY query")
def f5_fallback_flags(spark, t):
    return _prefiltered(t)[1]


@query("""SELECT asked AS asked_lang, doc_id FROM (SELECT DISTINCT lang AS asked FROM documents) a JOIN LATERAL (
  SELECT doc_id FROM documents d WHERE (d.lang = a.asked AND d.source = 'src1') OR (SELECT count(*) FROM documents e WHERE e.lang = a.asked AND e.source = 'src1') < 10) x ON TRUE""")
def f5_prefilter_with_fallback(spark, t):
    """What a search would go through: a query's documents, or all of them, as they lie, for each flagged query."""
    from corvane.operators.joins import facet_lists, prefilter

    docs = t("documents")
    condition = lambda facet, value: F.struct(F.lit(facet).alias("facet"), value.alias("value"))
    asked = docs.select("lang").distinct().select(F.col("lang").alias("query"), F.inline(F.array(condition("lang", F.col("lang")), condition("source", F.lit("src1")))))
    hits, flags = prefilter(facet_lists(docs, "doc_id", ["lang", "source"]), asked, least=10)
    open_ = flags.where("falls_back").agg(F.collect_list("query").alias("open"))  # a stated set of queries, one row
    whole = docs.select("doc_id").join(F.broadcast(open_)).select(F.explode("open").alias("asked_lang"), "doc_id")
    narrow = hits.join(flags.where("not falls_back"), "query", "left_semi").select(F.col("query").alias("asked_lang"), F.col("doc").alias("doc_id"))
    return narrow.unionByName(whole)


# ---- deduplication, sets, sampling


@query("SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def d1_first_of_each_text(spark, t):
    marks = t("documents").select("doc_id", "source", F.md5("text").alias("m"))
    return D.first_by(marks, ["m"], [F.col("doc_id")]).select("source", "doc_id")


@query("""SELECT doc_id, label, priority FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY priority, label) AS n FROM (
  SELECT doc_id, quality AS label, 0 AS priority FROM labels WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, toxic, 1 FROM labels)) WHERE n = 1""")
def d2_older_label_wins(spark, t):
    old = t("labels").where("doc_id % 3 = 0").select("doc_id", F.col("quality").alias("label"), F.lit(0).alias("priority"))
    new = t("labels").select("doc_id", F.col("toxic").alias("label"), F.lit(1).alias("priority"))
    return D.first_by(old.unionByName(new), ["doc_id"], [F.col("priority"), F.col("label")])


@query("""WITH f AS (SELECT user_id, event_type, min(event_id) AS pos FROM events GROUP BY ALL)
SELECT user_id, event_type, pos AS event_id, row_number() OVER (PARTITION BY user_id ORDER BY pos, event_type) AS rank FROM f QUALIFY rank <= 4""")
def d3_pages_dedup_rerank(spark, t):
    return D.ranked_unique(t("events").select("user_id", "event_type", "event_id"), "user_id", "event_type", [F.col("event_id")], 4)


@query(f"""WITH {B.DENSE}, s AS (SELECT query_id, doc_id, min(struct_pack(l := CASE WHEN channel = 'ip' THEN 0 ELSE 1 END, p := rank)) AS seen FROM ranked GROUP BY ALL)
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY seen, doc_id) AS position FROM s""")
def d4_union_first_seen(spark, t):
    return D.union_first_seen([B.ip_channel(t), B.l2_channel(t)], "query_id", "doc_id", "rank")


@query("SELECT doc_id AS id, text FROM documents UNION ALL SELECT item_id, text FROM benchmark")
def d5_union_all(spark, t):
    return t("documents").select(F.col("doc_id").alias("id"), "text").unionByName(t("benchmark").select(F.col("item_id").alias("id"), "text"))


@query(f"WITH {B.DENSE} SELECT a.query_id, count(*) AS common FROM ip a JOIN l2 b USING (query_id, doc_id) GROUP BY a.query_id")
def d6_intersection(spark, t):
    return B.ip_channel(t).join(B.l2_channel(t).select("query_id", "doc_id"), ["query_id", "doc_id"]).groupBy("query_id").agg(F.count("*").alias("common"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def d7_set_difference(spark, t):
    return D.excluded(t("documents").select("doc_id"), t("labels"), ["doc_id"])


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def d8_semi_filter(spark, t):
    some = t("customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return D.kept(t("orders").select("o_orderkey", "o_custkey"), some, ["o_custkey"]).select("o_orderkey")


@query("SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS labelled FROM documents")
def d9_membership_flag(spark, t):
    return D.flagged(t("documents").select("doc_id"), t("labels"), ["doc_id"], "labelled")


@query("SELECT doc_id, count(*) OVER (PARTITION BY text) > 1 AS duplicated FROM documents")
def d10_duplicate_flag(spark, t):
    marks = t("documents").select("doc_id", F.md5("text").alias("m"))
    return D.shared_flag(marks, "m", "duplicated").select("doc_id", "duplicated")


@query("SELECT n_name, count(DISTINCT c_custkey) AS keys, count(*) AS rows FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name HAVING keys >= 2")
def d11_name_audit(spark, t):
    joined = t("customer").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return D.name_audit(joined, "n_name", "c_custkey")


@query("SELECT doc_id FROM documents ORDER BY md5('0:' || doc_id), doc_id LIMIT 50")
def d12_simple_sample(spark, t):
    return D.sample(t("documents"), "doc_id", 50).select("doc_id")


@query("SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('0:' || doc_id), doc_id) <= 5")
def d13_sample_by_group(spark, t):
    return D.sample_by_group(t("documents").select("source", "doc_id"), "source", "doc_id", 5)


@query("""WITH e AS (SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS old, md5('0:' || doc_id) AS h FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY old ORDER BY h, doc_id) AS n FROM e), c AS (SELECT count(*) AS c FROM labels WHERE doc_id IN (SELECT doc_id FROM documents))
SELECT doc_id, old OR n <= greatest(0, 500 - c) AS in_small, old OR n <= greatest(0, 800 - c) AS in_large FROM r, c""")
def d14_nested_tiers(spark, t):
    marked = D.flagged(t("documents").select("doc_id"), t("labels"), ["doc_id"], "old")
    return D.nested_tiers(marked, "doc_id", F.col("old"), {"in_small": 500, "in_large": 800}).select("doc_id", "in_small", "in_large")


@query("SELECT item_id, ('0x' || substr(md5('0:' || item_id), 1, 8))::BIGINT % 5 AS fold FROM benchmark")
def d15_query_split(spark, t):
    return t("benchmark").select("item_id", D.fold_of("item_id", 5).alias("fold"))


@query()
def d16_noisy_filler(spark, t):
    return D.noisy_copies(B.vectors(t), "doc_id", "vec", 2).select("doc_id", "copy", F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x), 3).alias("size"))


# ---- joins


@query(f"WITH {B.DENSE} SELECT query_id, doc_id, rank, gain FROM ip JOIN graded USING (query_id, doc_id)")
def j1_inner_on_pair(spark, t):
    return B.graded(t).marked(B.ip_channel(t)).where("gain is not null").select("query_id", "doc_id", "rank", "gain")


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_mktsegment = 'MACHINERY'")
def j2_left_metadata(spark, t):
    some = t("customer").where("c_mktsegment = 'MACHINERY'").select("c_custkey", "c_name")
    return t("orders").join(some, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name")


@query(f"""WITH {B.DENSE}, f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, CASE WHEN a.doc_id IS NULL THEN 'right' WHEN b.doc_id IS NULL THEN 'left' ELSE 'both' END AS side
  FROM ip a FULL OUTER JOIN l2 b ON a.query_id = b.query_id AND a.doc_id = b.doc_id)
SELECT query_id, count(*) FILTER (side = 'both') AS both, count(*) FILTER (side = 'left') AS left_only, count(*) FILTER (side = 'right') AS right_only FROM f GROUP BY query_id""")
def j3_full_outer_provenance(spark, t):
    from corvane.operators.joins import compared

    return compared(B.ip_channel(t), B.l2_channel(t), "query_id", "doc_id")


@query(f"WITH {B.DENSE} SELECT a.query_id, a.doc_id, a.rank AS rank_ip, b.rank AS rank_l2, a.rank - b.rank AS moved FROM ip a JOIN l2 b USING (query_id, doc_id)")
def j4_rank_comparison(spark, t):
    b = B.l2_channel(t).select("query_id", "doc_id", F.col("rank").alias("rank_l2"))
    return B.ip_channel(t).select("query_id", "doc_id", F.col("rank").alias("rank_ip")).join(b, ["query_id", "doc_id"]).withColumn("moved", F.col("rank_ip") - F.col("rank_l2"))


@query("SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j5_map_lookup(spark, t):
    n = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return t("supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "r_name")


@query(f"WITH {B.DENSE} SELECT query_id, rank, doc_id, label FROM ip JOIN d USING (doc_id)")
def j6_score_to_metadata(spark, t):
    return B.ip_channel(t).join(B.vectors(t).select("doc_id", "label"), "doc_id").select("query_id", "rank", "doc_id", "label")


@query("SELECT m, k, n_name FROM (SELECT unnest(['ip', 'l2']) AS m), (SELECT unnest([5, 10])::BIGINT AS k), nation")
def j8_evaluation_grid(spark, t):
    grid = spark.createDataFrame([("ip",), ("l2",)], "m string").crossJoin(spark.createDataFrame([(5,), (10,)], "k long"))
    return grid.crossJoin(t("nation").select("n_name"))


@query("SELECT a.r_name AS a, b.r_name AS b FROM region a JOIN region b ON a.r_name < b.r_name")
def j9_self_pairs(spark, t):
    from corvane.operators.fusion import channel_pairs

    return channel_pairs(t("region").select(F.col("r_name").alias("channel")))


@query("SELECT count(*) AS rows, count(DISTINCT doc_id) AS keys FROM labels")
def j10_key_check(spark, t):
    return t("labels").agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("keys"))


@query(f"WITH {B.JUDGES} SELECT doc_id, a, b FROM j WHERE a IS NOT NULL AND b IS NOT NULL")
def j11_pivot_by_reviewer(spark, t):
    from corvane.operators.joins import by_reviewer

    return by_reviewer(B.judged_long(t), ["doc_id"], "judge", "label", ["a", "b"])


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY ALL")
def e31_group_summary(spark, t):
    return t("lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def w1_tumbling_windows(spark, t):
    from corvane.streaming.ingest import windowed

    return windowed(t("events"), "ts", "1 hour", "event_type", "value")


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM s)
SELECT min(ts) AS session_start, max(ts) + INTERVAL '30 minutes' AS session_end, user_id, count(*) AS n FROM g GROUP BY user_id, s""")
def w2_sessions(spark, t):
    from corvane.streaming.ingest import sessions

    return sessions(t("events"), "ts", "user_id", "30 minutes")


@query("SELECT user_id, event_id, coalesce(lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id), -1) AS before FROM events")
def w3_lag(spark, t):
    return t("events").select("user_id", "event_id", F.lag("event_id", 1, -1).over(Window.partitionBy("user_id").orderBy("event_id")).alias("before"))
