"""The queries op1..op10, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.ann import nearest
from corvane.llm.bpe import round_trip
from corvane.llm.chat import CONTROLS, digests, formatted
from corvane.llm.cluster import scratch
from corvane.llm.jaccard import jaccard_components
from corvane.llm.neardup import near_duplicates
from corvane.llm.packing import packed
from corvane.llm.pii import pii_spans
from corvane.llm.quality import quality
from corvane.llm.resampling import BUCKETS, MIN_WORDS, PERCENT, SEED, resampled
from corvane.llm.sharding import BUCKET_ROWS, MULTIPLIER, sharded
from corvane.llm.toxicity import toxicity
from corvane.llm.warc import read_warc, resolved, write_warc
from corvane.llm.whitening import whitened

#: Scores from which a document counts as toxic, and as good.
TOXIC_FROM, GOOD_FROM = 0.3, 0.5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str, of: int) -> Column:
    """crc32 of an id as text, modulo the number of folds."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % of


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    score = toxicity(docs, table(spark, sf_dir, "labels"), train_where=fold("id", 4) != 2)
    out = docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), score(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= TOXIC_FROM).cast("int"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return digests(formatted(talks.unionByName(extra)))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SHARDS = 24


def op7_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"), SHARDS)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    score = quality(docs, table(spark, sf_dir, "labels"), train_where=fold("id", 3) != 1)
    out = docs.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), score(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= GOOD_FROM).cast("int"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_warc_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "archives")
    write_warc(table(spark, sf_dir, "pages"), path)
    return resolved(read_warc(spark, path, with_payload=False))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_toxicity, op2_best_fit_packing, op3_byte_bpe, op4_chat_formatting, op5_ngram_jaccard_join, op6_embedding_near_dedup, op7_jump_sharding, op8_pii, op9_quality_classifier, op10_nearest_neighbours,
        op11_embedding_whitening, op12_importance_resampling, op13_warc_reassembly,
    )
    return {f.__name__: f for f in every}


def _escaped_sql(column: str) -> str:
    out = f"replace({column}, '~', '~0')"
    for k, control in enumerate(CONTROLS, 1):
        out = f"replace({out}, '{control}', '~{k}')"
    return out


_CHAT_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), r AS (
  SELECT *, CASE WHEN {" OR ".join(f"contains(role, '{c}') OR contains(text, '{c}')" for c in CONTROLS)}
    THEN 14 + length({_escaped_sql("role")}) + 7 + length({_escaped_sql("text")}) + 4
    ELSE 9 + length(role) + 7 + length(text) + 4 END AS chars FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM r GROUP BY conv_id"""

_WRAP = 1 << 64
_SHARD_SQL = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, (coalesce(strlen(text), 0) + 8)::BIGINT AS size, coalesce(text, '') AS text,
    (CASE WHEN coalesce(doc_id, 0) < 0 THEN doc_id::HUGEINT + {_WRAP} ELSE coalesce(doc_id, 0) END)::UHUGEINT AS key
  FROM documents
), keys AS (SELECT DISTINCT key AS k0 FROM sized),
jumps(k0, key, spot, shard, grown, step) AS (
  SELECT k0, k0, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0 FROM keys
  UNION ALL
  SELECT k0, (key * {MULTIPLIER}::UHUGEINT + 1) % {_WRAP}::UHUGEINT,
    floor((spot + 1)::DOUBLE * (2147483648.0::DOUBLE / ((((key * {MULTIPLIER}::UHUGEINT + 1) % {_WRAP}::UHUGEINT) // 8589934592::UHUGEINT + 1)::DOUBLE)))::BIGINT,
    CASE WHEN spot < {SHARDS} THEN spot ELSE shard END, spot, step + 1
  FROM jumps WHERE spot <= {SHARDS}
), ends AS (SELECT k0, max_by(shard, step) AS shard, max_by(grown, step) AS grown FROM jumps GROUP BY k0),
crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS crcs
  FROM (SELECT unnest(range(256)) AS i)
), bytes AS (
  SELECT text, list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: (strpos('0123456789ABCDEF', x[1]) - 1) * 16 + strpos('0123456789ABCDEF', x[2]) - 1)) AS b
  FROM (SELECT DISTINCT text FROM sized)
), crc AS (
  SELECT text, xor(list_reduce(b, lambda c, x: xor(c >> 8, crcs[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM bytes, crc_table
), placed AS (
  SELECT doc_id, size, text_crc32, shard, grown,
    (((xor(xor(key::UBIGINT, (text_crc32::UBIGINT << 21)), size::UBIGINT)::UHUGEINT * {MULTIPLIER}::UHUGEINT + 1) % {_WRAP}::UHUGEINT) // 4294967296::UHUGEINT) % greatest(1, ceil((SELECT count(*) FROM documents) / {BUCKET_ROWS * SHARDS}.0))::UHUGEINT AS bucket
  FROM sized JOIN ends ON key = k0 JOIN crc USING (text)
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown::INTEGER AS grown_shard
FROM placed"""


_JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words
), element AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM element a JOIN element b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), links AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reached(id, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT y, m FROM reached JOIN links ON id = x AND m < y)
SELECT doc_id, len(s) AS n_shingles, component_id FROM sets JOIN (SELECT id, min(m) AS component_id FROM reached GROUP BY id) ON id = doc_id"""

_NEAR_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0
), links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a, v b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
reached(id, m) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT y, m FROM reached JOIN links ON id = x AND m < y)
SELECT id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, min(m) AS component_id, id = min(m) AS kept
FROM reached LEFT JOIN (SELECT x, count(*) AS n FROM links GROUP BY x) ON id = x GROUP BY id, n"""


_CRC_TABLE = "crc_table AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS crcs FROM (SELECT unnest(range(256)) AS i))"


def _crc_sql(text: str) -> str:
    """crc32 of a string's UTF-8 bytes, with crc_table in reach."""
    digits = f"regexp_extract_all(hex(encode({text})), '..')"
    value = "(strpos('0123456789ABCDEF', h[1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2]) - 1"
    codes = f"list_prepend(4294967295::BIGINT, list_transform({digits}, lambda h: {value}))"
    return f"xor(list_reduce({codes}, lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295)"


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_RESAMPLING_SQL = f"""
WITH {_CRC_TABLE}, d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, unnest(w) AS word FROM d), bw AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
known AS (SELECT word, {_crc_sql("word")} % {BUCKETS} AS bucket FROM (SELECT word FROM dw UNION SELECT word FROM bw), crc_table),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN known USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN known USING (word) GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + {BUCKETS})::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bw) + {BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM (SELECT DISTINCT bucket FROM known) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)
), weighed AS (SELECT doc_id, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM dw JOIN known USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
hashed AS (SELECT doc_id, list_reduce(list_prepend(0::BIGINT, list_transform(regexp_extract_all(sha256('{SEED}:' || doc_id)[1:8], '.'), lambda c: strpos('0123456789abcdef', c)::BIGINT - 1)), lambda a, b: a * 16 + b) AS h FROM d),
scored AS (
  SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN weighed USING (doc_id) JOIN hashed USING (doc_id)
), ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= {MIN_WORDS})
SELECT scored.*, rank FROM scored LEFT JOIN (SELECT * FROM ranked WHERE rank <= (SELECT count(*) FROM scored WHERE n_features >= {MIN_WORDS}) * {PERCENT} // 100) USING (doc_id)"""

_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
h AS (SELECT *, upper(sha1(payload)) AS h, min(page_id) OVER (PARTITION BY payload) AS first FROM p),
part AS (SELECT *, list_transform(range(4), lambda k: list_reduce(list_prepend(0::BIGINT, list_transform(regexp_extract_all(h[10 * k + 1:10 * k + 10], '.'), lambda c: strpos('0123456789ABCDEF', c)::BIGINT - 1)), lambda a, b: a * 16 + b)) AS forty FROM h)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((forty[i // 8 + 1] >> (35 - 5 * (i % 8))) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM part"""


def oracle_sql() -> dict[str, str]:
    return {
        "op5_ngram_jaccard_join": _JACCARD_SQL, "op6_embedding_near_dedup": _NEAR_SQL, "op4_chat_formatting": _CHAT_SQL, "op7_jump_sharding": _SHARD_SQL,
        "op12_importance_resampling": _RESAMPLING_SQL, "op13_warc_reassembly": _WARC_SQL,
    }
