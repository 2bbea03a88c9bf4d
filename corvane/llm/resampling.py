"""Importance resampling towards a target distribution, over hashed word n-grams.

The bucket of an n-gram is the crc32 of its words joined by one space. Words are hashed once; the checksum of a longer run
follows from theirs, as the checksum of A + B is that of A, shifted by B's length, xor that of B. The shift by one byte is a
linear map over GF(2), a 32 x 32 matrix of bits; its powers 2^k, squared one from another, shift by any length in as many
steps as the length has bits. So no n-gram string is ever made. Texts are read twice, where they lie: once for the counts of
buckets, which combine before they are shuffled, once for the mean gain of each document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.cluster import session_for_texts, written
from corvane.llm.rows import unrolled

BUCKETS, SEED, MIN_WORDS, PERCENT = 10_000, 2024, 20, 10
#: Bytes of text taken apart at a time; a longer text is taken alone.
SLICE_BYTES = 4 << 20
_POLYNOMIAL = 0xEDB88320  # fixed value: crc32, reversed

# which bytes are part of a word, after A-Z are lower-cased: 0-9, a-z and all that is not ASCII
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Matrix (32 columns, each a uint32) times vectors of 32 bits, over GF(2)."""
    out = np.zeros_like(vector)
    for bit in range(32):
        out ^= np.where(vector >> np.uint32(bit) & np.uint32(1), matrix[bit], np.uint32(0))
    return out


def _shift_matrices(count: int) -> list[np.ndarray]:
    """The matrices that shift a checksum by 2^k bytes of zeros."""
    one_bit = np.array([_POLYNOMIAL, *(1 << k for k in range(31))], np.uint32)
    one_byte = one_bit
    for _ in range(3):
        one_byte = _times(one_byte, one_byte)
    out = [one_byte]
    while len(out) < count:
        out.append(_times(out[-1], out[-1]))
    return out


_SHIFTS = _shift_matrices(40)
#: Each matrix as four tables, one for each byte of the checksum: a shift is then four lookups.
_TABLES = [[_times(m, np.arange(256, dtype=np.uint32) << np.uint32(8 * byte)) for byte in range(4)] for m in _SHIFTS]
_SPACE = np.uint32(zlib.crc32(b" "))


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Checksums (uint32) as they enter the checksum of a text that goes on for `length` bytes."""
    out, left, k = crc.copy(), np.asarray(length, np.int64).copy(), 0
    while len(left) and left.any():
        odd = np.flatnonzero(left & 1)
        if len(odd):
            c = out[odd]
            out[odd] = _TABLES[k][0][c & 255] ^ _TABLES[k][1][c >> 8 & 255] ^ _TABLES[k][2][c >> 16 & 255] ^ _TABLES[k][3][c >> 24]
        left >>= 1
        k += 1
    return out


def joined(crc: np.ndarray, next_crc: np.ndarray, next_length: np.ndarray) -> np.ndarray:
    """The checksum of a text, a space and the next word, from the checksums of both."""
    spaced = shifted(crc, np.ones(len(crc), np.int64)) ^ _SPACE
    return shifted(spaced, next_length) ^ next_crc


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, crc32 and byte length of each word, in order."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    if offsets[0] == offsets[-1]:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
    data = _LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    inside = _WORD[data]
    starts_text = np.zeros(len(data) + 1, bool)
    starts_text[offsets] = True
    starts_text = starts_text[:-1]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    text_ends = np.empty_like(inside)
    text_ends[-1], text_ends[:-1] = True, starts_text[1:]
    first = np.flatnonzero(inside & (~before | starts_text))
    end = np.flatnonzero(inside & (~after | text_ends)) + 1
    length = end - first
    row = np.searchsorted(offsets, first, side="right") - 1
    spots = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(spots), pa.py_buffer(np.ascontiguousarray(data[inside]))])
    coded = words.dictionary_encode()
    crc = np.array([zlib.crc32(w) for w in coded.dictionary.to_pylist()], np.uint32)
    return row, crc[coded.indices.to_numpy()] if len(crc) else crc, length


def features(texts: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of each text; and (row, bucket) of each run of 1 to `longest` words."""
    row, crc, length = _words(texts)
    rows, found, run = [row], [crc], crc
    for n in range(2, longest + 1):
        here = np.flatnonzero(row[n - 1 :] == row[: len(row) - n + 1]) if len(row) >= n else np.zeros(0, np.int64)
        whole = np.zeros(len(crc), np.uint32)
        whole[here] = joined(run[here], crc[here + n - 1], length[here + n - 1])
        run = whole
        rows.append(row[here])
        found.append(run[here])
    return np.bincount(row, minlength=len(texts)), np.concatenate(rows), (np.concatenate(found) % np.uint32(buckets)).astype(np.int64)


def _slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Neighbouring rows of at most SLICE_BYTES, or one row; nulls become empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    ends = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE_BYTES, side="right")) - 1)
        yield at, texts.slice(at, to - at)
        at = to


def _counting(longest: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts in _slices(batch.column(0)):
                total += np.bincount(features(texts, longest, buckets)[2], minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, text_col: str = "text", longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how often each bucket occurs in all texts. A task sends `buckets` rows at most."""
    session_for_texts(texts.sparkSession)
    counts = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_counting(longest, buckets), "bucket long, n long")
    return counts.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(documents: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text", longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """For each bucket floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))): how much likelier it is in the target."""
    sides = []
    for df, col in ((documents, text_col), (target, target_col)):
        counts = np.zeros(buckets, np.int64)
        for r in bucket_counts(df, col, longest, buckets).collect():  # a row for each bucket at most
            counts[r["bucket"]] = r["n"]
        sides.append(counts)
    s, t = (c.astype(float) for c in sides)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def _weighing(sent, longest: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = sent.value
        for batch in batches:
            parts = []
            for at, texts in _slices(batch.column(1)):
                words, row, bucket = features(texts, longest, buckets)
                n = np.bincount(row, minlength=len(texts))
                total = np.bincount(row, gains[bucket], len(texts)).astype(np.int64)  # whole numbers far below 2^53
                parts.append((words, n, np.floor_divide(total, np.maximum(n, 1))))
            if parts:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*parts, strict=True))], names=["id", "words", "n_features", "weight"])

    return run


def noise(id_text: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from a hash of seed and id that any engine can repeat."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_text), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resampled(
    documents: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS, seed: int = SEED, min_words: int = MIN_WORDS, percent: int = PERCENT,
    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """One row per document: id_col, n_features, weight, score, rank; rank is null for documents that are not drawn.

    Drawn are, of the documents with at least min_words words, the share `percent` with the highest scores; scores are the
    floored mean gain of a document plus Gumbel noise, which makes the draw one without replacement in proportion to
    exp(weight / 1000). Ranks go by score, then id, and need no sort of the whole table: the scores are whole numbers of a
    bounded range, whose counts give each score's first rank; within a score documents go by id.

    Defined cases: null and empty texts have no features and weight 0, and are drawn only if min_words is 0. A null id
    counts as an empty string in the hash and comes last among ties. Repeated rows are drawn apart, with ranks in a row;
    rows with the same id, score, features and weight are counted, not moved, and unrolled in arrays of bounded length. An
    empty target, or empty documents, are a distribution without counts. An empty table gives no rows. Only the named columns are read.
    """
    spark = documents.sparkSession
    gains = spark.sparkContext.broadcast(bucket_gains(documents, target, text_col, target_col, longest, buckets))
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.mapInArrow(_weighing(gains, longest, buckets), "id long, words long, n_features long, weight long")
    score = F.col("weight") + noise(F.coalesce(F.col("id").cast("string"), F.lit("")), seed)
    rows = rows.select("id", "n_features", "weight", score.alias("score"), (F.col("words") >= min_words).alias("fit"))
    rows = written(spark, rows.groupBy("id", "n_features", "weight", "score", "fit").agg(F.count("*").alias("n")), "resampling-scores")
    room = (rows.where("fit").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"] * percent) // 100
    # a row for each score, of which there are as many as thousandths in the range of gains and noise
    upto = Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = rows.where("fit").groupBy("score").agg(F.sum("n").alias("of_score"))
    first = counts.select("score", (F.sum("of_score").over(upto) - F.col("of_score")).alias("base"))
    first = written(spark, first.where(F.col("base") < room), "resampling-ranks")
    # joined and numbered by the same key: one shuffle of narrow rows
    within = Window.partitionBy("score", "fit").orderBy(F.col("id").asc_nulls_last(), "n_features", "weight").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(first.withColumn("fit", F.lit(True)), ["score", "fit"], "left").withColumn("from", F.col("base") + F.coalesce(F.sum("n").over(within), F.lit(0)) + 1)
    drawn = F.coalesce(F.greatest(F.lit(0), F.least(F.col("n"), room + 1 - F.col("from"))), F.lit(0))
    parts = F.array(F.struct(F.col("from").alias("from"), drawn.alias("of")), F.struct(F.lit(None).cast("long").alias("from"), (F.col("n") - drawn).alias("of")))
    out = unrolled(placed.select("id", "n_features", "weight", "score", F.inline(parts)), "of", "at").withColumn("rank", F.col("from") + F.col("at"))
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
