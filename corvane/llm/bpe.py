"""Byte-level BPE encoding and decoding of whole texts, with the tokenizers library over Arrow batches.

The merge rules come from a rank file: every split of a token into two tokens of lower rank, in order of the token's
rank. Text is cut into matches of the split pattern; each distinct match of a batch is encoded once by the library, in
which a byte is written as one character (the byte-to-character table), and texts are put together from the matches'
ids. Token offsets follow from the tokens' byte lengths, in bytes and, counting lead bytes, in characters. Decoding
reverses the byte table: tokens become bytes again, and only whole byte strings are read as UTF-8, so a character split
over tokens comes back.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from corvane.llm.cluster import session_for_texts

#: Distinct matches a worker remembers; past it the memory starts afresh. Not a limit on what is encoded.
REMEMBERED = 300_000
#: Matches of one text are taken this many at a time.
SLICE = 200_000

# The printable bytes stand for themselves, the others for the characters from 256 on, in order.
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_TO_CHAR = {b: chr(b) for b in _SELF} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(_SELF))}


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: lines of a base64 token and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """All pairs that merge, best first: whatever two neighbours make a token may merge, the lowest rank before others."""
    pairs = []
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            left, right = ranks.get(token[:k], rank), ranks.get(token[k:], rank)
            if left < rank and right < rank:
                pairs.append((rank, max(left, right), token[:k], token[k:]))
    return [(a, b) for *_, a, b in sorted(pairs)]


def tokenizer_of(ranks: dict[bytes, int]) -> str:
    """The library's tokenizer for one match of the split pattern, serialised."""
    chars = lambda token: "".join(BYTE_TO_CHAR[b] for b in token)
    model = models.BPE(vocab={chars(t): r for t, r in ranks.items()}, merges=[(chars(a), chars(b)) for a, b in merges_of(ranks)])
    made = Tokenizer(model)
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return made.to_str()


class Codec:
    """Encodes and decodes by a serialised tokenizer, its ranks and its split pattern."""

    def __init__(self, serialised: str, ranks: dict[bytes, int], pattern: str) -> None:
        self.tokenizer, self.pattern = Tokenizer.from_str(serialised), regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        size = max(ranks.values(), default=-1) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def _learn(self, matches: set[str]) -> None:
        new = [m for m in matches if m not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list(matches)
        for m, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.known[m] = np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and size < 1_000_000:
                size += len(texts[upto])
                upto += 1
            if size > 8_000_000:
                out += [self._long(t) for t in texts[at:upto]]
            else:
                matches = [self.pattern.findall(t) for t in texts[at:upto]]
                self._learn(set().union(*matches))
                known = self.known
                out += [b"".join([known[m] for m in ms]) for ms in matches]
            at = upto
        return out

    def _long(self, text: str) -> bytes:
        found, out = (m[0] for m in self.pattern.finditer(text)), []
        while part := list(itertools.islice(found, SLICE)):
            self._learn(set(part))
            out.append(b"".join([self.known[m] for m in part]))
        return b"".join(out)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for; an id without a token stands for none."""
        ids = ids[ids < len(self.length)].astype(np.int64)
        length = self.length[ids]
        return self.bytes[np.repeat(self.first[ids] - np.cumsum(length) + length, length) + np.arange(length.sum())].tobytes()

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Start and end of each token in characters (n x 2). A token inside a character starts at it; end counts a
        character once its last byte is in."""
        length = self.length[ids]
        end = np.cumsum(length)
        lead = np.frombuffer(self.decode_bytes(ids), np.uint8) & 0xC0 != 0x80
        begun = np.append(0, np.cumsum(lead))
        whole = np.append(lead, True)
        start = end - length
        return np.stack([begun[start] - (~whole[start]), begun[end] - (~whole[end])], axis=1)


_codecs: dict[int, Codec] = {}


def _codec(sent) -> Codec:
    """A worker keeps the codec, and what it remembers, from task to task."""
    key = sent.value[3]
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(*sent.value[:3])
    return _codecs[key]


def broadcast_codec(spark: SparkSession, rank_file: str, pattern: str):
    """Read on the driver; the vocabulary has a fixed size, so it is safe to broadcast."""
    session_for_texts(spark)
    ranks = read_ranks(rank_file)
    key = hash((rank_file, pattern, len(ranks)))
    return spark.sparkContext.broadcast((tokenizer_of(ranks), ranks, pattern, key))


def encoded(documents: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, ids (array<int>), starts and ends (array<int>, characters). Null texts count as empty: no ids.

    Repeated rows give repeated results, ids may be null, only the named columns are read, and texts are taken whole.
    """
    sent = broadcast_codec(documents.sparkSession, rank_file, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent)
        for batch in batches:
            ids = [np.frombuffer(x, "<u4") for x in codec.encode([t.as_py() or "" for t in batch.column(1)])]
            spans = [codec.offsets(x) for x in ids]
            shape = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.astype(np.int32) for x in ids], shape), pa.array([s[:, 0].astype(np.int32) for s in spans], shape), pa.array([s[:, 1].astype(np.int32) for s in spans], shape)], names=[id_col, "ids", "starts", "ends"])

    rows = documents.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, f"`{id_col}` long, ids array<int>, starts array<int>, ends array<int>")


def decoded(tokens: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id_col and text. Bytes that are no UTF-8 (ids cut within a character) become U+FFFD; null ids, null."""
    sent = broadcast_codec(tokens.sparkSession, rank_file, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent)
        for batch in batches:
            texts = [None if (x := ids.as_py()) is None else codec.decode_bytes(np.array(x, np.int64)).decode("utf-8", "replace") for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return tokens.select(F.col(id_col).cast("long"), F.col(ids_col).cast("array<int>")).mapInArrow(run, f"`{id_col}` long, text string")


def round_trip(documents: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, n_tokens, ids_sha256, decoded_sha256: encoding and decoding in one pass. Cases as in encoded()."""
    sent = broadcast_codec(documents.sparkSession, rank_file, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent)
        for batch in batches:
            ids = codec.encode([t.as_py() or "" for t in batch.column(1)])
            back = [hashlib.sha256(codec.decode_bytes(np.frombuffer(x, "<u4"))).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array(back, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = documents.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string")
