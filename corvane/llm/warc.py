r"""Web archives (WARC 1.1): pages written as records in segments, and read back by segment reassembly.

A record is a head of named fields, a block, and two line ends. Spark's text writer puts records out, with the two line ends
as its separator, so that a lost task leaves no half file; its text reader splits archives at the line that opens a record,
so that an archive of any size is read by many tasks, plain or compressed. A response's block is an HTTP answer whose body is
in chunked transfer framing. A block longer than segment_bytes is cut: the first record keeps its type, the others are
continuation records that name the first one, number themselves and, the last one, give the total length.

The opening line may occur within a page. Chunks are therefore cut in the middle of each WARC/1.1 of a body, which no block
then holds. A record of foreign archives whose block is not as long as its head says comes back as damaged, never in part.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.cluster import session_for_texts, written
from corvane.llm.rows import unrolled

# Fixed values of the format.
_OPEN = b"WARC/1.1\r\n"
_END = "\r\n\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = b"2024-01-01T00:00:00Z"

SEGMENT_BYTES, CHUNK_BYTES = 16 << 10, 4 << 10
#: Bytes of records in one Arrow batch that a task makes.
BATCH_BYTES = 8 << 20

RECORD = "record_id string, type string, uri string, page_id long, refers_to string, digest string, number long, origin string, total long, block binary, damage string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_name(page_id: int | None, digest: str) -> bytes:
    """A record's identifier: the same page with the same payload has the same one, so that retried tasks agree."""
    h = hashlib.sha256(f"{'' if page_id is None else page_id}|{digest}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}>".encode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing. Besides every `size` bytes a chunk ends in the middle of each WARC/1.1."""
    cuts = sorted({*range(0, len(payload), size), *(m.start() + 4 for m in re.finditer(rb"WARC/1\.1", payload)), len(payload)} - {0})
    out, at = [], 0
    for cut in cuts:
        out.append(b"%x\r\n%b\r\n" % (cut - at, payload[at:cut]))
        at = cut
    return b"".join(out) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes | None:
    """The payload of a body in chunked framing; chunk extensions and trailers are skipped. None if the framing is broken."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        size = body[at:line].split(b";")[0].strip() if line >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            return None
        n, at = int(size, 16), line + 2
        if n == 0:
            return b"".join(out) if body.endswith(b"\r\n") else None
        if body[at + n : at + n + 2] != b"\r\n":
            return None
        out.append(body[at : at + n])
        at += n + 2


def _clean(text: str) -> bytes:
    """A field's value: control characters, which would end the line, become percent escapes, so does the opening word."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text).replace("WARC/1.1", "WARC%2F1.1").encode("utf-8", "surrogatepass")


def _record(kind: bytes, name: bytes, block: bytes, fields: list[tuple[bytes, bytes]]) -> bytes:
    fields = [(b"WARC-Type", kind), (b"WARC-Record-ID", name), (b"WARC-Date", _DATE), *fields, (b"Content-Type", b"application/http; msgtype=response"), (b"Content-Length", b"%d" % len(block))]
    return _OPEN + b"".join(b"%b: %b\r\n" % f for f in fields) + b"\r\n" + block


def page_records(page_id: int | None, uri: str | None, payload: bytes, digest: str, first_id: int | None, revisit: bool, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> Iterator[bytes]:
    """The records of one page: a revisit, a response, or a response in segments."""
    name = record_name(page_id, digest)
    fields = [(b"WARC-Target-URI", _clean(uri or "")), (b"WARC-Payload-Digest", b"sha1:" + digest.encode())]
    if page_id is not None:
        fields.append((b"Page-ID", b"%d" % page_id))
    if revisit:
        refers = [(b"WARC-Profile", _PROFILE), (b"WARC-Refers-To", record_name(first_id, digest))]
        yield _record(b"revisit", name, _HTTP, fields + refers)
        return
    block = _HTTP + chunked(payload, chunk_bytes)
    if len(block) <= segment_bytes:
        yield _record(b"response", name, block, fields)
        return
    parts = [block[at : at + segment_bytes] for at in range(0, len(block), segment_bytes)]
    for k, part in enumerate(parts, 1):
        segment = [(b"WARC-Segment-Number", b"%d" % k)]
        if k == 1:
            yield _record(b"response", name, part, fields + segment)
            continue
        own = record_name(page_id, f"{digest}/{k}")
        last = [(b"WARC-Segment-Total-Length", b"%d" % len(block))] if k == len(parts) else []
        yield _record(b"continuation", own, part, [*fields[:1], (b"WARC-Segment-Origin-ID", name), *segment, *last])


def _writing(segment_bytes: int, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):  # a row at a time, so that one page's bytes are held at once
                row = {c: batch.column(i)[k].as_py() for i, c in enumerate(batch.schema.names)}
                digest = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
                for record in page_records(row["page_id"], row["uri"], row["payload"] or b"", digest, row["first"], row["revisit"], segment_bytes, chunk_bytes):
                    held.append(record)
                    size += len(record)
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["record"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["record"])

    return run


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, id_col: str = "page_id", uri_col: str = "url", html_col: str = "html", compression: str = "gzip") -> None:
    """Write a record per page to a folder of archives.

    Of pages with equal payloads of at least least_bytes bytes, that with the smallest id is a response and holds the
    payload; the others revisit it. Equal payloads are found by SHA-1 and length, which are combined before they are
    shuffled, and written, so that the join of a payload that many pages share can be split.

    Defined cases: a null html is an empty payload, a null url an empty field. Null ids come after all others. Rows that
    share the smallest id are each a response. An empty table gives archives without records.
    """
    spark = pages.sparkSession
    session_for_texts(spark)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(uri_col).cast("string").alias("uri"), F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("bytes", F.octet_length("payload").cast("long"))
    shared = rows.where(F.col("bytes") >= least_bytes).groupBy("sha1", "bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("pages")).where("pages > 1").select("sha1", "bytes", "first")
    shared = written(spark, shared.withColumn("shared", F.lit(True)), "warc-shared")
    later = F.col("shared").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.join(shared, ["sha1", "bytes"], "left").withColumn("revisit", later).withColumn("payload", F.when(~F.col("revisit"), F.col("payload")))
    records = rows.select("page_id", "uri", "payload", "sha1", "first", "revisit").mapInArrow(_writing(segment_bytes, chunk_bytes), "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.text(path, compression=compression, lineSep=_END)


def _parsed(piece: bytes) -> dict:
    """The record of what follows an opening line."""
    head, found, rest = piece.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n"):
        name, _, value = line.partition(b":")
        fields[name.strip().lower()] = value.strip().decode("utf-8", "surrogatepass")

    def number(name: bytes) -> int | None:
        return int(v) if re.fullmatch(r"-?[0-9]{1,18}", v := fields.get(name, "")) else None

    length = number(b"content-length")
    damage = None if found and length is not None and length >= 0 else "head"
    if not damage and (len(rest) < length or rest[length:].strip(b"\r\n")):
        damage = "length"
    return {
        "record_id": fields.get(b"warc-record-id"), "type": fields.get(b"warc-type"), "uri": fields.get(b"warc-target-uri"), "page_id": number(b"page-id"), "refers_to": fields.get(b"warc-refers-to"),
        "digest": fields.get(b"warc-payload-digest"), "number": number(b"warc-segment-number"), "origin": fields.get(b"warc-segment-origin-id"), "total": number(b"warc-segment-total-length"),
        "block": None if damage else rest[:length], "damage": damage,
    }


def _batches(rows: Iterator[dict], schema: pa.Schema, payload: str) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[payload] or b"") + 500
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    text, long = pa.string(), pa.int64()
    kinds = {"page_id": long, "number": long, "total": long, "block": pa.binary()}
    schema = pa.schema([(c.split()[0], kinds.get(c.split()[0], text)) for c in RECORD.split(", ")])
    yield from _batches((_parsed(piece.as_py()) for batch in batches for piece in batch.column(0)), schema, "block")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of a folder of archives, segments apart: record_id, type, uri, page_id, refers_to, digest, number,
    origin, total, block, damage. damage says what is wrong with a record (`head`, `length`); its block is then null."""
    session_for_texts(spark)
    pieces = spark.read.text(path, lineSep=_OPEN.decode()).where("octet_length(value) > 0")
    return pieces.select(F.col("value").cast("binary").alias("piece")).mapInArrow(_reading, RECORD)


def _decoding(with_payload: bool):
    def decode(row: dict) -> dict:
        damage, payload = row["damage"], None
        if not damage:
            head, _, body = (row["block"] or b"").partition(b"\r\n\r\n")
            framed = any(line.lower().replace(b" ", b"") == b"transfer-encoding:chunked" for line in head.split(b"\r\n"))
            if row["type"] != "revisit":
                payload = dechunked(body) if framed else body
            damage = "framing" if payload is None and row["type"] != "revisit" else None
        digest = base32_sha1(payload) if payload is not None else None
        named = (row["digest"] or "").removeprefix("sha1:")
        if digest and named and digest != named:
            damage = "digest"
        out = {c: row[c] for c in ("record_id", "type", "uri", "page_id", "refers_to")}
        out |= {"payload_bytes": None if payload is None else len(payload), "payload_digest": digest or named or None, "damage": damage, "payload": payload if with_payload else None}
        return out | {"copies": row["copies"]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("uri", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("damage", pa.string()), ("payload", pa.binary()), ("copies", pa.int64())])
        rows = (decode({c: batch.column(i)[k].as_py() for i, c in enumerate(batch.schema.names)}) for batch in batches for k in range(batch.num_rows))
        yield from _batches(rows, schema, "payload")

    return run


def reassembled(records: DataFrame) -> DataFrame:
    """Records with whole blocks, in the columns of read_records and copies.

    Segments are grouped by the record they continue and put in order by number; only they are shuffled, and one group
    is one block. A block is whole if its numbers run from 1 without a gap and the last one gives the total length, which
    the parts add up to; else damage is `segments` and the block null. The same segment met again (the same rows written
    twice, an archive listed twice) counts once; `copies` says how often the record itself came.

    Defined cases: continuations whose first record is missing give a row of type continuation with damage `segments`.
    A damaged segment damages its record.
    """
    single = F.col("number").isNull() & F.col("origin").isNull()
    whole = records.where(single).withColumn("copies", F.lit(1).cast("long"))
    key = F.coalesce("origin", "record_id")
    # each segment once, before the segments of a record meet
    parts = records.where(~single).groupBy(key.alias("key"), F.coalesce("number", F.lit(0).cast("long")).alias("number")).agg(F.first(F.struct("type", "uri", "page_id", "refers_to", "digest", "total", "block", "damage")).alias("r"), F.count("*").alias("n"))
    groups = parts.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("number", "n", "r"))).alias("s"))
    head, last = F.col("s")[0], F.element_at("s", -1)
    length = F.aggregate("s", F.lit(0).cast("long"), lambda t, x: t + F.coalesce(F.octet_length(x["r"]["block"]), F.lit(0)))
    sound = (head["number"] == 1) & (last["number"] == F.size("s")) & (last["r"]["total"] == length) & F.forall("s", lambda x: x["r"]["damage"].isNull())
    # the parts, whose lengths are known, become one value at once
    block = F.unhex(F.array_join(F.transform("s", lambda x: F.hex(x["r"]["block"])), ""))
    joined = groups.withColumn("ok", F.coalesce(sound, F.lit(False))).select(
        F.col("key").alias("record_id"), head["r"]["type"].alias("type"), head["r"]["uri"].alias("uri"), head["r"]["page_id"].alias("page_id"), head["r"]["refers_to"].alias("refers_to"), head["r"]["digest"].alias("digest"),
        F.lit(None).cast("long").alias("number"), F.lit(None).cast("string").alias("origin"), last["r"]["total"].alias("total"), F.when(F.col("ok"), block).alias("block"),
        F.when(~F.col("ok"), F.lit("segments")).alias("damage"), F.when(head["number"] == 1, head["n"]).otherwise(F.lit(1)).cast("long").alias("copies"),
    )
    return whole.unionByName(joined)


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per page record of a folder of archives: record_id, type, uri, page_id, refers_to (the record that a revisit
    names), payload_bytes, payload_digest (base32 SHA-1 of what was read; of a revisit what it says), damage, payload.

    Segments are reassembled and chunked bodies decoded. damage is null for sound records, else `head`, `length`,
    `segments`, `framing` or `digest`: damaged records are reported, not dropped. Without with_payload, payload is null.
    """
    schema = "record_id string, type string, uri string, page_id long, refers_to string, payload_bytes long, payload_digest string, damage string, payload binary, copies long"
    rows = reassembled(read_records(spark, path)).mapInArrow(_decoding(with_payload), schema)
    return unrolled(rows, "copies", "copy").drop("copy", "copies")


def resolved(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: revisits take size and page of what they refer to.

    A revisit whose record is not there has null size and refers_to. What may be referred to is one row per record,
    written, so that the join of a record with very many revisits can be split.
    """
    pages = records.where("type in ('response', 'revisit')")
    pages = written(records.sparkSession, pages.select("record_id", "type", "page_id", "refers_to", "payload_bytes", "payload_digest", "damage"), "warc-read")
    named = pages.where("type = 'revisit'").select(F.col("refers_to").alias("target")).distinct()
    found = pages.where("type = 'response' and damage is null").groupBy(F.col("record_id").alias("target")).agg(F.first(F.struct("page_id", "payload_bytes")).alias("at"))
    found = written(records.sparkSession, found.join(named, "target", "left_semi"), "warc-targets")
    out = ["page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type")]
    own = pages.where("type = 'response'").select(*out, F.lit(None).cast("long").alias("refers_to"))
    later = pages.where("type = 'revisit'").withColumnRenamed("refers_to", "target").drop("payload_bytes").join(found, "target", "left")
    return own.unionByName(later.withColumn("payload_bytes", F.col("at.payload_bytes")).select(*out, F.col("at.page_id").alias("refers_to")))
