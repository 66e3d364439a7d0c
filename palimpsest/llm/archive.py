"""WARC archives in Zstandard: one frame per record, a dictionary in the leading skippable frame.

A file is a skippable frame (magic 0x184D2A5D) with the dictionary, then a frame
for each record, and an empty skippable frame (magic 0x184D2A50, length 0) at the
end, which every Zstandard reader passes over. A task gathers frames up to
FILE_BYTES and hands them on as one row, which Spark's own text writer writes as
one file, with the empty frame as line separator (its eight bytes are ASCII). Files
thus have a bounded size, go through Spark's committer to any file system that
Spark reaches, and a lost executor's task is written anew. Their content is that of
.warc.zst files; Spark's writer names them part-*.txt.

Of records with equal payloads of at least `min_revisit_bytes` bytes, that with
the smallest page_id is a response; the others are revisits that refer to it and
hold only the HTTP header, whose Content-Length is the full payload's.

Defined results: a null payload is empty. Null ids come last: where all ids of a
payload are null, each is a response. Repeated rows with the smallest id are all
responses. Extra columns are ignored. An empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Scratch, table
from .textkit import utf8

DICT_MAGIC, PAD_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0x184D2A50, 0xFD2FB528
#: The empty skippable frame between frames.
SEPARATOR = struct.pack("<II", PAD_MAGIC, 0)
LEVEL = 3
#: Bounds of the sample that the dictionary is trained on, and of the dictionary.
SAMPLE_ROWS, SAMPLE_BYTES, DICT_BYTES = 256, 2048, 16 << 10
#: Compressed bytes after which an archive file ends; it is longer by one record at most.
FILE_BYTES = 32 << 20
#: Repeated payloads up to which their digests (20 bytes each) are broadcast to the pages; beyond it, pages are shuffled by digest once.
BROADCAST_DIGESTS = 500_000
#: Bytes given to the decoder at a time, and decoded bytes gathered for a batch.
STEP_BYTES, BATCH_BYTES = 8 << 10, 4 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class ArchiveError(ValueError):
    """A record or file that breaks the format."""


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id, url: str | None, payload: bytes, digest: str, refers_to=None) -> bytes:
    """One WARC/1.1 record; a revisit if refers_to is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{payload_digest(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise ArchiveError(f"no header field: {line[:80]!r}")
        fields[name.strip().decode().lower()] = value.strip().decode()
    return fields


def parse_record(data: bytes) -> dict:
    """Fields and payload of one record; raises where version, lengths or digests don't hold."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"WARC/1."):
        raise ArchiveError("no WARC header")
    fields = _fields(head)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ArchiveError(f"{name} is missing")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ArchiveError(f"Content-Length is {length}, the block has {len(rest) - 4} bytes")
    block = rest[:length]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != "sha1:" + payload_digest(block):
        raise ArchiveError("the block's digest differs")
    http, gap, body = block.partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/"):
        raise ArchiveError("no HTTP header")
    size, kind = int(_fields(http)["content-length"]), fields["warc-type"]
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response":
        if len(body) != size:
            raise ArchiveError(f"the payload has {len(body)} bytes of {size}")
        if digest != payload_digest(body):
            raise ArchiveError("the payload's digest differs")
    elif kind != "revisit" or body or "warc-refers-to" not in fields:
        raise ArchiveError(f"no valid {kind} record")
    url = fields.get("warc-target-uri")
    return {
        "record_id": fields["warc-record-id"], "type": kind, "refers_to": fields.get("warc-refers-to"), "payload_bytes": size, "payload_digest": digest,
        "url": None if url is None else url.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%"), "payload": body if kind == "response" else None,
    }


def dictionary_frame(raw: bytes) -> bytes:
    return struct.pack("<II", DICT_MAGIC, len(raw)) + raw


def read_archive(data: bytes):
    """Decoded bytes of each record frame. The file's first frame has to hold the dictionary."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != DICT_MAGIC:
        raise ArchiveError("no dictionary frame")
    size = struct.unpack_from("<I", data, 4)[0]
    if 8 + size > len(data):
        raise ArchiveError("the dictionary is cut off")
    raw, at = data[8 : 8 + size], 8 + size
    options = {"dict_data": zstandard.ZstdCompressionDict(raw)} if raw else {}
    decoder = zstandard.ZstdDecompressor(**options)
    view = memoryview(data)
    while at < len(data):
        if len(data) - at < 8:
            raise ArchiveError("bytes after the last frame")
        magic, length = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == PAD_MAGIC:
            at += 8 + length
            if at > len(data):
                raise ArchiveError("a skippable frame is cut off")
        elif magic == FRAME_MAGIC:
            frame, parts = decoder.decompressobj(), []
            try:
                while not frame.eof and at < len(data):  # small steps: what a step leaves unused is copied
                    step = view[at : at + STEP_BYTES]
                    parts.append(frame.decompress(step))
                    at += len(step)
            except zstandard.ZstdError as e:
                raise ArchiveError(str(e)) from e
            if not frame.eof:
                raise ArchiveError("a frame is cut off")
            at -= len(frame.unused_data)
            yield b"".join(parts)
        else:
            raise ArchiveError(f"unknown magic {magic:#x}")


def train_dictionary(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> bytes:
    """Dictionary from at most SAMPLE_ROWS payloads, of each at most SAMPLE_BYTES; empty if they are too few.

    Rows are chosen by a hash of the id, so that tasks send ids alone to be ranked.
    """
    ids = pages.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("chosen"), F.xxhash64(id_col).alias("h")).orderBy("h", "chosen").limit(SAMPLE_ROWS).select("chosen").distinct()
    texts = pages.join(F.broadcast(ids), F.col(id_col) == F.col("chosen"), "left_semi").select(F.substring(payload_col, 1, SAMPLE_BYTES).alias("p")).where("length(p) > 0")
    samples = sorted(r["p"].encode() for r in texts.distinct().limit(SAMPLE_ROWS).collect())
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def _files(raw: bytes, file_bytes: int):
    def run(batches):
        options = {"dict_data": zstandard.ZstdCompressionDict(raw)} if raw else {}
        packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, **options)
        parts, held = [dictionary_frame(raw)], 0

        def file():
            return pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["file"])

        for batch in batches:
            for page_id, url, payload, refers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), batch.column(3).to_pylist()):
                payload = payload or b""
                parts.append(packer.compress(record_bytes(page_id, url, payload, payload_digest(payload), refers)))
                held += len(parts[-1])
                if held >= file_bytes:
                    yield file()
                    parts, held = [dictionary_frame(raw)], 0
        if held:
            yield file()

    return run


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0, file_bytes: int = FILE_BYTES, broadcast_digests: int = BROADCAST_DIGESTS) -> None:
    """Write a record for each row of pages to files below path."""
    raw = train_dictionary(pages, id_col, payload_col)
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(payload_col, F.lit("")).alias("payload"))
    keyed = slim.withColumn("digest", F.unhex(F.sha1(F.col("payload").cast("binary"))))
    firsts = keyed.where(F.octet_length("payload") >= min_revisit_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    scratch = Scratch(pages.sparkSession, "revisits")
    firsts = scratch.keep(firsts, "firsts", small=True)
    given = F.broadcast(firsts) if firsts.count() <= broadcast_digests else firsts
    refers = F.when(F.col("page_id") == F.col("first"), None).otherwise(F.col("first"))
    records = keyed.join(given, "digest", "left").select("page_id", "url", "payload", refers.alias("refers_to"))
    files = records.mapInArrow(_files(raw, file_bytes), "file binary").select(F.col("file").cast("string").alias("value"))
    files.write.option("lineSep", SEPARATOR.decode("ascii")).option("maxRecordsPerFile", 1).option("compression", "none").text(path)
    scratch.drop(firsts)


def _records(with_payload: bool):
    names = ["record_id", "type", "refers_to", "payload_bytes", "payload_digest", "url", *["payload"] * with_payload]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), *[pa.binary()] * with_payload]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names)

    def run(batches):
        for files in batches:
            for k in range(files.num_rows):
                rows, held = [], 0
                for data in read_archive(files.column(0)[k].as_py()):
                    record = parse_record(data)
                    held += 256
                    if with_payload:
                        held += len(data)
                    else:
                        del record["payload"]
                    rows.append(record)
                    if held > BATCH_BYTES:
                        yield batch(rows)
                        rows, held = [], 0
                yield batch(rows)

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Validated records of the archives below path; payload (if asked for) is null in revisits."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    schema = "record_id string, type string, refers_to string, payload_bytes long, payload_digest string, url string"
    return files.mapInArrow(_records(with_payload), schema + ", payload binary" * with_payload)


def op9_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "archive").path("warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    number = lambda c: F.nullif(F.regexp_extract(c, "^<urn:page:(-?[0-9]*)>$", 1), F.lit("")).cast("long")
    return read_archives(spark, path, with_payload=False).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), number("refers_to").alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS x FROM p),
f AS (SELECT x, min(page_id) AS first FROM d GROUP BY x),
b AS (SELECT x, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(x, 1 + (5 * i) // 4, 2) || CASE WHEN (5 * i) // 4 = 39 THEN '0' ELSE '' END AS INTEGER) >> (3 - (5 * i) % 4)) & 31 AS INTEGER), 1), '' ORDER BY i) AS digest
      FROM f, (SELECT unnest(range(0, 32)) AS i) GROUP BY x)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d JOIN f USING (x) JOIN b USING (x)
"""
