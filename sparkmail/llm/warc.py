"""WARC archives with a Zstandard dictionary.

An archive begins with a skippable frame that embeds the dictionary; each record after it is a frame of its own. Records
with a payload that occurs before (by page id) are revisits of the first one. Files are written by Spark's text writer,
as bytes: the separator between its lines is an empty skippable frame, which Zstandard readers pass over.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmail.llm.common import smallest_hashes

DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
SEPARATOR = struct.pack("<II", 0x184D2A50, 0)
DICTIONARY_BYTES = 1 << 16
SAMPLES, SAMPLE_CHARS = 512, 8192  # records that the dictionary is built from, and how much of each
RECORDS_PER_FILE = 5000
CHUNK = 1 << 16
DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:page:"


def _line(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object = None,
           revisit: bool = False, date: str = DATE) -> bytes:
    """One WARC record. A revisit has the HTTP header only; its Content-Length tells the payload's size."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{URN}{'' if refers_to is None else refers_to}>"]
    else:
        block += payload
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def build_dictionary(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> bytes:
    """A dictionary from SAMPLES records, those whose ids have the smallest hashes; empty for an empty table."""
    cut = pages.select(id_col, url_col, F.substring(html_col, 1, SAMPLE_CHARS).alias("html"))
    rows = smallest_hashes(cut, SAMPLES, id_col, url_col).collect()
    payloads = [(r["html"] or "").encode() for r in rows]
    samples = [record(r[0], r[1], p, _digest(p)) for r, p in zip(rows, payloads)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too little to train on: the records themselves are the dictionary
        return b"".join(samples)[:DICTIONARY_BYTES]


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _plan(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int) -> DataFrame:
    """id, url, payload, revisit, refers_to: equal payloads of at least `least` bytes revisit the smallest id.

    Of rows with the same id and payload one is the response. Null ids come last.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(html_col, F.lit("")).alias("payload"), F.monotonically_increasing_id().alias("place")) \
        .withColumn("sha", F.unhex(F.sha1("payload")))
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "place")
    first = rows.where(F.octet_length("payload") >= least).groupBy("sha").agg(F.min(rank).alias("first"))
    joined = rows.join(first, "sha", "left")
    again = (F.octet_length("payload") >= least) & (F.col("first.place") != F.col("place"))
    return joined.select("id", "url", "payload", F.coalesce(again, F.lit(False)).alias("revisit"),
                         F.col("first.id").alias("refers_to"))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
          least: int = 0, records_per_file: int = RECORDS_PER_FILE, level: int = 3) -> None:
    """Write a record for each row to archives in the folder `path`, of records_per_file records at most.

    Null html is an empty payload, a null url gives no target. An empty table writes no archive. Other columns are
    not read.
    """
    dictionary = build_dictionary(pages, id_col, url_col, html_col)

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level, dict_data=known)
        lead = struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary
        count = 0
        for batch in batches:
            out = []
            for page_id, url, payload, revisit, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if count % records_per_file == 0:
                    out.append(lead)
                raw = payload.encode("utf-8", "surrogatepass")
                out.append(packer.compress(record(page_id, url, raw, _digest(raw), refers_to, revisit)))
                count += 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    planned = _plan(pages, id_col, url_col, html_col, least)
    planned.mapInArrow(frames, "value binary").select(F.col("value").cast("string")) \
        .write.option("lineSep", SEPARATOR.decode("latin-1")).option("maxRecordsPerFile", records_per_file + 1).text(path)


def frames_of(archive: bytes) -> Iterator[bytes]:
    """The records of one archive, decompressed one by one."""
    view, at, unpacker = memoryview(archive), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        magic, size = struct.unpack_from("<II", view, at) if at + 8 <= len(view) else (0, 0)
        if magic in SKIPPABLE:
            if magic == DICTIONARY_MAGIC:
                known = zstandard.ZstdCompressionDict(bytes(view[at + 8:at + 8 + size]))
                unpacker = zstandard.ZstdDecompressor(dict_data=known)
            at += 8 + size
            continue
        frame, parts = unpacker.decompressobj(), []
        while not frame.eof:
            if at >= len(view):
                raise ValueError("the archive ends inside a record")
            parts.append(frame.decompress(view[at:at + CHUNK]))
            at += min(CHUNK, len(view) - at) - len(frame.unused_data)
        yield b"".join(parts)


def parse(raw: bytes) -> dict:
    """Headers and block of one record; the digest of a response is computed from its payload and compared."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    told = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or _digest(payload) != told):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    ids = [fields[k].strip("<>").removeprefix(URN) or None if k in fields else None for k in ("WARC-Record-ID", "WARC-Refers-To")]
    return {"id": ids[0], "url": fields.get("WARC-Target-URI"), "payload_bytes": length, "payload_digest": told,
            "record_type": kind, "refers_to": ids[1], "payload": payload if kind == "response" else None}


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row per record of the archives in a folder: id (as text), url, payload_bytes, payload_digest, record_type,
    refers_to (as text), and the payload of responses if asked for. A damaged record fails the job."""
    schema = T.StructType.fromDDL("id string, url string, payload_bytes long, payload_digest string, record_type string, "
                                  "refers_to string" + ", payload binary" * payloads)
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0):
                rows, size = [], 0
                for raw in frames_of(archive.as_py()):
                    rows.append(parse(raw))
                    size += len(raw) if payloads else 200
                    if size > 1 << 24:
                        yield _table(rows)
                        rows, size = [], 0
                yield _table(rows)

    def _table(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], t) for f, t in zip(schema, types)],
                                          names=schema.names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(records, schema)
