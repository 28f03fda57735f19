"""WARC archives: a writer and a sequential reader.

Each record is one gzip member. Members are packed to files of bounded bytes, and
Spark's text writer lays each pack down, so that attempts, retries and commits
are Spark's own and any Hadoop file system will do. That writer ends each value
with a separator; the last byte of a member is the high byte of its length field,
0 for records under 16 MB, so the separator is that byte and the value comes
without it. A larger last member keeps its last byte and is followed by one zero
byte of padding, which the reader skips.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import scratch_path, settled

MIN_REVISIT_BYTES = 100
#: Bytes of members in one archive file, unless one member alone has more; bounds what a reading task holds.
FILE_BYTES = 64 << 20
_DATE = "2024-01-01T00:00:00Z"

_MEMBERS = pa.schema([("member", pa.string())])
_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string"


def gzip_member(data: bytes) -> bytes:
    """The bytes as one gzip member."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 record; a revisit (refers_to is set) has no block."""
    revisit = refers_to is not None
    block = b"" if revisit else payload
    uri = " ".join((url or "").split())
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: text/html", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _packs(file_bytes: int):
    """Members, packed to values of file_bytes or of one larger member; each value becomes a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to")), strict=True):
                payload = (html.as_py() or "").encode()
                member = gzip_member(record_bytes(page_id.as_py(), url.as_py(), payload, hashlib.sha256(payload).hexdigest(), refers_to.as_py()))
                if held and size + len(member) > file_bytes:
                    yield _as_text(b"".join(held))
                    held, size = [], 0
                held.append(member)
                size += len(member)
        if held:
            yield _as_text(b"".join(held))

    return run


def _as_text(members: bytes) -> pa.RecordBatch:
    """Raw bytes in a string column: the text writer copies them as they are, and adds the last byte if that is 0."""
    raw = pa.array([members[:-1] if members[-1] == 0 else members], pa.binary())
    return pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.string(), 1, raw.buffers())], schema=_MEMBERS)


def write_warc(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Write a record per row of (page_id, url, html, refers_to) to gzip archives under ``path``."""
    packs = pages.select("page_id", "url", "html", "refers_to").mapInArrow(_packs(file_bytes), "member string")
    packs.write.option("lineSep", "\u0000").option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def read_records(data: bytes, step: int = 1 << 16) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of one archive, in order.

    Members are inflated step by step; the headers end at the first empty line,
    Content-Length frames the block, and what follows must be two line ends.
    A cut member, a wrong frame or a wrong block digest raises ValueError.
    """
    view, at = memoryview(data), 0
    while at < len(view):
        if view[at] == 0:  # padding
            at += 1
            continue
        inflater, parts = zlib.decompressobj(31), []
        while not inflater.eof:
            if at >= len(view):
                raise ValueError("the archive ends inside a member")
            chunk = view[at : at + step]
            parts.append(inflater.decompress(chunk))
            at += len(chunk) - len(inflater.unused_data)
        record = b"".join(parts)
        end = record.find(b"\r\n\r\n")
        if end < 0 or not record.startswith(b"WARC/1."):
            raise ValueError("a member holds no WARC record")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in record[:end].decode().split("\r\n")[1:])
        length = int(headers["Content-Length"])
        block = record[end + 4 : end + 4 + length]
        if len(block) != length or record[end + 4 + length :] != b"\r\n\r\n":
            raise ValueError("Content-Length does not frame the record")
        if headers["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
            raise ValueError("the block does not have its digest")
        if headers["WARC-Type"] == "response" and headers["WARC-Payload-Digest"] != headers["WARC-Block-Digest"]:
            raise ValueError("the payload does not have its digest")
        yield headers, block


def _urn(value: str | None) -> int | None:
    inner = (value or "").removeprefix("<urn:page:").rstrip(">")
    return int(inner) if inner else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _READ.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    for batch in batches:
        for content in batch.column(0):
            rows = [
                (_urn(h["WARC-Record-ID"]), int(h["WARC-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha256:"), h["WARC-Type"], _urn(h.get("WARC-Refers-To")), h["WARC-Target-URI"])
                for h, _ in read_records(content.as_py())
            ]
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)


def read_warc(spark, path: str) -> DataFrame:
    """A row per record of the archives under ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(_read, _READ)


def with_revisits(pages: DataFrame) -> DataFrame:
    """Adds refers_to: the smallest page_id with the same payload of 100 bytes or more, where that is another page.

    Only digests are grouped; a digest of which there is one page joins nothing.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", "html", F.when(F.octet_length(payload) >= MIN_REVISIT_BYTES, F.sha2(payload, 256)).alias("digest"))
    firsts = rows.filter("digest is not null").groupBy(F.col("digest").alias("d")).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = settled(firsts.filter("n > 1 and first is not null").select("d", "first"))
    out = rows.join(firsts, F.col("digest") == F.col("d"), "left")
    return out.select("page_id", "url", "html", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))


def checked(records: DataFrame) -> DataFrame:
    """The records, settled; ValueError where a revisit has another digest or length than the response it refers to."""
    records = settled(records)
    said = records.filter("record_type = 'revisit'").groupBy(F.col("refers_to").alias("to"), "payload_digest", "payload_bytes").agg(F.count(F.lit(1)).alias("n"))
    there = records.filter("record_type = 'response'").select("page_id", F.col("payload_digest").alias("digest"), F.col("payload_bytes").alias("size"))
    same = (F.col("to") == F.col("page_id")) & (F.col("payload_digest") == F.col("digest")) & (F.col("payload_bytes") == F.col("size"))
    wrong = said.join(there, same, "left_anti").first()
    if wrong is not None:
        raise ValueError(f"no response {wrong['to']} with the payload that its {wrong['n']} revisits name")
    return records


def warc_round_trip(pages: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a WARC record for each page, reads the archives back and checks revisits against their responses.

    Null html is an empty payload, null urls an empty target, a null page_id an
    empty record name and null again when read. Rows that repeat both page_id
    and payload of the response are responses too. An empty table writes no
    record and gives no rows.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_warc(with_revisits(pages), path, file_bytes)
    return checked(read_warc(spark, path))
