"""WARC files of web pages, and a reader that salvages what damage leaves.

Every record is a gzip member of its own. The reader checks each record (gzip checksum, version line,
declared length, block and payload digests); where a check fails it searches byte by byte for the next
member or version line at which a whole record passes them, and logs the bytes between as a gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.llm import common
from hindcast.llm.common import stage
from hindcast.session import scratch_folder

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:page:"
CHUNK = 1 << 16
#: Longest header of a record; a longer one counts as damage.
HEADER_BYTES = 1 << 20
CANDIDATE = re.compile(rb"\x1f\x8b\x08|WARC/1\.")


class Damaged(ValueError):
    """A check failed; says which."""


def sha1_label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP head of its page but no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{RECORD_ID}{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        *([] if url is None else ["WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)]),
        *([] if refers_to is None else [f"WARC-Refers-To: <{RECORD_ID}{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]),
        f"WARC-Payload-Digest: {sha1_label(payload)}",
        f"WARC-Block-Digest: {sha1_label(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    deflate = zlib.compressobj(5, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


def parse_head(data: bytes) -> tuple[dict[str, str], int]:
    """Headers by lower-case name, and where the block begins."""
    end = data.find(b"\r\n\r\n")
    if not re.match(rb"WARC/1\.\d\r\n", data):
        raise Damaged("no version line")
    if end < 0:
        raise Damaged("header without end")
    lines = data[:end].decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, end + 4


def checked(head: dict[str, str], block: bytes) -> dict:
    """A record whose digests agree, or Damaged."""
    if (said := head.get("warc-block-digest")) and said.startswith("sha1:") and said != sha1_label(block):
        raise Damaged("block digest")
    kind, payload, length = head.get("warc-type", ""), block, None
    if head.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        if m := re.search(rb"(?i)\r\ncontent-length: *(\d+)", http):
            length = int(m[1])
    if kind != "revisit":
        length = len(payload)
        if (said := head.get("warc-payload-digest")) and said.startswith("sha1:") and said != sha1_label(payload):
            raise Damaged("payload digest")
    return {"head": head, "kind": kind, "payload": payload, "payload_bytes": length}


class SalvageReader:
    """The records and gaps of one seekable file, with one record in memory at a time."""

    def __init__(self, source: pa.NativeFile):
        self.source, self.size = source, source.size()

    def read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(max(0, min(n, self.size - at)))

    def record_at(self, at: int) -> tuple[dict, int]:
        start = self.read(at, 7)
        if start[:3] == b"\x1f\x8b\x08":
            return self.member(at)
        if start == b"WARC/1.":
            return self.plain(at)
        raise Damaged("no record here")

    def member(self, at: int) -> tuple[dict, int]:
        inflate, parts, end = zlib.decompressobj(31), [], at
        while not inflate.eof:
            chunk = self.read(end, CHUNK)
            if not chunk:
                raise Damaged("member cut off")
            try:
                parts.append(inflate.decompress(chunk))
            except zlib.error as error:
                raise Damaged(f"gzip: {error}") from None
            end += len(chunk)
            if len(parts) == 1 and parts[0] and not b"WARC/1.".startswith(parts[0][:7]):
                raise Damaged("no version line")
        end -= len(inflate.unused_data)
        data = b"".join(parts)
        head, begin = parse_head(data)
        n = self.length(head)
        if len(data) != begin + n + 4 or data[-4:] != b"\r\n\r\n":
            raise Damaged("length")
        return checked(head, data[begin : begin + n]), end

    def plain(self, at: int) -> tuple[dict, int]:
        n = CHUNK
        data = self.read(at, n)
        while b"\r\n\r\n" not in data and n < HEADER_BYTES and len(data) == n:
            n *= 4
            data = self.read(at, n)
        head, begin = parse_head(data)
        n = self.length(head)
        if at + begin + n + 4 > self.size:
            raise Damaged("length")
        block = self.read(at + begin, n + 4)
        if block[-4:] != b"\r\n\r\n":
            raise Damaged("length")
        return checked(head, block[:-4]), at + begin + n + 4

    @staticmethod
    def length(head: dict[str, str]) -> int:
        if not re.fullmatch(r"\d{1,15}", said := head.get("content-length", "")):
            raise Damaged("no length")
        return int(said)

    def candidates(self, at: int) -> Iterator[int]:
        """Where a member or a version line may begin, from ``at`` on."""
        while at < self.size:
            data = self.read(at, CHUNK + 8)
            for m in CANDIDATE.finditer(data):
                if m.start() < CHUNK:
                    yield at + m.start()
            at += CHUNK

    def __iter__(self) -> Iterator[dict]:
        at = 0
        while at < self.size:
            try:
                record, end = self.record_at(at)
            except Damaged as error:
                record, end, begin = None, self.size, self.size
                for begin in self.candidates(at + 1):
                    try:
                        record, end = self.record_at(begin)
                        break
                    except Damaged:
                        continue
                begin = begin if record else self.size
                yield {"kind": "gap", "offset": at, "length": begin - at, "reason": str(error)}
                at = begin
                if record is None:
                    return
            yield record | {"offset": at, "length": end - at, "reason": None}
            at = end


FILES = "file string, n_records long, n_bytes long"


def write_pages(pages: DataFrame, path: str, least_bytes: int = 1000, file_bytes: int = 64 << 20, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record per page under ``path``; equal payloads of ``least_bytes`` or more only once.

    Of such pages the one with the largest page_id is a response and the others revisit it; pages that
    share both payload and page_id are all responses. A null html is empty; a null page_id never wins
    against another; a null url is left out. Returns the table of files, which is the commit: files it does
    not name come from lost attempts. No pages, no files.
    """
    schema = pa.schema([("file", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out, n, done = None, 0, []
        for batch in batches:
            for page_id, url, payload, keeper in zip(*(batch[k].to_pylist() for k in range(4)), strict=True):
                out = out or common.TaskFile(path, f"pages-{TaskContext.get().partitionId():06d}", ".warc.gz")
                out.write(record_bytes(page_id, url, payload, None if keeper is None or keeper == page_id else keeper, date))
                n += 1
                if out.size >= file_bytes:
                    out.close()
                    done.append({"file": out.name, "n_records": n, "n_bytes": out.size})
                    out, n = None, 0
        if out is not None:
            out.close()
            done.append({"file": out.name, "n_records": n, "n_bytes": out.size})
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)

    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    # 256 bits of digest and the length stand for the payload.
    keyed = rows.withColumn("digest", F.when(F.octet_length("payload") >= least_bytes, F.concat(F.sha2("payload", 256), F.octet_length("payload").cast("string"))))
    groups = keyed.where("digest IS NOT NULL").groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
    groups = stage(groups.where("n > 1").select("digest", "keeper"))
    joined = keyed.join(groups, "digest", "left")
    return stage(joined.select("page_id", "url", "payload", "keeper").mapInArrow(write, FILES), f"{path}/files")


RECORDS = "file string, offset long, length long, kind string, record_id string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary, reason string"


def read_records(spark: SparkSession, path: str, names: DataFrame, payload: bool = True) -> DataFrame:
    """Records and gaps of the files ``names`` (file) under ``path``, one task a file.

    A gap has kind ``gap``, the quarantined bytes as offset and length, and the first check that failed.
    ``payload_digest`` is the lower-case hex SHA-1: computed for records that carry a payload, declared for
    revisits, whose ``payload_bytes`` is the length their HTTP head declares.
    """
    schema = pa.schema(
        [(k, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for k, t in (x.split() for x in RECORDS.split(", "))]
    )

    def bare(uri: str | None) -> str | None:
        return uri.strip("<>") if uri else None

    def row(file: str, x: dict) -> dict:
        head = x.get("head", {})
        out = {"file": file, "offset": x["offset"], "length": x["length"], "kind": x["kind"], "reason": x["reason"]}
        if x["kind"] == "gap":
            return out
        said = head.get("warc-payload-digest", "")
        digest = base64.b32decode(said[5:]).hex() if x["kind"] == "revisit" and said.startswith("sha1:") else hashlib.sha1(x["payload"]).hexdigest()
        return out | {
            "record_id": bare(head.get("warc-record-id")),
            "target_uri": head.get("warc-target-uri"),
            "refers_to": bare(head.get("warc-refers-to")),
            "payload_bytes": x["payload_bytes"],
            "payload_digest": digest,
            "payload": x["payload"] if payload else None,
        }

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch["file"].to_pylist():
                rows, size = [], 0
                with common.open_file(path, file) as source:
                    for x in SalvageReader(source):
                        rows.append(row(file, x))
                        size += 500 + (x.get("payload_bytes") or 0 if payload else 0)
                        if size >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return names.select("file").repartition(max(1, names.count())).mapInArrow(read, RECORDS)


def page_digests(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as WARC files, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = scratch_folder(spark)
    records = read_records(spark, path, write_pages(pages, path), payload=False)
    page = lambda c: F.expr(f"CAST(nullif(substring({c}, {len(RECORD_ID) + 1}), '') AS BIGINT)")
    return records.select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), page("refers_to").alias("refers_to")
    )


PAGE_DIGESTS_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
k AS (SELECT page_id, b, octet_length(b) AS n, max(page_id) OVER (PARTITION BY b) AS keeper FROM p)
SELECT page_id, n AS payload_bytes, sha1(b) AS payload_digest,
  CASE WHEN n >= 1000 AND keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND keeper <> page_id THEN keeper END AS refers_to
FROM k"""
