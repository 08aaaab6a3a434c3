"""WARC archives: a writer with revisit records and a splittable reader.

The reader cuts archives into byte ranges. A task scans its range for the gzip magic, accepts
a candidate once the member decodes to a WARC header and the members after it form a chain,
and owns the records that start inside. It reads its range once, from front to back. No index
is needed and a 1 GB archive is read by as many tasks as it has ranges.

Archives lie in the shared folder and are opened through pyarrow's file systems, so any store
that pyarrow knows will do. A writing task writes under a name of its own and renames at the
end: a task that is run again replaces its file and never leaves half of one.

Defined cases: null html is an empty payload; a null url has no target URI; a page without a
page_id is a record without one (a revisit if its payload has an owner); rows repeated with
the smallest page_id of their payload are all responses; an empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksmith.llm.common import delete_path, discard, fresh_path, materialize

MAGIC = b"\x1f\x8b\x08"
CRLF = b"\r\n"
#: Bytes read at once, and records that must follow a candidate at the start of a range.
STEP, CHAIN = 1 << 16, 16
#: An archive is closed once it has grown this far.
ARCHIVE_BYTES = 1 << 30
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: High halves of the record ids of pages with and without a page_id.
NAMED, UNNAMED = 0x5D2B_7C60_41A9_4F3E, 0x5D2B_7C60_41A9_4F3F


# --- records ----------------------------------------------------------------------------------


def record_id(page_id: int | None, digest: bytes = b"") -> str:
    low = int.from_bytes(digest[:8], "big") if page_id is None else page_id & (2**64 - 1)
    return f"<urn:uuid:{uuid.UUID(int=((UNNAMED if page_id is None else NAMED) << 64) | low)}>"


def page_of(rid: str | None) -> int | None:
    if not rid:
        return None
    value = uuid.UUID(rid.strip("<>").removeprefix("urn:uuid:")).int
    low = value & (2**64 - 1)
    return (low - 2**64 if low >= 2**63 else low) if value >> 64 == NAMED else None


def make_record(page_id: int | None, url: str | None, payload: bytes, owner: int | None, revisit: bool, date: str) -> bytes:
    """One gzip member: a response with its payload, or a revisit that refers to ``owner``'s record."""
    digest = hashlib.sha1(payload).digest()
    http = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload), b"", b""])
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(owner))]
    fields += [("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode()), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8")
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(b"WARC/1.1\r\n" + head + CRLF + block + CRLF + CRLF) + pack.flush()


def parse_header(data: bytes | bytearray) -> tuple[dict[str, str], int] | None:
    """The fields, names in lower case, and where the block starts; None if this is no WARC record."""
    end = data.find(CRLF + CRLF)
    if not data.startswith(b"WARC/") or end < 0:
        return None
    lines = data[:end].decode("utf-8", "replace").split("\r\n")[1:]
    fields = {k.strip().lower(): v.strip() for k, sep, v in (x.partition(":") for x in lines) if sep}
    return (fields, end + 4) if "warc-type" in fields and fields.get("content-length", "").isdigit() else None


def parse_record(data: bytes) -> dict:
    fields, start = parse_header(data)
    block = data[start : start + int(fields["content-length"])]
    http, _, payload = block.partition(CRLF + CRLF)
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    length = next((int(v) for k, _, v in (x.partition(b":") for x in http.split(CRLF)) if k.lower() == b"content-length"), len(payload))
    kind = fields["warc-type"]
    if kind == "response":
        length, found = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if digest and digest != found:
            raise ValueError(f"payload digest {found} is not the recorded {digest} in {fields.get('warc-record-id')}")
        digest = found
    return {
        "page_id": page_of(fields.get("warc-record-id")),
        "url": fields.get("warc-target-uri"),
        "record_type": kind,
        "payload_bytes": length,
        "payload_digest": digest,
        "refers_to": page_of(fields.get("warc-refers-to")),
        "payload": payload if kind == "response" else None,
    }


# --- splittable reading -----------------------------------------------------------------------


class Window:
    """A file read from ``at`` on, each byte once; what lies before :meth:`drop` is forgotten."""

    def __init__(self, file, at: int, step: int = STEP):
        self.file, self.base, self.data, self.step = file, at, bytearray(), step
        file.seek(at)

    def end(self) -> int:
        return self.base + len(self.data)

    def more(self) -> bool:
        raw = self.file.read(self.step)
        self.data += raw
        return bool(raw)

    def drop(self, at: int) -> None:
        if at - self.base >= min(self.step, len(self.data)):
            del self.data[: at - self.base]
            self.base = at

    def find(self, what: bytes, at: int, end: int) -> int:
        """The first place of ``what`` that starts in [at, end), -1 if none."""
        while at < end:
            while self.end() < min(at + self.step, end + len(what) - 1) and self.more():
                pass
            k = self.data.find(what, at - self.base, end + len(what) - 1 - self.base)
            if k >= 0:
                return self.base + k
            before, at = at, max(at, self.end() - len(what) + 1)
            if at == before:
                return -1
            self.drop(at)
        return -1

    def member(self, at: int, header_only: bool = False) -> tuple[bytes, int] | None:
        """The gzip member of a WARC record at ``at`` and where it ends; None if none is there.

        With ``header_only`` as much of it as holds its header.
        """
        unpack, out, pos = zlib.decompressobj(31), bytearray(), at
        while not unpack.eof:
            if pos >= self.end() and not self.more():
                return None
            raw = bytes(memoryview(self.data)[pos - self.base : pos - self.base + self.step])
            try:
                out += unpack.decompress(raw)
            except zlib.error:
                return None
            pos += len(raw)
            if len(out) >= 5 and not out.startswith(b"WARC/"):
                return None
            if header_only and CRLF + CRLF in out:
                break
        return (bytes(out), pos - len(unpack.unused_data)) if parse_header(out) else None


def chained(window: Window, at: int, end: int, size: int) -> bool:
    """Whether up to ``CHAIN`` records follow each other from ``at``, or to the first one at or after ``end``.

    A gzip member may hold another archive as stored bytes; its chain breaks where it ends.
    """
    for _ in range(CHAIN):
        member = window.member(at, header_only=at >= end)
        if member is None:
            return False
        if at >= end or member[1] >= size:
            return True
        at = member[1]
    return True


def records_between(file, begin: int, end: int, size: int, step: int = STEP) -> Iterator[bytes]:
    """The records that start in [begin, end), from one pass over the range.

    At the start of a range candidates are validated by a chain of at most ``CHAIN`` records.
    An archive of more records than that inside one record, as stored bytes, would be taken for
    the real chain; it ends in an error where that chain breaks, never in wrong records alone.
    """
    window, at = Window(file, begin, step), begin
    if begin:
        while True:
            at = window.find(MAGIC, at, end)
            if at < 0:
                return
            if chained(window, at, end, size):
                break
            at += 1
    while at < end:
        member = window.member(at)
        if member is None:
            raise ValueError(f"no record starts at byte {at}, where the one before ends, or it is cut off")
        yield member[0]
        at = member[1]
        window.drop(at)


# --- Spark ------------------------------------------------------------------------------------


def write_archives(pages: DataFrame, folder: str, revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes archives of about ``archive_bytes`` at most, each by one task, and returns the written list of them (path, bytes, records).

    Only digests are grouped; pages meet their payload's owner in one sort-merge join on the
    digest, which Spark splits where one payload is very common.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("html"), F.sha1(payload.cast("binary")).alias("sha"), F.octet_length(payload).alias("n"))
    owners = rows.where(F.col("n") >= revisit_bytes).groupBy("sha").agg(F.min("page_id").alias("owner"), F.count("*").alias("copies"))
    owners = materialize(owners.where("copies > 1 AND owner IS NOT NULL").select("sha", "owner"), "owners")
    joined = rows.join(owners.hint("merge"), "sha", "left").select("page_id", "url", "html", "owner", (F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))).alias("revisit"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, top = pafs.FileSystem.from_uri(folder)
        fs.create_dir(top, recursive=True)
        draft = f".draft-{context.taskAttemptId()}"
        number, records, size, out = 0, 0, 0, None

        def close() -> pa.RecordBatch:
            nonlocal number, records, size, out
            out.close()
            name = f"part-{context.partitionId():06d}-{number:04d}.warc.gz"
            fs.move(f"{top}/{draft}", f"{top}/{name}")
            row = {"path": [f"{folder}/{name}"], "bytes": [size], "records": [records]}
            number, records, size, out = number + 1, 0, 0, None
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for page_id, url, html, owner, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = out or fs.open_output_stream(f"{top}/{draft}", compression=None)
                member = make_record(page_id, url, html.encode("utf-8"), owner, revisit, date)
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= archive_bytes:
                    yield close()
        if out:
            yield close()

    return materialize(joined.mapInArrow(write, "path string, bytes long, records long"), "archives")


def read_archives(archives: DataFrame, split_bytes: int = 32 << 20, with_payload: bool = False) -> DataFrame:
    """A row per record of the archives (path, bytes): see :func:`parse_record`."""
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + (", payload binary" if with_payload else "")
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = [f.split(" ")[0] for f in schema.split(", ")]
    splits = archives.where("bytes > 0").select("path", "bytes", F.explode(F.expr(f"sequence(0L, bytes - 1, {split_bytes}L)")).alias("begin"))
    tasks = archives.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, begin in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, inner = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(inner) as file:
                    rows, held = [], 0
                    for data in records_between(file, begin, min(begin + split_bytes, size), size):
                        rows.append(parse_record(data))
                        held += len(data) if with_payload else 200
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=False)], names)
                            rows, held = [], 0
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=False)], names)

    return splits.repartition(int(min(tasks, 100_000))).mapInArrow(read, schema)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the archives, reads them back and deletes them."""
    folder = fresh_path(spark, "warc")
    archives = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    found = materialize(read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "records")
    delete_path(spark, folder)
    discard(archives)
    return found


OP3_SQL = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), o AS (
  SELECT *, min(page_id) OVER (PARTITION BY h) AS owner FROM p
)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + CAST((('0x' || substr(h, 1 + CAST(i // 4 AS INTEGER) * 5, 5))::BIGINT >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER), 1)),
         'string_agg', '') AS payload_digest,
       CASE WHEN owner IS NULL OR page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = owner THEN NULL ELSE owner END AS refers_to
FROM o
"""
