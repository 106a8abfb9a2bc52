"""WARC archives: a writer with revisit records and a salvage reader (operator 6).

Archives are ``.warc.gz`` files, one gzip member a record; the reader also takes plain
``.warc``. After a failed check (broken member, bad version line, missing or wrong length,
wrong digest) the reader searches for the next gzip member or version line that begins a
sound record, goes on there and logs the bytes between as a gap. A member may hold several
records; the reader streams it, and if something in it is unsound its records that are sound
come back beside a gap of the whole member. Null payloads are empty ones, null URLs and ids
leave their headers out, repeated rows give repeated records, other columns are left out. A table
without rows gives no archive. An archive that can't be opened is one gap of length -1.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import materialize, new_folder

#: An archive is closed once it has so many bytes.
ARCHIVE_BYTES = 64 << 20
#: Payloads from this size on are stored once.
REVISIT_BYTES = 1000
VERSION = re.compile(rb"WARC/\d+\.\d+\r?\n")
MEMBER = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = (
    "path string, offset long, length long, kind string, reason string, page_id long, url string, "
    "record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
)
ARROW = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
RECORDS_ARROW = pa.schema([(c.split()[0], ARROW[c.split()[1]]) for c in RECORDS.split(", ")])


def with_revisits(pages: DataFrame, min_bytes: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, payload_digest, refers_to; refers_to is null for responses.

    Of rows with equal payloads of min_bytes or more, those with the largest page_id are
    responses; a row with a null id revisits them, unless no row has an id. A group's row is its
    maximum, combined before the shuffle; the join back is one that Spark splits if a payload is
    very common.
    """
    p = pages.select("page_id", "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    p = p.withColumn("payload_digest", F.sha1("payload"))
    long = F.length("payload") >= min_bytes
    group = p.where(long).groupBy(F.col("payload_digest").alias("_digest"))
    group = group.agg(F.max("page_id").alias("_first"), F.count("*").alias("_rows")).where("_rows > 1 and _first is not null")
    out = p.join(group, (F.col("payload_digest") == F.col("_digest")) & long, "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("_first")), F.col("_first"))
    return out.select("page_id", "url", "payload", "payload_digest", refers.alias("refers_to"))


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One record as a gzip member."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response"]
    if page_id is not None:
        lines.append(f"WARC-Page-ID: {page_id}")
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    lines += [f"WARC-Block-Digest: {_sha1(block)}", f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def write_warc(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write with_revisits() rows as archives in folder, any URI that pyarrow opens.

    Returns (path, bytes, records), a table in the shared folder. Each attempt of a task
    writes files of its own; the table names those of the attempts that succeeded.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        task, out, name, done, n = TaskContext.get(), None, "", 0, 0
        made = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, done, n = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(made):04d}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                out.write(member := warc_record(*row))
                done, n = done + len(member), n + 1
                if done >= archive_bytes:
                    out.close()
                    made.append((f"{folder}/{name}", done, n))
                    out = None
        if out is not None:
            out.close()
            made.append((f"{folder}/{name}", done, n))
        yield pa.RecordBatch.from_pylist([dict(zip(("path", "bytes", "records"), x, strict=True)) for x in made], pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    rows = records.select("page_id", "url", "payload", "payload_digest", "refers_to")
    return materialize(rows.mapInArrow(write, "path string, bytes long, records long"), "warc-list")


class _Window:
    """A forward view of a stream: bytes from `start` on, read as they are asked for.

    size, if known, is the stream's length in bytes.
    """

    def __init__(self, stream, size: int | None = None, step: int = 1 << 20):
        self.stream, self.size, self.step, self.start, self.data, self.ended = stream, size, step, 0, bytearray(), False

    def fill(self, n: int) -> bool:
        while len(self.data) < n and not self.ended:
            got = self.stream.read(max(self.step, n - len(self.data)))
            self.ended = not got
            self.data += got
        return len(self.data) >= n

    def holds(self, n: int) -> bool:
        """fill(n), without reading on where the stream is known to be shorter."""
        return (self.size is None or self.start + n <= self.size) and self.fill(n)

    def drop(self, n: int) -> None:
        del self.data[:n]
        self.start += n


class _Inflated:
    """The gzip member at a window's start as a stream; taken counts the bytes it used.

    It ends where the member breaks; broken says how.
    """

    def __init__(self, w: _Window):
        self.w, self.unzip, self.taken, self.broken = w, zlib.decompressobj(31), 0, ""

    def read(self, _n: int) -> bytes:
        while not self.unzip.eof and not self.broken:
            if not self.w.fill(self.taken + 1):
                self.broken = "member is cut off"
                break
            piece = bytes(self.w.data[self.taken : self.taken + (1 << 12)])
            try:
                out = self.unzip.decompress(piece)
            except zlib.error as e:
                self.broken = f"broken member: {e}"
                return self._before(piece)
            self.taken += len(piece) - len(self.unzip.unused_data)
            if out:
                return out
        return b""

    def _before(self, piece: bytes) -> bytes:
        """What the piece that broke gives up to the byte that breaks; the error took it along."""
        unzip, out = zlib.decompressobj(31), bytearray()
        for at in range(0, self.taken, 1 << 12):
            unzip.decompress(bytes(self.w.data[at : min(at + (1 << 12), self.taken)]))
        with suppress(zlib.error):
            for at in range(len(piece)):
                out += unzip.decompress(piece[at : at + 1])
        return bytes(out)


def _parse(block: bytes) -> dict:
    """The record that begins a decompressed member or a plain stretch; ValueError if unsound."""
    m = VERSION.match(block)
    end = block.find(b"\r\n\r\n")
    if not m or end < 0:
        raise ValueError("no version line or no end of headers")
    head = {}
    for line in block[m.end() : end].split(b"\r\n"):
        k, colon, v = line.partition(b":")
        if not colon:
            raise ValueError("a header without a colon")
        head[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"\d{1,18}", head.get("content-length", "")):
        raise ValueError("no content length")
    return head | {"from": end + 4, "to": end + 4 + int(head["content-length"])}


def _row(head: dict, body: bytes) -> dict:
    if head.get("warc-block-digest", _sha1(body)) != _sha1(body):
        raise ValueError("wrong block digest")
    kind, digest = head.get("warc-type", ""), head.get("warc-payload-digest", "")
    http, _, payload = body.partition(b"\r\n\r\n") if head.get("content-type", "").startswith("application/http") else (b"", b"", body)
    if kind == "response" and digest and _sha1(payload) != digest:
        raise ValueError("wrong payload digest")
    hexed = base64.b32decode(digest[5:]).hex() if digest.startswith("sha1:") else hashlib.sha1(payload).hexdigest()
    size = re.search(rb"(?i)\r\nContent-Length: *(\d+)", http) if kind == "revisit" else None
    whole = lambda k: int(head[k]) if k in head else None
    return {"page_id": whole("warc-page-id"), "url": head.get("warc-target-uri"), "record_type": kind, "refers_to": whole("warc-refers-to-page-id"), "payload_bytes": int(size[1]) if size else len(payload), "payload_digest": hexed, "payload": payload}


def _plain(w: _Window) -> tuple[int, dict]:
    """(bytes taken, row) of the record whose version line is at the window's start."""
    n = 1 << 12
    while w.fill(n) and w.data.find(b"\r\n\r\n") < 0 and n < 1 << 20:
        n *= 2
    head = _parse(bytes(w.data[:n]))
    if not w.holds(head["to"]):
        raise ValueError("content is cut off")
    row, taken = _row(head, bytes(w.data[head["from"] : head["to"]])), head["to"]
    w.fill(taken + 4)
    while w.data[taken : taken + 1] in (b"\r", b"\n") and taken < head["to"] + 4:
        taken += 1
    return taken, row


def _members(w: _Window) -> Iterator[dict]:
    """Rows of the gzip member at the window's start, which goes; ValueError if it is broken.

    The last record's length is the member's, an earlier one's is null. A broken member's last
    record counts as unsound.
    """
    inner, last, reason = _Inflated(w), None, ""
    for row in _salvaged(_Window(inner), members=False):
        if row["kind"] == "gap":
            reason = reason or row["reason"]
            continue
        if last is not None:
            yield last
        last = row | {"offset": w.start, "length": None}
    if last is None or inner.broken:
        raise ValueError(inner.broken or reason or "a member without a record")
    yield last | {"length": inner.taken}
    if reason:
        yield {"kind": "gap", "offset": w.start, "length": inner.taken, "reason": reason}
    w.drop(inner.taken)


def _salvaged(w: _Window, members: bool = True) -> Iterator[dict]:
    begins = (MEMBER, b"WARC/") if members else (b"WARC/",)
    bad, reason = None, ""
    while w.fill(1):
        w.fill(32)
        try:
            if members and w.data.startswith(MEMBER):
                found = _members(w)
                row = next(found)
            elif VERSION.match(bytes(w.data[:32])):
                taken, row = _plain(w)
                row, found = row | {"kind": "record", "offset": w.start, "length": taken}, None
            else:
                raise ValueError("no member or version line")
            if bad is not None:
                yield {"kind": "gap", "offset": bad, "length": w.start - bad, "reason": reason}
                bad = None
            yield row
            if found is None:
                w.drop(taken)
            else:
                yield from found
        except (ValueError, TypeError) as e:
            bad, reason = (w.start, str(e)) if bad is None else (bad, reason)
            w.drop(1)
            while w.fill(1):  # to the next place where one could begin
                at = [x for x in map(w.data.find, begins) if x >= 0]
                if at:
                    w.drop(min(at))
                    break
                w.drop(max(1, len(w.data) - 4) if not w.ended else len(w.data))
                if len(w.data) <= 4 and not w.fill(len(w.data) + 1):
                    w.drop(len(w.data))
    if bad is not None:
        yield {"kind": "gap", "offset": bad, "length": w.start - bad, "reason": reason}


def salvage(stream, size: int | None = None) -> Iterator[dict]:
    """Rows of kind record or gap, in order, of one archive of `size` bytes, if known.

    Memory holds one record and the compressed bytes of its member; a length that points beyond
    the archive's end isn't followed.
    """
    return _salvaged(_Window(stream, size))


def read_warc(archives: DataFrame, keep_payload: bool = True, rows: int = 200) -> DataFrame:
    """Records and gaps of the archives whose URIs are in column path."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def frame(got):
            return pa.RecordBatch.from_pylist(got, RECORDS_ARROW)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                got = []
                try:
                    store, name = fs.FileSystem.from_uri(path)
                    stream, size = store.open_input_stream(name, compression=None), store.get_file_info(name).size
                except (OSError, ValueError) as e:
                    yield frame([{"path": path, "kind": "gap", "offset": 0, "length": -1, "reason": str(e)[:200]}])
                    continue
                with stream:
                    for row in salvage(stream, size):
                        if not keep_payload:
                            row["payload"] = None
                        got.append(row | {"path": path})
                        if len(got) >= rows:
                            yield frame(got)
                            got = []
                yield frame(got)

    return archives.select("path").where("path is not null").mapInArrow(read, RECORDS)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    archives = write_warc(with_revisits(pages), new_folder(spark, "warc"))
    out = read_warc(archives.repartition(max(2, spark.sparkContext.defaultParallelism)), keep_payload=False)
    return out.where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), q AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to
FROM q
"""
