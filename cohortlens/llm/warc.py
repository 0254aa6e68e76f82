"""WARC archives: writing with revisit records, and a salvage reader.

Archives hold one gzip member a record. The reader takes compressed and plain archives, with one record or many a member,
and checks framing, lengths and digests. After a failed check it searches for the next valid member or version line, in a
member in its inflated bytes; later records are recovered and the bytes between are logged as a quarantined gap with its
reason. A record that a search finds where the damaged one's stated length still runs, or away from a line's start, may
be part of a payload and is marked suspect. Members are inflated as they are read, so memory is bounded by one record,
and by MAX_RECORD whatever a header says. The writer writes nothing that the reader would not take: what is beyond the
bounds is an error of the job, and never a page that is missing.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.base import shared_dir, small_batches, table, written

GZIP, VERSION = b"\x1f\x8b\x08", b"WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK, PROBE = 1 << 16, 1 << 10
ARCHIVE_BYTES = 256 << 20
#: Bytes of a block and of headers, at most: the reader quarantines what states more, the writer refuses it.
MAX_RECORD, MAX_HEAD = 1 << 30, 1 << 26
_LENGTH = re.compile(r"[0-9]{1,18}")


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, record_id: str, uri: str, block: bytes, **headers: str) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 2020-01-01T00:00:00Z", f"WARC-Target-URI: {uri}", "Content-Type: application/http;msgtype=response"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in headers.items()]
    lines += [f"WARC-Block-Digest: sha1:{digest(block)}", f"Content-Length: {len(block)}", "", ""]
    head = "\r\n".join(lines).encode("utf-8", "surrogatepass")
    if len(head) > MAX_HEAD or len(block) > MAX_RECORD:
        raise ValueError(f"record {record_id} has {len(head)} bytes of headers and a block of {len(block)}: more than a reader takes")
    return head + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    uri = "".join(c for c in url or "" if c > " ")
    own = {"WARC_Payload_Digest": f"sha1:{digest(payload)}"}
    if refers_to is None:
        return record("response", f"urn:page:{page_id}", uri, head + payload, **own)
    return record("revisit", f"urn:page:{page_id}", uri, head, **own, WARC_Profile=PROFILE, WARC_Refers_To=f"<urn:page:{refers_to}>")


def member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


@dataclass
class Item:
    """A record, or a gap of quarantined bytes with the check that failed.

    [start, end) are bytes of the file, [first, last) bytes within an inflated member. Of many items of one member only
    the last has an end beyond the member's start, so items follow each other without overlap.
    """

    start: int
    end: int
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""
    reason: str = ""
    first: int = 0
    last: int = 0
    suspect: bool = False


class Damaged(Exception):
    """A failed check; extent is how many bytes the record states, 0 if that can't be told."""

    def __init__(self, reason: str, extent: int = 0):
        super().__init__(reason)
        self.extent = extent


class Window:
    """A forward view of bytes: need(n) holds at least n bytes if there are so many, drop(n) moves on."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.data, self.at, self.pos, self.error = chunks, bytearray(), 0, 0, ""

    def need(self, n: int) -> bool:
        while len(self.data) - self.at < n:
            try:
                chunk = next(self.chunks, None)
            except Damaged as e:
                chunk, self.error = None, str(e)
            if chunk is None:
                return False
            if self.at > CHUNK and self.at > len(self.data) // 2:
                del self.data[: self.at]
                self.at = 0
            self.data += chunk
        return True

    def drop(self, n: int) -> None:
        self.at, self.pos = self.at + n, self.pos + n

    def find(self, mark: bytes, start: int, limit: int) -> int:
        """The place of mark from start, below limit, or -1; reads on as far as needed."""
        while True:
            found = self.data.find(mark, self.at + start, self.at + limit)
            if found >= 0:
                return found - self.at
            have = len(self.data) - self.at
            if have >= limit or not self.need(have + 1):
                return -1
            start = max(start, have - len(mark) + 1)

    def take(self, start: int, n: int) -> bytes:
        return bytes(self.data[self.at + start : self.at + start + n])


def _headers(head: bytes) -> tuple[dict[str, str], int]:
    """Headers of a record and its block's length."""
    headers: dict[str, str] = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("a header without a colon")
        headers[name.strip().decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    if not _LENGTH.fullmatch(headers.get("content-length", "")):
        raise Damaged("no content length")
    if not headers.get("warc-record-id") or not headers.get("warc-type"):
        raise Damaged("no record id or type")
    return headers, int(headers["content-length"])


def _check_digests(headers: dict[str, str], block: bytes, extent: int) -> None:
    if (named := headers.get("warc-block-digest", "")).startswith("sha1:") and named[5:] != digest(block):
        raise Damaged("block digest differs", extent)
    if headers.get("warc-type") == "response" and (named := headers.get("warc-payload-digest", "")).startswith("sha1:") and named[5:] != digest(payload(block)):
        raise Damaged("payload digest differs", extent)


def _record(w: Window, room: int | None = None) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and size of the record that the window starts with; room: bytes that there are at most."""
    if not w.need(len(VERSION)) or w.take(0, len(VERSION)) != VERSION:
        raise Damaged("no version line")
    end = w.find(b"\r\n\r\n", 0, MAX_HEAD + 4)
    if end < 0:
        raise Damaged(w.error or "headers without an end")
    headers, n = _headers(w.take(0, end))
    size = end + 4 + n + 4
    if n > MAX_RECORD or (room is not None and size > room):
        raise Damaged("states more bytes than there are or may be", min(size, room or size))
    if not w.need(size) or w.take(size - 4, 4) != b"\r\n\r\n":
        raise Damaged(w.error or "record cut short or of another length", size)
    block = w.take(end + 4, n)
    _check_digests(headers, block, size)
    return headers, block, size


def _as_far(z, data: bytes) -> bytes:
    """What z inflates of data before an error, which it meets: by halves down to the byte."""
    out, at, step = b"", 0, len(data)
    while step and at < len(data):
        trial = z.copy()
        try:
            out += trial.decompress(data[at : at + step])
            z, at = trial, at + step
        except zlib.error:
            step //= 2
    return out


class Archive:
    """Random access to a file by read_at(offset, size), whatever stores it."""

    def __init__(self, read_at, size: int):
        self.read_at, self.size = read_at, size

    @classmethod
    def of(cls, data: bytes) -> Archive:
        return cls(lambda at, n: data[at : at + n], len(data))

    def _plain_chunks(self, at: int) -> Iterator[bytes]:
        while data := self.read_at(at, CHUNK):
            yield data
            at += len(data)

    def _inflated(self, at: int, end: list[int]) -> Iterator[bytes]:
        """Inflated chunks of the member at a place; end gets where it ends. What inflates before damage comes out too."""
        z, pos = zlib.decompressobj(31), at
        while not z.eof:
            data = z.unconsumed_tail
            if not data:
                data = self.read_at(pos, CHUNK)
                pos += len(data)
                if not data:
                    raise Damaged("member cut short")
            before = z.copy()
            try:
                out = z.decompress(data, 16 * CHUNK)
            except zlib.error as e:
                yield _as_far(before, data)
                raise Damaged("member does not inflate") from e
            if out:
                yield out
        end.append(pos - len(z.unused_data))

    def _next(self, at: int) -> int:
        """The next place from which a record can be read: a member that inflates to a version line, or such a line."""
        while at < self.size:
            data = self.read_at(at, CHUNK + len(VERSION))
            here = 0
            while True:
                spots = [x for x in (data.find(GZIP, here, CHUNK + 2), data.find(VERSION, here)) if x >= 0]
                if not spots:
                    break
                here = min(spots)
                if data.startswith(VERSION, here):
                    return at + here
                try:
                    if zlib.decompressobj(31).decompress(self.read_at(at + here, PROBE), 16).startswith(VERSION):
                        return at + here
                except zlib.error:
                    pass
                here += 1
            at += CHUNK
        return self.size

    def _member(self, at: int) -> Iterator[Item]:
        """Items of the member at a place; the last has the end."""
        end: list[int] = []
        w = Window(self._inflated(at, end))
        held, stated, found = None, 0, False
        while w.need(1):
            try:
                headers, block, size = _record(w)
                now = Item(at, at, headers, block, first=w.pos, last=w.pos + size, suspect=found and (w.pos < stated or not found_at_line))
                found = False
            except Damaged as e:
                first, reason, stated = w.pos, str(e), max(stated, w.pos + e.extent)
                w.drop(1)
                before = w.take(-1, 1) if w.at else b""
                while (step := w.find(VERSION, 0, 16 * CHUNK)) < 0 and w.need(16 * CHUNK):
                    w.drop(16 * CHUNK - len(VERSION) + 1)
                rest = step if step >= 0 else len(w.data) - w.at
                w.drop(rest)
                found, found_at_line = True, (bytes(w.data[w.at - 1 : w.at]) if w.at else before) == b"\n"
                now = Item(at, at, reason=w.error or reason, first=first, last=w.pos)
                size = 0
            if held:
                yield held
            held = now
            w.drop(size)
        if w.error:
            after = self._next(at + 1)
            if held and held.reason:
                held.end, held.reason = after, w.error
            else:
                if held:
                    yield held
                held = Item(at, after, reason=w.error, first=w.pos, last=w.pos)
        elif held:
            held.end = end[0]
        else:
            held = Item(at, end[0], reason="a member without a record")
        yield held

    def items(self) -> Iterator[Item]:
        at, stated, found = 0, 0, False
        while at < self.size:
            start = self.read_at(at, 8)
            if start.startswith(GZIP):
                for item in self._member(at):
                    yield item
                at, found = item.end, bool(item.reason)
                continue
            try:
                if not start.startswith(VERSION):
                    raise Damaged("neither a member nor a version line")
                headers, block, size = _record(Window(self._plain_chunks(at)), self.size - at)
                yield Item(at, at + size, headers, block, suspect=found and (at < stated or self.read_at(at - 1, 1) != b"\n"))
                at, found = at + size, False
            except Damaged as e:
                after = self._next(at + 1)
                yield Item(at, after, reason=str(e))
                at, stated, found = after, max(stated, at + e.extent), True


def payload(block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2]


def http_length(block: bytes) -> int | None:
    for line in block.partition(b"\r\n\r\n")[0].split(b"\r\n"):
        name, _, value = line.partition(b":")
        if name.lower() == b"content-length" and re.fullmatch(rb"[0-9]{1,18}", value.strip()):
            return int(value)
    return None


def _write(batches: Iterator[pa.RecordBatch], uri: str, archive_bytes: int) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    system, folder = fs.FileSystem.from_uri(uri)
    system.create_dir(folder, recursive=True)
    context = TaskContext.get()
    stem, names, out, n, size, rows = f"part-{context.partitionId():07d}", 0, None, 0, 0, []

    def close():
        nonlocal out
        out.close()
        name = f"{stem}-{names:04d}.warc.gz"
        system.move(f"{folder}/.{name}.{context.taskAttemptId()}", f"{folder}/{name}")  # a file is whole or not there
        rows.append((name, uri, size, n))
        out = None

    for batch in batches:
        for page_id, url, html, largest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if out is None:
                names, n, size = names + 1, 0, 0
                out = system.open_output_stream(f"{folder}/.{stem}-{names:04d}.warc.gz.{context.taskAttemptId()}")
            data = member(page_record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), None if largest is None or largest == page_id else largest))
            out.write(data)
            n, size = n + 1, size + len(data)
            if size >= archive_bytes:
                close()
    if out is not None:
        close()
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["name", "uri", "bytes", "records"])


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """A record a row of pages; -> written listing (name, uri, bytes, records) of the archives in the shared folder.

    Null payloads are empty. Of rows whose equal payloads have revisit_min_bytes or more, those with the largest id are
    responses and the others revisits that refer to it; rows repeated with that same id are responses too, and a null id
    is below all. Shorter payloads are all responses. Other columns are not read.
    """
    spark = pages.sparkSession
    small_batches(spark)
    uri = shared_dir(spark, "warc")
    html = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).alias("url"), html.alias("html"), F.sha1(html).alias("digest"))
    again = rows.where(F.octet_length("html") >= revisit_min_bytes).groupBy("digest").agg(F.max("id").alias("largest"), F.count("*").alias("n"))
    largest = written(again.where("n > 1").select("digest", "largest"), "warc-largest")  # payloads seen once need no partner
    rows = rows.join(largest, "digest", "left").select("id", "url", "html", "largest")
    return written(rows.mapInArrow(lambda b: _write(b, uri, archive_bytes), "name string, uri string, bytes bigint, records bigint"), "warc-listing")


READ = "archive string, start bigint, end bigint, first bigint, last bigint, reason string, suspect boolean, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes bigint, payload binary"


def _read(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    schema = pa.schema([(n, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}[t]) for n, t in (x.split() for x in READ.split(", "))])

    def out(rows):
        return pa.RecordBatch.from_pylist(rows, schema)

    for batch in batches:
        for name, uri in zip(*(batch.column(c).to_pylist() for c in ("name", "uri")), strict=True):
            system, folder = fs.FileSystem.from_uri(uri)
            with system.open_input_file(f"{folder}/{name}") as f:
                rows, held = [], 0
                for item in Archive(lambda at, n, f=f: f.read_at(n, at) if at < f.size() else b"", f.size()).items():
                    h = item.headers
                    row = {"archive": name, "start": item.start, "end": item.end, "first": item.first, "last": item.last, "reason": item.reason or None, "suspect": item.suspect}
                    if not item.reason:
                        body = payload(item.block) if h.get("warc-type") == "response" else None
                        row |= {"record_type": h.get("warc-type"), "record_id": h.get("warc-record-id", "").strip("<>"), "target_uri": h.get("warc-target-uri"), "refers_to": h.get("warc-refers-to", "").strip("<>") or None}
                        row |= {"payload_digest": digest(body) if body is not None else h.get("warc-payload-digest", "").removeprefix("sha1:"), "payload_bytes": len(body) if body is not None else http_length(item.block), "payload": body if with_payload else None}
                    rows.append(row)
                    held += len(item.block)
                    if len(rows) >= 256 or held > 8 << 20:
                        yield out(rows)
                        rows, held = [], 0
                if rows:
                    yield out(rows)


def read_archives(listing: DataFrame, with_payload: bool = True) -> DataFrame:
    """Listing (name, uri) -> a row a record, and a row with a reason a quarantined gap of bytes [start, end), or of
    [first, last) of the inflated member there.

    Archives are dealt to tasks by name. Digests of responses are computed from what was read.
    """
    tasks = int(listing.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return listing.select("name", "uri").repartition(tasks, "name").mapInArrow(lambda b: _read(b, with_payload), READ)


def op2(spark, sf_dir: str) -> DataFrame:
    records = read_archives(write_archives(table(spark, sf_dir, "pages")), with_payload=False)
    gap = F.raise_error(F.concat(F.lit("an archive of this job's own has a gap: "), F.col("reason"))).cast("boolean")
    records = records.where(F.when(F.col("reason").isNotNull(), gap).otherwise(F.lit(True)))
    number = lambda c: F.expr(f"try_cast(substring_index({c}, ':', -1) as bigint)")
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


#: SHA-1 in base32 is not at hand in the oracle's SQL: it is built from the digest's bits, five at a time.
OP2_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS x FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS m FROM p),
d AS (SELECT DISTINCT x, list_reduce(list_transform(string_split(x, ''), lambda c: lpad(bin(strpos('0123456789abcdef', c) - 1), 4, '0')), lambda a, c: a || c) AS bits FROM p),
e AS (SELECT x, list_reduce(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (16 * substr(bits, 5 * k + 1, 1)::INT + 8 * substr(bits, 5 * k + 2, 1)::INT + 4 * substr(bits, 5 * k + 3, 1)::INT
  + 2 * substr(bits, 5 * k + 4, 1)::INT + substr(bits, 5 * k + 5, 1)::INT)::INT, 1)), lambda a, c: a || c) AS b32 FROM d)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, b32 AS payload_digest, CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to FROM r JOIN e USING (x)
"""
