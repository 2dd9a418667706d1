"""WARC archives: a writer with revisit records, and a reader that salvages damaged archives.

Every record is a gzip member of its own. The reader checks each record: gzip checksum, version line, header, length,
and the block digest where there is one. When a check fails it looks for the next gzip member that begins with a
version line, or the next version line, whose record passes, goes on from there, and logs the bytes in between.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, small_side, stash

#: Bytes after which an archive is closed.
ARCHIVE_BYTES = 32 << 20
READ_BYTES = 1 << 20
DATE = "2026-01-01T00:00:00Z"
ID = re.compile(r"<urn:page:(-?\d+)>")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else "<urn:page:none>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One record, not compressed. A revisit has the HTTP header of its payload, whose length it states, and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines += [f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}"]
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse(data: bytes) -> tuple[dict[str, str], bytes] | str:
    """(header, block) of the single record in data, or what is wrong with it."""
    if not re.match(rb"WARC/\d+\.\d+\r?\n", data):
        return "no version line"
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return "header does not end"
    header = {}
    for line in data[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return "bad header line"
        header[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"\d+", header.get("content-length", "")):
        return "no content length"
    block = data[end + 4:end + 4 + int(header["content-length"])]
    if len(block) != int(header["content-length"]) or data[end + 4 + len(block):] != b"\r\n\r\n":
        return "length does not fit"
    kind, _, digest = header.get("warc-block-digest", "").partition(":")
    if kind == "sha1" and digest != sha1_base32(block):
        return "block digest differs"
    return header, block


class _Buffer:
    """The unread rest of a stream, read as far as it is needed."""

    def __init__(self, stream):
        self.stream, self.data, self.at, self.done = stream, bytearray(), 0, False

    def fill(self, n: int) -> bool:
        """Whether n bytes are there."""
        while len(self.data) < n and not self.done:
            more = self.stream.read(max(READ_BYTES, n - len(self.data)))
            self.data += more
            self.done = not more
        return len(self.data) >= n

    def find(self, what: bytes) -> int:
        """Where what begins, reading as far as it needs; -1 if the stream ends before."""
        start = 0
        while True:
            at = self.data.find(what, start)
            if at >= 0 or self.done:
                return at
            start = max(0, len(self.data) - len(what) + 1)
            self.fill(len(self.data) + 1)

    def drop(self, n: int) -> None:
        del self.data[:n]
        self.at += n


def _take(buf: _Buffer) -> tuple[int, tuple[dict[str, str], bytes]] | str:
    """(length, record) at the start of buf, or what is wrong there."""
    if buf.fill(2) and buf.data[:2] == b"\x1f\x8b":
        z, out, used = zlib.decompressobj(31), bytearray(), 0
        try:
            while not z.eof:
                if not buf.fill(used + 1):
                    return "gzip member does not end"
                piece = bytes(buf.data[used:used + READ_BYTES])
                out += z.decompress(piece)
                used += len(piece) - len(z.unused_data)
                if not used or (len(out) >= 5 and out[:5] != b"WARC/"):
                    return "gzip member is no record"
        except zlib.error as e:
            return f"gzip: {e}"[:80]
        got = parse(bytes(out))
        return got if isinstance(got, str) else (used, got)
    if buf.fill(5) and buf.data[:5] == b"WARC/":
        end = buf.find(b"\r\n\r\n")
        length = re.search(rb"\r\ncontent-length:\s*(\d+)\s*\r\n", bytes(buf.data[:max(end, 0) + 2]), re.I)
        if end < 0 or not length:
            return "bad header"
        size = end + 4 + int(length[1]) + 4
        if not buf.fill(size):
            return "length does not fit"
        got = parse(bytes(buf.data[:size]))
        return got if isinstance(got, str) else (size, got)
    return "neither member nor version line"


def salvage(stream) -> Iterator[tuple[str, int, int, object]]:
    """("record", offset, length, (header, block)) and ("gap", offset, length, reason) in the order of the archive.

    Offsets and lengths are of the archive as stored. Memory holds a record and a read-ahead; only a damaged length
    or a member that does not end makes it look at more.
    """
    buf, gap, why = _Buffer(stream), None, ""
    mark = re.compile(rb"\x1f\x8b\x08|WARC/\d")  # after a cut a version line may begin anywhere
    while buf.fill(1):
        got = _take(buf)
        if not isinstance(got, str):
            if gap is not None:
                yield "gap", gap, buf.at - gap, why
                gap = None
            size, found = got
            yield "record", buf.at, size, found
            buf.drop(size)
            continue
        if gap is None:
            gap, why = buf.at, got
        while True:
            hit = mark.search(buf.data, 1)
            if hit:
                buf.drop(hit.start())
                break
            if buf.done:
                buf.drop(len(buf.data))
                break
            buf.drop(max(0, len(buf.data) - 8))
            buf.fill(len(buf.data) + READ_BYTES)
    if gap is not None:
        yield "gap", gap, buf.at - gap, why


def _target(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if re.match(r"\w+:", folder) else f"file://{folder}")


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages with payload (binary), refers_to and revisit: of equal payloads of at least least_bytes bytes, the record with the largest id is kept and the others revisit it."""
    rows = pages.withColumn("payload", F.encode(F.coalesce("html", F.lit("")), "UTF-8")).drop("html")
    rows = rows.withColumn("sha", F.when(F.length("payload") >= least_bytes, F.sha1("payload")))
    groups = stash(rows.where("sha is not null").groupBy("sha").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n"), "payloads")
    out = rows.join(small_side(groups), "sha", "left")
    other = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return out.select("page_id", "url", "payload", F.when(other, F.col("keeper")).alias("refers_to"), other.alias("revisit"))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record for each row of pages into .warc.gz files in a shared folder; returns their (path, records, bytes).

    A null html is an empty payload, a null url has no target header, rows with null id have none in their record id.
    Rows that repeat id and payload of a response are responses too. A task that is run again writes files of new
    names, and only those of its successful run are returned. Empty input writes nothing.
    """
    rows = revisits(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")), least_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _target(folder)
        system.create_dir(base, recursive=True)
        name, out, records = "", None, 0

        def done():
            size = out.tell()
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], ["path", "records", "bytes"])

        for b in batches:
            for page, url, payload, refers, again in zip(*b.columns, strict=True):
                if out is None:
                    name, records = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                out.write(member(record(page.as_py(), url.as_py(), payload.as_py(), refers.as_py(), again.as_py())))
                records += 1
                if out.tell() >= ARCHIVE_BYTES:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return stash(rows.mapInArrow(run, "path string, records long, bytes long"), "archives")


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """What is in the archives of column path: records and, as rows of kind gap, the bytes given up.

    Columns: kind (record or gap), path, offset, length, reason, record_type, page_id, url, refers_to, payload_digest,
    payload_bytes and, if asked for, payload. The digest is that of the full payload, computed for responses and
    stated by revisits. Empty input and empty files give no rows.
    """
    names = ["kind", "path", "offset", "length", "reason", "record_type", "page_id", "url", "refers_to", "payload_digest", "payload_bytes"] + ["payload"] * payloads
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()] + [pa.binary()] * payloads
    schema = "kind string, path string, offset long, length long, reason string, record_type string, page_id long, url string, refers_to long, payload_digest string, payload_bytes long" + ", payload binary" * payloads

    def rows(path: str):
        system, at = _target(path)
        with system.open_input_stream(at, compression=None) as stream:
            for kind, offset, length, what in salvage(stream):
                if kind == "gap":
                    yield (kind, path, offset, length, what, *[None] * (len(names) - 5))
                    continue
                header, block = what
                head, _, payload = block.partition(b"\r\n\r\n")
                revisit = header.get("warc-type") == "revisit"
                stated = re.search(rb"\r\ncontent-length:\s*(\d+)", head, re.I)
                digest = header.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else sha1_base32(payload)
                page, to = ID.search(header.get("warc-record-id", "")), ID.search(header.get("warc-refers-to", ""))
                size = int(stated[1]) if revisit and stated else len(payload)
                yield (kind, path, offset, length, None, header.get("warc-type"), page and int(page[1]), header.get("warc-target-uri"), to and int(to[1]), digest, size, *[payload] * payloads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                held, size = [], 0
                for row in rows(path):
                    held.append(row)
                    size += row[3]
                    if size > READ_BYTES * 4 or len(held) >= 2_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), kinds, strict=True)], names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), kinds, strict=True)], names)

    return archives.select("path").repartition(max(1, archives.count())).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), fresh_path(spark, "warc"))
    found = read_archives(archives, payloads=False)
    # what was just written has no gaps: a page that can't be read back fails the query
    found = found.where(F.when(F.col("kind") == "record", F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("gap in a new archive: "), F.col("path"), F.lit(" "), F.coalesce("reason", F.lit("")))).cast("boolean")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
b AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS keeper FROM p),
d AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda i:
        '{_ALPHABET}'[(((('0x' || substr(x || '00', (i * 5 // 8) * 2 + 1, 4))::BIGINT >> (11 - i * 5 % 8)) & 31) + 1)]), '') AS payload_digest FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM d
"""
