"""WARC records in ZIP packages, and a reader that fetches single records from them.

A package is a ZIP file whose members are stored, not compressed: archive/data.warc.gz (the records one after another,
each a gzip member of its own, as WARC files have them) and indexes/index.cdx (a line per record: page id, record type,
offset and size in the archive member). The reader parses
the end record, the ZIP64 records where there are any, the central directory and the members' local headers; it then
knows where a member's bytes lie in the package and reads each record by its range, so nothing is extracted.

Of records with equal payloads (by SHA-1 and size) of at least `least` bytes, the one with the largest page id is a
response; the others are revisit records that name it and hold only its digest and size. Digests and groups are Spark's
work: groups are counted before they are joined back, so a payload that a third of the pages share is a single row on
one side and is split by adaptive execution on the other.

Cases: a null html is an empty payload; a null url is left out of the record; pages with a null id are responses of
their own and never referred to; a page id that comes more than once gives a record each time, and of equal payloads
with that id all are responses; an empty table gives no package. Payloads may have any size that one record can hold in
memory.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
LEVEL = 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The capture's time isn't in the table, and a record has to name one.
DATE = "1970-01-01T00:00:00Z"
#: Records closer to each other than this are read with one range.
GAP, RANGE = 1 << 16, 4 << 20


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, size: int) -> bytes:
    """One WARC record: an HTTP response, or a revisit that keeps only the HTTP head."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    body = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    warc = dict(x.split(": ", 1) for x in lines[1:])
    http, _, payload = rest[: int(warc["Content-Length"])].partition(b"\r\n\r\n")
    return warc, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


class Package:
    """Members of a ZIP file by its directories; `range` reads bytes of a stored member."""

    def __init__(self, uri: str):
        fs, path = common.filesystem(uri)
        self.file = fs.open_input_file(path)
        self.members = self._directory(self.file.size())

    def _directory(self, size: int) -> dict[str, tuple[int, int]]:
        tail_at = max(0, size - (1 << 16) - 22 - 20)
        tail = self.file.read_at(size - tail_at, tail_at)
        end = tail.rfind(b"PK\x05\x06")
        if end < 0:
            raise ValueError("no ZIP end record")
        entries, length, at = struct.unpack_from("<HII", tail, end + 10)
        if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":
            wide = self.file.read_at(56, struct.unpack_from("<Q", tail, end - 12)[0])
            if wide[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record where its locator points")
            entries, length, at = struct.unpack_from("<QQQ", wide, 32)
        raw, p, found = self.file.read_at(length, at), 0, {}
        for _ in range(entries):
            if raw[p : p + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            method = struct.unpack_from("<H", raw, p + 10)[0]
            packed, full, n, extra, comment = struct.unpack_from("<IIHHH", raw, p + 20)
            local = struct.unpack_from("<I", raw, p + 42)[0]
            name, more = raw[p + 46 : p + 46 + n].decode(), raw[p + 46 + n : p + 46 + n + extra]
            full, packed, local = self._zip64(more, full, packed, local)
            if method != 0 or packed != full:
                raise ValueError(f"{name} is compressed; only stored members can be read by range")
            found[name] = (local, full)
            p += 46 + n + extra + comment
        return {name: (self._data_at(local), full) for name, (local, full) in found.items()}

    @staticmethod
    def _zip64(extra: bytes, *values: int) -> list[int]:
        """Values of 32 bits that are all ones stand in the ZIP64 field, in this order."""
        p, out = 0, list(values)
        while p + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, p)
            if kind == 1:
                q = p + 4
                for i, v in enumerate(out):
                    if v == 0xFFFFFFFF:
                        out[i] = struct.unpack_from("<Q", extra, q)[0]
                        q += 8
            p += 4 + n
        return out

    def _data_at(self, local: int) -> int:
        head = self.file.read_at(30, local)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("no local header where the directory points")
        return local + 30 + sum(struct.unpack_from("<HH", head, 26))

    def range(self, member: str, offset: int, size: int) -> bytes:
        at, full = self.members[member]
        if offset < 0 or offset + size > full:
            raise ValueError("range lies outside the member")
        return self.file.read_at(size, at + offset)

    def index(self) -> Iterator[tuple[int | None, int, int]]:
        for line in self.range(INDEX, 0, self.members[INDEX][1]).decode().splitlines():
            page, _, offset, size = line.split(" ")
            yield None if page == "-" else int(page), int(offset), int(size)

    def record(self, offset: int, size: int) -> bytes:
        return gzip.decompress(self.range(ARCHIVE, offset, size))

    def records(self) -> Iterator[bytes]:
        """All records, fetched by ranges of neighbouring index lines."""
        group: list[tuple[int, int]] = []

        def fetch() -> Iterator[bytes]:
            first, last = group[0][0], sum(group[-1])
            data = self.range(ARCHIVE, first, last - first)
            yield from (gzip.decompress(data[o - first : o - first + n]) for o, n in group)

        for _, offset, size in self.index():
            if group and (offset - sum(group[-1]) > GAP or offset < group[-1][0] or offset + size - group[0][0] > RANGE):
                yield from fetch()
                group = []
            group.append((offset, size))
        if group:
            yield from fetch()


def linked(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, digest (hex), size and refers_to of every page.

    Pages and links meet on the page id and the digest, so a page id that comes with two payloads keeps a link for each.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), common.text_of("html").alias("html"))
    own = own.withColumns({"digest": F.sha1(F.encode("html", "utf-8")), "size": F.octet_length("html")})
    slim = own.select("page_id", "digest", "size").where(F.col("page_id").isNotNull() & (F.col("size") >= least))
    groups = slim.groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least_id")).where("refers_to > least_id").drop("least_id")
    links = slim.join(groups, ["digest", "size"]).where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()
    return own.join(links, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "size", "refers_to")


def write_packages(pages: DataFrame, path: str, least: int = 0) -> DataFrame:
    """Write every page as a record into ZIP packages below path (a package per partition); their list is returned.

    A package is written under a name of its own attempt and then renamed.
    """
    rows_of = linked(pages, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, lines, out = 0, [], None
        fs, folder = common.filesystem(path)
        fs.create_dir(folder, recursive=True)
        name = f"pages-{TaskContext.get().partitionId():06d}.zip"
        own = f"{folder}/.{name}-{uuid.uuid4().hex}"
        for b in common.sliced(batches, "html", 8 << 20):
            if out is None:
                out = fs.open_output_stream(own)
                package = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True)
                member = package.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
            for page, url, html, digest, refers in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                payload = html.encode()
                data = gzip.compress(record(page, url, payload, base64.b32encode(bytes.fromhex(digest)).decode(), refers, len(payload)), LEVEL, mtime=0)
                member.write(data)
                lines.append(f"{'-' if page is None else page} {'response' if refers is None else 'revisit'} {n} {len(data)}")
                n += len(data)
        if out is None:
            return
        member.close()
        package.writestr(zipfile.ZipInfo(INDEX), "\n".join(lines))
        package.close()
        out.close()
        fs.move(own, f"{folder}/{name}")
        yield pa.RecordBatch.from_pydict({"file": [f"{path}/{name}"], "records": [len(lines)]})

    rows = [(r.file, r.records) for r in rows_of.mapInArrow(run, "file string, records long").collect()]
    return pages.sparkSession.createDataFrame(rows, "file string, records long").repartition(max(1, len(rows)))


def read_packages(packages: DataFrame) -> DataFrame:
    """A row per record, from the packages: page_id, url, record_type, refers_to, payload (null in a revisit), payload_bytes
    and payload_digest. A response's payload is checked against its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file in b.column("file").to_pylist():
                rows, held = [], 0
                package = Package(file)
                for data in package.records():
                    warc, http, payload = parse(data)
                    kind, digest = warc["WARC-Type"], warc["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and base32_sha1(payload) != digest:
                        raise ValueError("a payload differs from its digest")
                    number = lambda x: int(x) if (x := (x or "").removeprefix("<urn:page:").rstrip(">")) else None
                    rows.append((number(warc["WARC-Record-ID"]), warc.get("WARC-Target-URI"), kind, number(warc.get("WARC-Refers-To")), payload if kind == "response" else None, int(http["Content-Length"]), digest))
                    held += len(payload)
                    if held > 8 << 20 or len(rows) >= 2000:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)
                package.file.close()

    return packages.select("file").mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string())
    names = ["page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
