"""WARC archives and a two-level capture index.

write_archives() writes a gzip member for each record. Records with equal payloads are one response, the others revisits of it. Tasks write files of their own
names and hand back what they wrote, so a lost or repeated task leaves at most a file that nothing names.
build_index() sorts captures by reversed-host keys (`com,example,www)/path`) into compressed blocks of BLOCK lines and
keeps a directory of the blocks' first and last keys. captures() sorts the keys asked for the same way; each task loads the directory's rows
for its keys only, finds blocks and lines by binary search, and reads the records' bytes by range.
Archives and index lie in a folder that all executors share, reached through Arrow's file systems.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import re
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, cut, parts_for, read, ship

BLOCK, FILE_BYTES, LEAST = 1000, 1 << 30, 0
DATE = "1970-01-01T00:00:00Z"
CAPTURE = "key string, page_id long, file string, at long, size long"


@dataclass(frozen=True)
class Archives:
    """Where the archives lie, and the captures that they hold."""

    folder: str
    captures: DataFrame


@dataclass(frozen=True)
class Index:
    folder: str
    directory: str


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", uri))


def surt(url: str | None) -> str:
    """The key of a URL: host labels reversed, then the port, then path and query. A URL without a host is its own key. Tabs and line breaks, which
    divide an index's lines, are written as escapes, so that keys are sorted as they are kept."""
    key = url or ""
    try:
        u = urlsplit(key)
        host, port = u.hostname or "", u.port
        if host:
            key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (u.path or "/") + (f"?{u.query}" if u.query else "")
    except ValueError:
        pass
    return key.replace("\t", "%09").replace("\n", "%0A").replace("\r", "%0D")


def _page_order(page: int | None) -> tuple:
    """Pages without an id come first, as Spark sorts them."""
    return (page is not None, page or 0)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([surt(u) for u in b.column("url").to_pylist()], pa.string()), b.column("page_id")], ["key", "page_id"])


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, head) -> bytes:
    """The WARC record of a page; head is the page of the response, the page itself for a response."""
    kind = "response" if head == page_id else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {quote(url or '', safe='%/:?#[]@!$&()*+,;=~')}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{head}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's headers, its payload (None for a revisit) and the size of the full payload. Raises ValueError if it isn't whole or its digest is wrong."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    n = int(headers["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record is cut short")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)^content-length: (\d+)", http, re.M)[1])
    if headers["warc-type"] == "response" and (len(payload) != size or headers["warc-payload-digest"] != f"sha1:{digest(payload)}"):
        raise ValueError("a payload isn't what its headers say")
    return {"headers": headers, "payload": payload if headers["warc-type"] == "response" else None, "size": size}


def write_archives(pages: DataFrame, folder: str, scratch: Scratch, least: int = LEAST) -> Archives:
    """Writes a record for each row of pages (page_id, url, html; null html is empty, null url an empty address).

    Of records with equal payloads of `least` bytes or more, that with the largest page_id is the response; smaller payloads are all responses. Rows
    that repeat a page_id with the same payload are responses or revisits alike. A row without a page_id revisits the response of its payload, and
    is a response itself if no page with that payload has an id; its record's id is empty. Payloads are equal if their SHA-256 and lengths are. Other columns aren't read."""
    ship(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.concat(F.unhex(F.sha2(F.col("html").cast("binary"), 256)), F.octet_length("html").cast("string").cast("binary")))
    heads = scratch.save(rows.groupBy("sha").agg(F.max("page_id").alias("head"), F.count("*").alias("copies")).filter("copies > 1").drop("copies"))
    placed = rows.join(heads, "sha", "left").select("page_id", "url", "html", F.when(F.octet_length("html") >= least, F.coalesce("head", "page_id")).otherwise(F.col("page_id")).alias("head"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _place(folder)
        out, name, at = None, "", 0
        for b in batches:
            lines = []
            for page, url, html, head in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "head"))):
                if out is None or at > FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                member = gzip.compress(record(page, url, html.encode(), head), 6, mtime=0)
                out.write(member)
                lines.append((surt(url), page, name, at, len(member)))
                at += len(member)
            if lines:
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*lines), kinds)], ["key", "page_id", "file", "at", "size"])
        if out is not None:
            out.close()

    return Archives(folder, scratch.save(placed.mapInArrow(write, CAPTURE)))


def build_index(archives: Archives, scratch: Scratch) -> Index:
    """The blocks and their directory. A host with any share of the captures is dealt out by its paths and pages."""
    folder = f"{archives.folder}/index"
    spark = archives.captures.sparkSession
    size = archives.captures.agg(F.coalesce(F.sum(F.octet_length("key") + 64), F.lit(0))).first()[0]
    ordered = archives.captures.repartitionByRange(parts_for(spark, size), "key", "page_id").sortWithinPartitions("key", "page_id", "file", "at")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _place(folder)
        name, out, at, lines = f"{uuid.uuid4().hex}.cdx", None, 0, []

        def block():
            nonlocal out, at, lines
            if out is None:
                store.create_dir(base, recursive=True)
                out = store.open_output_stream(f"{base}/{name}", compression=None)
            z = zlib.compress("\n".join("\t".join("" if y is None else str(y) for y in (*x[1:], x[0])) for x in lines).encode())
            out.write(z)
            row = (lines[0][0], lines[0][1], lines[-1][0], lines[-1][1], name, at, len(z))
            at += len(z)
            lines = []
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], ["first_key", "first_page", "last_key", "last_page", "file", "at", "size"])

        for b in batches:
            for line in zip(*(b.column(c).to_pylist() for c in ("key", "page_id", "file", "at", "size"))):
                lines.append(line)
                if len(lines) == BLOCK:
                    yield block()
        if lines:
            yield block()
        if out is not None:
            out.close()

    rows = ordered.mapInArrow(write, "first_key string, first_page long, last_key string, last_page long, file string, at long, size long")
    path = f"{folder}/directory"
    rows.write.parquet(path)
    return Index(archives.folder, path)


class _Reader:
    """Range reads, with the last few files kept open."""

    def __init__(self, folder: str) -> None:
        self.store, self.base = _place(folder)
        self.open: OrderedDict[str, pa.NativeFile] = OrderedDict()

    def __call__(self, name: str, at: int, size: int) -> bytes:
        if name not in self.open:
            self.open[name] = self.store.open_input_file(f"{self.base}/{name}")
            if len(self.open) > 64:
                self.open.popitem(last=False)[1].close()
        self.open.move_to_end(name)
        return self.open[name].read_at(size, at)


def captures(wanted: DataFrame, index: Index) -> DataFrame:
    """The captures of (url, page_id) rows, read from the archives: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    Rows that ask for the same capture get it once; a null page_id asks for the captures of its url without one; what the index doesn't have gives no
    row; payload is null for revisits."""
    spark = ship(wanted.sparkSession)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = wanted.select("url", F.col("page_id").cast("long").alias("page_id")).mapInArrow(_keyed, "key string, page_id long").distinct()
    asked = asked.repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, records = _Reader(f"{index.folder}/index"), _Reader(index.folder)
        store, path = _place(index.directory)
        for b in batches:
            if not b.num_rows:
                continue
            keys, pages = b.column("key").to_pylist(), b.column("page_id").to_pylist()
            table = ds.dataset(path, filesystem=store, format="parquet").to_table(filter=(ds.field("last_key") >= keys[0]) & (ds.field("first_key") <= keys[-1]))
            edge = lambda r, side: (r[f"{side}_key"].encode(), *_page_order(r[f"{side}_page"]))
            rows = sorted(table.to_pylist(), key=lambda r: edge(r, "first"))
            firsts, lasts = [edge(r, "first") for r in rows], [edge(r, "last") for r in rows]
            at, lines, marks, found = -1, [], [], []
            for want in ((k.encode(), *_page_order(p)) for k, p in zip(keys, pages)):
                k = max(0, bisect.bisect_left(firsts, want) - 1)
                while k < len(rows) and firsts[k] <= want:
                    if lasts[k] >= want:
                        if k != at:
                            r = rows[k]
                            text = zlib.decompress(blocks(r["file"], r["at"], r["size"])).decode()
                            lines, at = [x.split("\t", 4) for x in text.split("\n")], k
                            marks = [(x[4].encode(), *_page_order(int(x[0]) if x[0] else None)) for x in lines]
                        i = bisect.bisect_left(marks, want)
                        while i < len(lines) and marks[i] == want:
                            found.append(_answer(parse(gzip.decompress(records(lines[i][1], int(lines[i][2]), int(lines[i][3]))))))
                            i += 1
                            if len(found) == 100:
                                yield _rows(found)
                                found = []
                    k += 1
            if found:
                yield _rows(found)

    return asked.mapInArrow(look, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def _page(urn: str | None) -> int | None:
    return int(urn[len("<urn:page:") : -1]) if urn and urn != "<urn:page:>" else None


def _answer(r: dict) -> tuple:
    h = r["headers"]
    return _page(h["warc-record-id"]), h["warc-target-uri"], h["warc-type"], _page(h.get("warc-refers-to")), r["size"], h["warc-payload-digest"].removeprefix("sha1:"), r["payload"]


def _rows(found: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found), kinds)], ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, scratch = read(spark, sf_dir, "pages"), Scratch(spark)
    archives = write_archives(pages, f"{scratch.at}/warc", scratch)
    index = build_index(archives, scratch)
    out = cut(captures(pages.select("url", "page_id"), index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    scratch.drop()
    return out


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS sha,
        max(page_id) OVER (PARTITION BY html) AS head FROM p),
b AS (SELECT *, array_to_string(list_transform(string_split(sha, ''), lambda h:
        substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * strpos('0123456789abcdef', h) - 3, 4)), '') AS bits FROM s)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT)
      + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> head THEN head END AS refers_to
FROM b
"""
