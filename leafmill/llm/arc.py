"""Legacy web archives (ARC, versions 1 and 2) as WARC records.

The version block at the start of a file says which version its record headers have: five fields in version 1, ten in version 2, the last the declared
length of what follows. Each record becomes what a WARC writer would have made of it: type, target, date, digests and an identifier, which
is derived from the rest so that a repeated conversion gives the same record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC as _UTC
from datetime import datetime
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_views

V1 = "URL IP-address Archive-date Content-type Archive-length"
V2 = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
_LINE = {1: re.compile(rb"(\S.*?) (\S+) (\d{8,14}) (\S.*?) (\d+)"), 2: re.compile(rb"(\S.*?) (\S+) (\d{8,14}) (\S.*?) (\S+) (\S+) (\S+) (\d+|-) (\S+) (\d+)")}
_FIELDS = "archive string, offset long, warc_type string, record_id string, target_uri string, warc_date string, ip_address string, content_type string, content_length long, block_digest string, payload_digest string, truncated boolean"


class Record(NamedTuple):
    offset: int
    warc_type: str
    record_id: str
    target_uri: str
    warc_date: str | None
    ip_address: str | None
    content_type: str
    content_length: int
    block_digest: str
    payload_digest: str
    truncated: bool
    block: bytes


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_date(stamp: str) -> str | None:
    """An archive date of 8 to 14 digits as WARC writes it, missing parts zero; None if it is no date."""
    try:
        return datetime.strptime(stamp.ljust(14, "0"), "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return None


def plain(data: bytes) -> bytes:
    """The archive without compression: as it is, or the members of a gzip file as far as they can be read."""
    if data[:2] != b"\x1f\x8b":
        return data
    out, rest = [], data
    while rest[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        try:
            out.append(d.decompress(rest) + d.flush())
        except zlib.error:
            break
        rest = d.unused_data
    return b"".join(out)


def records(data: bytes, archive: str | None = None) -> Iterator[Record]:
    """The records of one archive, whose name and the record's place in it enter the record's id: equal captures are records of their own. A line that isn't a header is skipped; a record that ends before its declared length is marked as truncated."""
    data, version, at, place = plain(data), 1, 0, 0
    while at < len(data):
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        line = data[at:end].rstrip(b"\r")
        m = None
        for v in (version, 1) if line.startswith(b"filedesc:") else (version,):
            m = m or _LINE[v].fullmatch(line)
        if not m:
            at = end + 1
            continue
        url, ip, stamp, kind = (x.decode("utf-8", "replace") for x in m.group(1, 2, 3, 4))
        length = int(m.group(m.lastindex))
        block = data[end + 1 : end + 1 + length]
        if url.startswith("filedesc:"):
            said = re.match(rb"(\d)", block)
            version = 2 if said and said.group(1) == b"2" else 1
        yield _converted(f"{archive or ''}\n{place}", at, url, ip, stamp, kind, block, len(block) < length)
        at, place = end + 1 + length, place + 1


def _converted(place: str, offset: int, url: str, ip: str, stamp: str, kind: str, block: bytes, truncated: bool) -> Record:
    payload = block
    if url.startswith("filedesc:"):
        warc_type, content_type = "warcinfo", "application/warc-fields"
        block = payload = b"software: leafmill\r\nformat: WARC File Format 1.0\r\nisPartOf: " + url[len("filedesc://") :].encode() + b"\r\n"
        truncated = False
    elif block[:5] == b"HTTP/" and url.split(":", 1)[0].lower() in ("http", "https"):
        warc_type, content_type = "response", "application/http; msgtype=response"
        cut = [k + n for k, n in ((block.find(b"\r\n\r\n"), 4), (block.find(b"\n\n"), 2)) if k >= 0]
        payload = block[min(cut) :] if cut else b""
    else:
        warc_type, content_type = "resource", "text/dns" if url.startswith("dns:") else kind if "/" in kind else "application/octet-stream"
    date, digest = warc_date(stamp), sha1(block)
    name = hashlib.md5("\n".join([place, warc_type, url, date or "", digest]).encode()).hexdigest()
    return Record(offset, warc_type, f"<urn:uuid:{uuid.UUID(name)}>", url, date, None if ip in ("0.0.0.0", "-") else ip, content_type, len(block), digest, sha1(payload), truncated, block)


def warc_bytes(r: Record, compressed: bool = False) -> bytes:
    """The record as a WARC file has it; compressed records can be put one after another too."""
    head = [("WARC-Type", r.warc_type), ("WARC-Record-ID", r.record_id), ("WARC-Date", r.warc_date or "1970-01-01T00:00:00Z"), ("Content-Type", r.content_type), ("Content-Length", str(r.content_length)), ("WARC-Block-Digest", r.block_digest)]
    head += [("WARC-Filename", r.target_uri[len("filedesc://") :])] if r.warc_type == "warcinfo" else [("WARC-Target-URI", r.target_uri), ("WARC-Payload-Digest", r.payload_digest)]
    head += [("WARC-IP-Address", r.ip_address)] if r.ip_address and r.warc_type != "warcinfo" else []
    head += [("WARC-Truncated", "length")] if r.truncated else []
    data = b"WARC/1.0\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head) + b"\r\n" + r.block + b"\r\n\r\n"
    return gzip.compress(data, mtime=0) if compressed else data


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, content) of the .arc and .arc.gz files under ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{arc,arc.gz}").load(path).select(F.col("path").alias("archive"), "content")


def converted(df: DataFrame, archive_col: str = "archive", content_col: str = "content", with_record: bool = False) -> DataFrame:
    """A row for each record of each archive: where it starts, the WARC fields, and the whole WARC record as ``record`` if asked for.

    ``warc_date`` is null where the archive has no valid date; digests are those of the WARC block and of its payload, for a response what
    follows the HTTP header. Null and empty archives have no record; a repeated archive is converted again. Other columns are ignored."""
    schema = _FIELDS + (", record binary" if with_record else "")

    def read(batches):
        kinds = [pa.string(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.string(), pa.string(), pa.bool_()]
        for b in batches:
            for name, view in zip(b.column(0).to_pylist(), byte_views(b.column(1))):
                if view is None:
                    continue
                rows, made = [], []
                for r in records(view.tobytes(), name):
                    rows.append((name, *r[:-1]))
                    if with_record:
                        made.append(warc_bytes(r))
                columns = list(zip(*rows)) if rows else [()] * 12
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)] + ([pa.array(made, pa.binary())] if with_record else []), names=[x.split()[0] for x in schema.split(", ")])

    return df.select(F.col(archive_col).cast("string").alias("archive"), F.col(content_col).cast("binary").alias("content")).mapInArrow(read, schema)


# ---------------------------------------------------------------- writing


def archive_bytes(name: str, version: int, date: str, rows: list[tuple[str, str, str, str, bytes]]) -> bytes:
    """An archive of (url, ip, date, content type, block) in either version's form."""
    about = f"{version} 0 leafmill\n{V1 if version == 1 else V2}\n\n".encode()
    tail = "" if version == 1 else f" 200 - - 0 {name}"
    out = [f"filedesc://{name} 0.0.0.0 {date} text/plain{tail} {len(about)}\n".encode(), about, b"\n"]
    at = sum(map(len, out))
    for url, ip, stamp, kind, block in rows:
        middle = "" if version == 1 else f" 200 {hashlib.md5(block).hexdigest()} - {at} {name}"
        out += [f"{url} {ip} {stamp} {kind}{middle} {len(block)}\n".encode(), block, b"\n"]
        at += sum(map(len, out[-3:]))
    return b"".join(out)


def page_archives(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", each: int = 64) -> DataFrame:
    """(archive, content): pages as they were once stored, ``each`` consecutive ids to an archive, archives by turns in version 1 and 2. A page is
    fetched as many seconds after the start of 2009 as its id says; a null page is empty; rows without id or URL are left out."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.regexp_replace(url_col, r"\s", "%20").alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("html")).where("id IS NOT NULL AND url <> ''")

    def write(key, table):
        number = int(key[0].as_py())
        name, version = f"leafmill-{number:08d}.arc", 1 + number % 2
        out = []
        for i, url, html in sorted(zip(*(table.column(k).to_pylist() for k in ("id", "url", "html")))):
            stamp = datetime.fromtimestamp(1230768000 + i, tz=_UTC).strftime("%Y%m%d%H%M%S")
            out.append((url, f"192.0.2.{i % 250 + 1}", stamp, "text/html", b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html) + html))
        return pa.table({"archive": [name], "content": [archive_bytes(name, version, "20090101000000", out)]})

    return rows.groupBy(F.floor(F.col("id") / each).alias("number")).applyInArrow(write, "archive string, content binary")
