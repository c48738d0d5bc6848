"""MPEG transport streams in a binary column.

A stream is a row of 188-byte packets. The program association table names the program maps, those name the elementary streams; their sections are
checked by length and CRC. Per stream the 4-bit continuity counter tells lost packets from repeated ones; payloads are put together into elementary
packets, each with its presentation and decoding time stamps and whether decoding can start there.
"""

from __future__ import annotations

import functools
import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_views, small_batches

PACKET, SYNC, NULL_PID = 188, 0x47, 0x1FFF
_CRC = []
for _b in range(256):
    _c = _b << 24
    for _ in range(8):
        _c = (_c << 1) ^ 0x04C11DB7 if _c & 0x80000000 else _c << 1
    _CRC.append(_c & 0xFFFFFFFF)


@functools.lru_cache(maxsize=4096)
def crc32(data: bytes) -> int:
    """The CRC of program sections; 0 over a section that includes its own."""
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


class Unit(NamedTuple):
    """An elementary packet. ``broken``: packets were lost within it, or its header is malformed or its declared length isn't there."""

    program: int
    pid: int
    stream_type: int
    pts: int | None
    dts: int | None
    random_access: bool
    broken: bool
    data: bytes


class Stream(NamedTuple):
    packets: int
    skipped_bytes: int
    discontinuities: int
    duplicates: int
    bad_sections: int
    units: list[Unit]


def _packets(data: np.ndarray) -> tuple[np.ndarray, int]:
    """The packets as rows, and how many bytes belong to none: where the sync byte is missing, the next place is sought at which two follow in step, or one ends the data."""
    n = len(data)
    if n and n % PACKET == 0 and (data[::PACKET] == SYNC).all():
        return data.reshape(-1, PACKET), 0
    starts, at = [], 0
    candidates = np.flatnonzero(data == SYNC)
    while at + PACKET <= n:
        if data[at] == SYNC and (at + PACKET == n or at + PACKET < n and data[at + PACKET] == SYNC or starts and starts[-1] == at - PACKET):
            starts.append(at)
            at += PACKET
            continue
        k = np.searchsorted(candidates, at + 1)
        at = int(candidates[k]) if k < len(candidates) else n
    s = np.array(starts, np.int64)
    return data[s[:, None] + np.arange(PACKET)] if len(s) else np.zeros((0, PACKET), np.uint8), n - PACKET * len(s)


def _sections(rows: np.ndarray, begin: np.ndarray, start: np.ndarray) -> tuple[list[bytes], int]:
    """The whole sections that the packets of one table carry, and how many were malformed."""
    out, bad, held = [], 0, b""
    for row, at, first in zip(rows, begin.tolist(), start.tolist()):
        body = row[at:].tobytes()
        if first:
            if not body:
                continue
            pointer, body = body[0], body[1:]
            held = held + body[:pointer] if held else b""
            for piece in (held, body[pointer:]):
                held = piece
                while len(held) >= 3 and held[0] != 0xFF:
                    size = 3 + (((held[1] & 0x0F) << 8) | held[2])
                    if len(held) < size:
                        break
                    ok = size >= 12 and crc32(held[:size]) == 0
                    out += [held[:size]] if ok else []
                    bad += not ok
                    held = held[size:]
            held = b"" if held[:1] == b"\xff" else held
        elif held:
            held += body
            size = 3 + (((held[1] & 0x0F) << 8) | held[2]) if len(held) >= 3 else 1 << 30
            if len(held) >= size:
                ok = size >= 12 and crc32(held[:size]) == 0
                out += [held[:size]] if ok else []
                bad += not ok
                held = b""
    return out, bad


def _stamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def _header(data: bytes) -> tuple[int | None, int | None, bytes, bool]:
    """(pts, dts, payload, malformed) of an elementary packet."""
    if len(data) < 6 or data[:3] != b"\0\0\1":
        return None, None, data, True
    stream, declared = data[3], data[4] << 8 | data[5]
    short = bool(declared) and len(data) < 6 + declared
    if declared:
        data = data[: 6 + declared]
    if stream in (0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xFF, 0xF2, 0xF8):  # kinds without the optional header
        return None, None, data[6:], short
    if len(data) < 9 or data[6] >> 6 != 2 or len(data) < 9 + data[8]:
        return None, None, data[6:], True
    flags, size = data[7] >> 6, data[8]
    pts = _stamp(data[9:14]) if flags & 2 and size >= 5 else None
    dts = _stamp(data[14:19]) if flags == 3 and size >= 10 else None
    return pts, dts, data[9 + size :], short


def demux(data: np.ndarray) -> Stream:
    """What a transport stream holds. Never raises: what cannot be read is counted, or marked as broken."""
    p, skipped = _packets(data)
    pid = (p[:, 1].astype(np.int64) & 0x1F) << 8 | p[:, 2]
    start, error = (p[:, 1] & 0x40) > 0, (p[:, 1] & 0x80) > 0
    control, counter = p[:, 3] >> 4 & 3, (p[:, 3] & 15).astype(np.int64)
    adapted = (control & 2) > 0
    size = np.where(adapted, p[:, 4].astype(np.int64), -1)
    begin = 4 + size + 1
    flags = np.where(adapted & (size > 0), p[:, 5], 0)
    payload = ((control & 1) > 0) & (begin <= PACKET) & ~error & (pid != NULL_PID) & ((p[:, 3] >> 6) == 0)
    discontinuities = duplicates = bad = 0
    units: list[Unit] = []

    def of(k: int) -> np.ndarray:
        return np.flatnonzero(payload & (pid == k))

    i = of(0)
    tables, bad_ = _sections(p[i], begin[i], start[i])
    bad += bad_
    programs = {}
    for s in tables:
        if s[0] == 0 and s[5] & 1:
            for k in range(8, len(s) - 4, 4):
                number, map_pid = s[k] << 8 | s[k + 1], (s[k + 2] & 0x1F) << 8 | s[k + 3]
                if number:
                    programs[number] = map_pid
    streams: dict[int, tuple[int, int]] = {}
    for number, map_pid in programs.items():
        i = of(map_pid)
        tables, bad_ = _sections(p[i], begin[i], start[i])
        bad += bad_
        for s in tables:
            if s[0] == 2 and s[5] & 1 and (s[3] << 8 | s[4]) == number:
                k = 12 + ((s[10] & 0x0F) << 8 | s[11])
                while k + 5 <= len(s) - 4:
                    streams[(s[k + 1] & 0x1F) << 8 | s[k + 2]] = (number, s[k])
                    k += 5 + ((s[k + 3] & 0x0F) << 8 | s[k + 4])
    for k, (number, kind) in streams.items():
        i = of(k)
        if not len(i):
            continue
        c = counter[i]
        step = np.r_[1, (c[1:] - c[:-1]) % 16]
        told = (flags[i] & 0x80) > 0  # the stream says itself that the counter jumps
        same = np.zeros(len(i), bool)
        again = np.flatnonzero(step == 0)
        same[again] = (p[i[again]] == p[i[again - 1]]).all(1) & ~told[again]
        lost = (step != 1) & ~same & ~told
        duplicates += int(same.sum())
        discontinuities += int(lost.sum())
        i, lost = i[~same], lost[~same]
        first = np.flatnonzero(start[i])
        if not len(first):
            continue
        i, lost = i[first[0] :], lost[first[0] :]
        first -= first[0]
        rows = p[i]
        stream = rows[np.arange(PACKET)[None] >= begin[i][:, None]].tobytes()
        ends = np.r_[0, np.cumsum(PACKET - begin[i])]
        edge = ends[np.r_[first, len(i)]].tolist()
        # a loss found at a unit's first packet is the end of the unit before
        inside = np.r_[0, np.cumsum(lost)]
        holes = inside[np.r_[first[1:], len(i)]] - inside[first] - lost[first]
        holes[:-1] += lost[first[1:]]
        random = (flags[i[first]] & 0x40) > 0
        for a, b, r, h in zip(edge[:-1], edge[1:], random.tolist(), holes.tolist()):
            pts, dts, body, malformed = _header(stream[a:b])
            units.append(Unit(number, k, kind, pts, dts, r, malformed or h > 0, body))
    return Stream(len(p), skipped, discontinuities, duplicates, bad, units)


# ---------------------------------------------------------------- writing


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\0\0" + body
    return head + crc32(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section).ljust(PACKET, b"\xff")


@functools.lru_cache(maxsize=64)
def _tables(pid: int, stream_type: int, program: int) -> bytes:
    pat = _section(0, 1, program.to_bytes(2, "big") + (0xE000 | 0x100).to_bytes(2, "big"))
    pmt = _section(2, program, (0xE000 | pid).to_bytes(2, "big") + b"\xf0\0" + bytes([stream_type]) + (0xE000 | pid).to_bytes(2, "big") + b"\xf0\0")
    return _table_packet(0, pat) + _table_packet(0x100, pmt)


def _stamped(mark: int, t: int) -> bytes:
    return bytes([mark << 4 | (t >> 30 & 7) << 1 | 1, t >> 22 & 255, (t >> 15 & 127) << 1 | 1, t >> 7 & 255, (t & 127) << 1 | 1])


def mux(units: list[bytes], pts: list[int], random_access: list[bool], pid: int = 0x101, stream_type: int = 0x1B, program: int = 1) -> bytes:
    """A stream of one program with one elementary stream, a packet of it for each unit."""
    pes = [b"\0\0\1\xe0\0\0\x80\x80\x05" + _stamped(2, t) + u for u, t in zip(units, pts)]
    size = np.array([len(x) for x in pes], np.int64)
    mark = np.array(random_access, np.int64) * 2  # a first packet's adaptation field of two bytes
    count = -(-(size + mark) // 184)
    n = int(count.sum())
    if not n:
        return _tables(pid, stream_type, program)
    unit = np.repeat(np.arange(len(pes)), count)
    k = np.arange(n) - np.repeat(np.cumsum(count) - count, count)
    first = k == 0
    room = 184 - mark[unit] * first
    before = np.where(first, 0, 184 * k - mark[unit])
    length = np.minimum(room, size[unit] - before)
    out = np.full((n, PACKET), 255, np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = SYNC, np.where(first, 0x40, 0) | pid >> 8, pid & 255
    stuffed = length < 184
    out[:, 3] = np.where(stuffed, 0x30, 0x10) | np.arange(n) % 16
    field = 183 - length
    out[stuffed, 4] = field[stuffed]
    wide = stuffed & (field > 0)
    out[wide, 5] = np.where(first & (mark[unit] > 0), 0x40, 0)[wide]
    out[np.arange(PACKET)[None] >= (PACKET - length)[:, None]] = np.frombuffer(b"".join(pes), np.uint8)
    return _tables(pid, stream_type, program) + out.tobytes()


# ---------------------------------------------------------------- columns

_UNITS = "doc_id long, unit int, program int, pid int, stream_type int, pts long, dts long, random_access boolean, broken boolean, n_bytes int, digest string"
_SUMMARY = "doc_id long, packets int, skipped_bytes long, discontinuities int, duplicates int, bad_sections int, units int, random_access_points int"


def elementary_units(df: DataFrame, id_col: str = "doc_id", media_col: str = "media", with_data: bool = False) -> DataFrame:
    """A row for each elementary packet of each row's transport stream, numbered in the order of its stream: (doc_id, unit, program, pid, stream_type,
    pts, dts, random_access, broken, n_bytes, digest), the digest being the payload's MD5, and ``data``, the payload, if asked for.

    Null, empty and unreadable media have none; repeated rows are read each. Other columns are ignored, whatever their names."""
    schema = _UNITS + (", data binary" if with_data else "")

    def read(batches):
        for b in batches:
            for a in range(0, len(b), 256):
                part, rows, data = b.slice(a, 256), [], []
                for doc, view in zip(part.column(0).to_pylist(), byte_views(part.column(1))):
                    if view is None:
                        continue
                    for k, u in enumerate(demux(view).units):
                        rows.append((doc, k, u.program, u.pid, u.stream_type, u.pts, u.dts, u.random_access, u.broken, len(u.data), hashlib.md5(u.data).hexdigest()))
                        if with_data:
                            data.append(u.data)
                columns = list(zip(*rows)) if rows else [()] * 11
                kinds = [pa.int64(), *[pa.int32()] * 4, pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.string()]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds)] + ([pa.array(data, pa.binary())] if with_data else [])
                yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in schema.split(", ")])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).cast("binary").alias("media")).mapInArrow(read, schema)


def stream_summary(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for each row: (doc_id, packets, skipped_bytes, discontinuities, duplicates, bad_sections, units, random_access_points); null media give nulls, empty ones zeros."""

    def read(batches):
        for b in batches:
            rows = []
            for doc, view in zip(b.column(0).to_pylist(), byte_views(b.column(1))):
                s = demux(view) if view is not None else None
                rows.append((doc, *s[:5], len(s.units), sum(u.random_access for u in s.units)) if s else (doc, *[None] * 7))
            columns = list(zip(*rows)) if rows else [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.int32(), pa.int64(), *[pa.int32()] * 5])], names=[x.split()[0] for x in _SUMMARY.split(", ")])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).cast("binary").alias("media")).mapInArrow(read, _SUMMARY)


def text_streams(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tick: int = 3600, every: int = 8) -> DataFrame:
    """(doc_id, media): each row's text as a transport stream, a unit for each line, ``tick`` 90 kHz ticks apart, every ``every``-th one a random-access point. A null text gives null media."""

    small_batches(df.sparkSession)

    def write(batches):
        for b in batches:
            for a in range(0, len(b), 1024):
                part, out = b.slice(a, 1024), []
                for t in part.column(1).to_pylist():
                    lines = t.encode("utf-8", "replace").split(b"\n") if t is not None else []
                    out.append(None if t is None else mux(lines, [tick * k for k in range(len(lines))], [k % every == 0 for k in range(len(lines))]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], names=["doc_id", "media"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(write, "doc_id long, media binary")
