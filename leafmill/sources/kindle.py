"""What MOBI and AZW3 books hold beside plain text: index tables, skeletons and fragments, markers at byte positions, and Huffman-coded records.

Nothing here trusts a table: ``Damaged`` says that one can't be read at all, and a skeleton whose numbers don't fit spoils its own part alone.
"""

from __future__ import annotations

import re
import struct
from typing import NamedTuple

#: What stands for a part that couldn't be put together.
DAMAGED = b"<body><p>[unreadable section: damaged KF8 index]</p></body>"
_CONTROLS = {k: k for k in range(0x80, 0xA0)} | {k: ord(bytes([k]).decode("cp1252")) for k in range(0x80, 0xA0) if k not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


class Damaged(Exception):
    pass


def cp1252(data: bytes) -> str:
    """Windows Latin as browsers read it: the five bytes that have no character are control characters."""
    return data.decode("latin-1").translate(_CONTROLS)


def _u16(data: bytes, at: int) -> int:
    if at < 0 or at + 2 > len(data):
        raise Damaged("kf8: truncated index")
    return struct.unpack_from(">H", data, at)[0]


def _u32(data: bytes, at: int) -> int:
    if at < 0 or at + 4 > len(data):
        raise Damaged("kf8: truncated index")
    return struct.unpack_from(">I", data, at)[0]


def forward_number(data: bytes, at: int) -> tuple[int, int]:
    """(number, place after it): seven bits a byte, the first the highest, the last byte marked."""
    value = 0
    for k in range(at, at + 8):
        if k >= len(data):
            break
        value = value << 7 | data[k] & 0x7F
        if data[k] & 0x80:
            return value, k + 1
    raise Damaged("kf8: lying index entry")


def read_index(records: list[bytes], first: int) -> list[tuple[bytes, dict[int, list[int]]]]:
    """(name, tag -> values) of each entry of the index whose head is record ``first``."""
    if not 0 < first < len(records) or records[first][:4] != b"INDX":
        raise Damaged("kf8: not an INDX record")
    head = records[first]
    size, count = _u32(head, 4), _u32(head, 0x18)
    if not 0 < count <= 4096:
        raise Damaged("kf8: implausible index record count")
    if head[size : size + 4] != b"TAGX":
        raise Damaged("kf8: TAGX missing")
    length, controls = _u32(head, size + 4), _u32(head, size + 8)
    if not 1 <= controls <= 4 or length < 16:
        raise Damaged("kf8: implausible TAGX")
    table = [tuple(head[p : p + 4]) for p in range(size + 12, min(size + length, len(head)) - 3, 4)]
    out = []
    for r in range(first + 1, first + 1 + count):
        data = records[r] if r < len(records) else b""
        if data[:4] != b"INDX":
            raise Damaged("kf8: bad index data record")
        places, n = _u32(data, 0x14), _u32(data, 0x18)
        if data[places : places + 4] != b"IDXT" or n > 65_536:
            raise Damaged("kf8: lying IDXT")
        out += [_entry(data, _u16(data, places + 4 + 2 * k), controls, table) for k in range(n)]
    return out


def _entry(data: bytes, at: int, controls: int, table: list[tuple[int, ...]]) -> tuple[bytes, dict[int, list[int]]]:
    start = at + 1 + (data[at] if at < len(data) else 0)
    at_values = start + controls
    if at_values > len(data):
        raise Damaged("kf8: lying index entry")
    tags, byte = {}, 0
    for tag, each, mask, end in table:
        if end == 1:
            byte += 1
            continue
        if byte >= controls:
            raise Damaged("kf8: lying index entry")
        bits = data[start + byte] & mask
        if not bits:
            continue
        values = []
        if bits == mask and mask.bit_count() > 1:  # the values' bytes are told, not their number
            size, at_values = forward_number(data, at_values)
            stop = at_values + size
            if stop > len(data):
                raise Damaged("kf8: lying index entry")
            while at_values < stop:
                value, at_values = forward_number(data, at_values)
                values.append(value)
        else:
            for _ in range((bits >> (mask & -mask).bit_length() - 1) * each):
                value, at_values = forward_number(data, at_values)
                values.append(value)
        tags[tag] = values
    return data[at + 1 : start], tags


class Skeleton(NamedTuple):
    fragments: int
    start: int
    size: int


class Fragment(NamedTuple):
    place: int
    size: int


def skeletons(index) -> list[Skeleton]:
    return [Skeleton(t[1][0], t[6][0], t[6][1]) for _, t in index if t.get(1) and len(t.get(6, ())) > 1]


def fragments(index) -> list[Fragment]:
    return [Fragment(int(name), t[6][1]) for name, t in index if re.fullmatch(rb"\+?[0-9]{1,19}", name) and len(t.get(6, ())) > 1]


def assembled(raw: bytes, skels: list[Skeleton], frags: list[Fragment]) -> tuple[list[bytes], list[tuple[int, int] | None]]:
    """(parts, for each fragment its part and place there): behind each skeleton lie its fragments, and each goes to its place in the skeleton's own bytes, so behind those before it. A
    skeleton or fragment that reaches beyond what there is makes its part DAMAGED, and no link leads to that part's fragments."""
    parts, where, k = [], [None] * len(frags), 0
    for number, s in enumerate(skels):
        own, stop = frags[k : k + s.fragments], s.start + s.size
        ok = stop <= len(raw) and k + s.fragments <= len(frags)
        if ok:
            pieces, at, grown, told = [], 0, 0, []
            for f in own:
                place = f.place - s.start
                ok = 0 <= place <= s.size and stop + f.size <= len(raw)
                if not ok:
                    break
                told.append((place + grown, raw[stop : stop + f.size]))
                stop, grown = stop + f.size, grown + f.size
        if ok:
            part = raw[s.start : s.start + s.size]
            if all(a <= b for (a, _), (b, _) in zip(told, told[1:])) and all(p >= q + len(x) for (q, x), (p, _) in zip(told, told[1:])):  # in order: one pass
                shift = 0
                for place, data in told:
                    pieces += [part[at : place - shift], data]
                    at, shift = place - shift, shift + len(data)
                part = b"".join([*pieces, part[at:]])
            else:
                for place, data in told:
                    part = part[:place] + data + part[place:]
            for i, (place, _) in enumerate(told):
                where[k + i] = (number, place)
            parts.append(part)
        else:
            parts.append(DAMAGED)
        k = min(k + s.fragments, len(frags))
    return parts, where


def base32(text: str) -> int | None:
    return int(text, 32) if re.fullmatch("[0-9A-Va-v]+", text) else None


_POSITION = re.compile(rb"kindle:pos:fid:[^\"'<> \t\n]*")


def positions(parts: list[bytes]) -> list[str]:
    """The different ``kindle:pos`` addresses of the parts."""
    return sorted({m.decode("utf-8") for p in parts for m in _POSITION.findall(p) if _is_utf8(m)})


def _is_utf8(data: bytes) -> bool:
    try:
        data.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def resolved_position(address: str, where: list[tuple[int, int] | None]) -> tuple[int, int] | None:
    """(part, byte) of an address: a fragment by its number, and so many bytes behind its beginning."""
    m = re.fullmatch(r"kindle:pos:fid:([0-9A-Va-v]+):off:([0-9A-Va-v]+)", address)
    if not m or int(m[1], 32) >= len(where) or (place := where[int(m[1], 32)]) is None:
        return None
    return place[0], place[1] + int(m[2], 32)


def marked(raw: bytes, offsets: list[int], prefix: str) -> bytes:
    """``raw`` with ``<a id="prefix + offset"></a>`` at each offset: before the next tag, or behind the heading that opens there. One pass over the sorted offsets."""
    places, lt, closes = [], -1, {}
    for o in sorted(set(offsets)):
        start = min(o, len(raw))
        if start > lt:
            lt = raw.find(b"<", start)
            lt = len(raw) if lt < 0 else lt
        at = lt
        level = raw[lt + 2 : lt + 3]
        if raw[lt + 1 : lt + 2] == b"h" and level in (b"1", b"2", b"3", b"4", b"5", b"6"):
            close = closes.get(level, -2)
            if close != -1 and close < lt:
                close = closes[level] = raw.find(b"</h" + level, lt)
            end = raw.find(b">", close) if close >= 0 else -1
            at = end + 1 if end >= 0 else lt
        places.append((at, o))
    out, done = [], 0
    for at, o in sorted(places, key=lambda p: p[0]):
        out += [raw[done:at], b'<a id="%s%d"></a>' % (prefix.encode(), o)]
        done = max(done, at)
    return b"".join([*out, raw[done:]])


class Huffman:
    """The records of a book under compression 17480: a table of code lengths and a dictionary of phrases, which are coded themselves until they are first needed."""

    def __init__(self, huff: bytes, phrases: list[bytes]):
        if huff[:4] != b"HUFF" or not phrases:
            raise Damaged("huffman: no table")
        first, second = _u32(huff, 8), _u32(huff, 12)
        self.lengths = []
        for k in range(256):
            v = _u32(huff, first + 4 * k)
            bits = v & 31
            if not bits:
                raise Damaged("huffman: a code of no bits")
            self.lengths.append((bits, bool(v & 0x80), ((v >> 8) + 1 << 32 - bits) - 1))
        low, high = [0], [0]
        for bits in range(1, 33):
            low.append(_u32(huff, second + 8 * bits - 8) << 32 - bits)
            high.append((_u32(huff, second + 8 * bits - 4) + 1 << 32 - bits) - 1)
        self.low, self.high = low, high
        self.phrases: list[list] = []
        for data in phrases:
            if data[:4] != b"CDIC":
                raise Damaged("huffman: no dictionary")
            total, bits = _u32(data, 8), _u32(data, 12)
            for k in range(min(1 << min(bits, 16), total - len(self.phrases))):
                at = 16 + _u16(data, 16 + 2 * k)
                size = _u16(data, at)
                self.phrases.append([data[at + 2 : at + 2 + (size & 0x7FFF)], bool(size & 0x8000)])

    def decoded(self, data: bytes, most: int, depth: int = 0) -> bytes:
        """At most ``most`` bytes of a record; a code of no phrase, or phrases that hold themselves, raise Damaged."""
        if depth > 32:
            raise Damaged("huffman: phrases without end")
        left, out, size = 8 * len(data), [], 0
        bits, at, padded = 0, 0, data + bytes(8)
        while True:
            window = int.from_bytes(padded[at >> 3 : (at >> 3) + 8], "big") >> 32 - (at & 7) & 0xFFFFFFFF
            bits, ends, high = self.lengths[window >> 24]
            if not ends:
                while bits < 32 and window < self.low[bits]:
                    bits += 1
                high = self.high[bits]
            left -= bits
            if left < 0 or size > most:
                return b"".join(out)
            k = high - window >> 32 - bits
            at += bits
            if not 0 <= k < len(self.phrases):
                raise Damaged("huffman: a code of no phrase")
            phrase = self.phrases[k]
            if not phrase[1]:
                phrase[:] = [self.decoded(phrase[0], most, depth + 1), True]
            out.append(phrase[0])
            size += len(phrase[0])
