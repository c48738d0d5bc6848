"""DjVu documents: pages, their dimensions and their text layer, as far as it isn't compressed by the format's own coder, for which there is no decoder here.

A page whose text can't be read, and one that has none, gets a note. Depths, counts and offsets are bounded; what a zone claims beyond its data ends the page's text.
"""

from __future__ import annotations

import posixpath
import struct
from collections import Counter
from typing import NamedTuple

from .markup import block

KINDS = {1: "page", 2: "column", 3: "region", 4: "para", 5: "line", 6: "word", 7: "char"}
DEPTH, ZONES, PAGES = 64, 500_000, 100_000


class Zone(NamedTuple):
    kind: str
    box: tuple[int, int, int, int]
    text: str
    children: list


def chunks(data: bytes, at: int, end: int):
    """(name, its data's bounds) of the chunks of a form."""
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from(">I", data, at + 4)[0]
        stop = at + 8 + size
        if stop > end:
            return
        yield name, at + 8, stop
        at = stop + (stop & 1)


def pages(data: bytes) -> list[tuple[int, int]]:
    """The bounds of each page's chunks. An indirect document, whose pages are files of their own, raises ValueError, as does anything else that isn't a document."""
    if data[:8] != b"AT&TFORM" or len(data) < 16:
        raise ValueError("not a DjVu document")
    end, kind = min(len(data), 12 + struct.unpack_from(">I", data, 8)[0]), data[12:16]
    if kind == b"DJVU":
        return [(16, end)]
    if kind != b"DJVM":
        raise ValueError("not a DjVu document")
    out = []
    for name, a, b in chunks(data, 16, end):
        if name == b"DIRM" and b > a and not data[a] & 0x80:
            raise ValueError("indirect DjVu documents are not supported")
        if name == b"FORM" and data[a : a + 4] == b"DJVU" and len(out) < PAGES:
            out.append((a + 4, b))
    return out


def text_layer(data: bytes) -> Zone | None:
    """The zones of a text layer; None if it can't be read."""
    try:
        size = int.from_bytes(data[:3], "big")
        text, at = data[3 : 3 + size], 4 + size
        left = [ZONES]

        def number(n: int) -> int:
            nonlocal at
            if at + n > len(data):
                raise ValueError
            at += n
            return int.from_bytes(data[at - n : at], "big")

        def zone(parent, before, depth: int):
            left[0] -= 1
            if depth > DEPTH or left[0] < 0:
                raise ValueError
            kind = number(1)
            x, y, w, h, start = (number(2) - 0x8000 for _ in range(5))
            length = number(3)
            if before is not None:
                box, told = before
                x, y = (x + box[0], box[1] - (y + h)) if kind in (1, 4, 5) else (x + box[2], y + box[1])
                start += told
            elif parent is not None:
                box, told = parent
                x, y, start = x + box[0], box[3] - (y + h), start + told
            own, children, last = (x, y, x + w, y + h), [], None
            for _ in range(number(3)):
                child, span = zone((own, start), last, depth + 1)
                children.append(child)
                last = child.box, span[1]
            return Zone(KINDS.get(kind, "char"), own, text[max(0, start) : max(0, start + length)].decode("utf-8", "replace"), children), (start, start + length)

        return zone(None, None, 0)[0] if at < len(data) else None
    except (ValueError, IndexError):
        return None


def lines(root: Zone | None) -> list[tuple[str, int, bool]]:
    """(text, height, whether a paragraph starts) of a page's lines in reading order; where there are no line zones, of the deepest zones that have text."""
    if root is None:
        return []
    out, state = [], [True]

    def walk(z: Zone) -> None:
        if z.kind == "line":
            words = " ".join(c.text.strip() for c in z.children if c.kind in ("word", "char") and c.text.strip())
            text = " ".join(z.text.split()) or words
            if text:
                out.append((text, z.box[3] - z.box[1], state[0]))
                state[0] = False
            return
        if z.kind in ("page", "column", "region", "para"):
            state[0] = True
        for c in z.children:
            walk(c)

    def deepest(z: Zone) -> None:
        if any(_has_text(c) for c in z.children):
            for c in z.children:
                deepest(c)
        elif z.text.strip():
            out.append((" ".join(z.text.split()), z.box[3] - z.box[1], z.kind in ("page", "column", "region", "para")))

    walk(root)
    if not out:
        deepest(root)
    return out


def _has_text(z: Zone) -> bool:
    return bool(z.text.strip()) or any(map(_has_text, z.children))


def parse_djvu(data: bytes, path: str):
    from .containers import Rejected

    try:
        bounds = pages(data)
    except ValueError as e:
        raise Rejected(f"malformed input: {e}") from e
    found = []
    for a, b in bounds:
        layer, image = None, False
        for name, x, y in chunks(data, a, b):
            if name == b"TXTa" and layer is None:
                layer = text_layer(data[x:y])
            image |= name in (b"Sjbz", b"BG44", b"FG44", b"BGjp", b"FGjp", b"Smmr")
        found.append((lines(layer), image))
    sizes = Counter(h for page, _ in found for _, h, _ in page)
    body = min(sizes, key=lambda s: (-sizes[s], s)) if sizes else 0
    out = []
    for number, (page, image) in enumerate(found, 1):
        begin, open_ = len(out), False
        for text, height, starts in page:
            ratio = height / body if body else 0
            level = 1 if ratio >= 1.8 else 2 if ratio >= 1.4 else 3 if ratio >= 1.15 else None
            if level:
                out.append(block("heading", level=level, text=text))
            elif open_ and not starts:
                out[-1]["text"] += " " + text
            else:
                out.append(block("para", text=text))
            open_ = level is None
        if not page:
            out.append(block("raw", text="scanned page: no text layer; OCR not enabled" if image else f"page {number}: no extractable text"))
        for x in out[begin:]:
            x["page"] = number
            x["spans"] = [{"depth": 0, "kind": "text", "text": x["text"], "target": None}] if x["kind"] != "raw" else []
    return {"title": posixpath.splitext(posixpath.basename(path))[0] or "Untitled", "authors": [], "language": None, "source_format": "djvu"}, out, []
