"""PDF text and outlines, as far as it takes: objects found by scanning, Flate streams, simple fonts."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import Counter

from ..functions.guards import TOTAL
from ..functions.text import title_mask
from .markup import block

_OBJECT = re.compile(rb"(?<![\d])(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|[-+]?\d*\.?\d+|/[^\s<>\[\]()/]*|[A-Za-z'\"*]+[0-9*]?", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _string(token: bytes) -> str:
    if token[:1] == b"<":
        hexes = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((hexes + b"0" * (len(hexes) % 2)).decode())
    else:
        raw = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() and m[1][:1] < b"8" else _ESCAPES.get(m[1], b"" if m[1].strip() == b"" else m[1]), token[1:-1], flags=re.S)
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")


def _objects(data: bytes) -> dict[int, bytes]:
    return _packed_objects({int(m[1]): m[2] for m in _OBJECT.finditer(data)})


def _packed_objects(found: dict[int, bytes]) -> dict[int, bytes]:
    for body in list(found.values()):  # objects that are packed in streams
        if b"/ObjStm" in body and (s := _stream(body)) is not None:
            n, first = (int(m[1]) if (m := re.search(k, body)) else 0 for k in (rb"/N\s+(\d+)", rb"/First\s+(\d+)"))
            head = [int(x) for x in s[:first].split()[: 2 * n]]
            for k, (num, at) in enumerate(zip(head[::2], head[1::2])):
                end = head[2 * k + 3] if 2 * k + 3 < len(head) else len(s) - first
                found.setdefault(num, s[first + at : first + end])
    return found


def _stream(body: bytes) -> bytes | None:
    m = re.search(rb"stream\r?\n", body)
    if not m:
        return None
    raw = body[m.end() :].rsplit(b"endstream", 1)[0]
    if b"/FlateDecode" not in body[: m.start()]:
        return raw
    try:
        d = zlib.decompressobj()
        out = d.decompress(raw, TOTAL)
        return None if d.unconsumed_tail else out  # more than a file may give: refused, not cut
    except zlib.error:
        return None


def _refs(body: bytes, key: bytes) -> list[int]:
    m = re.search(key + rb"\s*(?:\[([^\]]*)\]|(\d+\s+\d+\s+R))", body)
    return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1] if m[1] is not None else m[2])] if m else []


_PAD = bytes.fromhex("28bf4e5e4e758a4164004e56fffa01082e2e00b6d0683e802f0ca9fe6453697a")


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = j + s[i] + key[i % len(key)] & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for k, c in enumerate(data):
        i = i + 1 & 255
        j = j + s[i] & 255
        s[i], s[j] = s[j], s[i]
        out[k] = c ^ s[s[i] + s[j] & 255]
    return bytes(out)


def _literal(token: bytes) -> bytes:
    if token[:1] == b"<":
        hexes = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((hexes + b"0" * (len(hexes) % 2)).decode())
    return re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() and m[1][:1] < b"8" else _ESCAPES.get(m[1], b"" if m[1].strip() == b"" else m[1]), token[1:-1], flags=re.S)


_STRING = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|(?<!<)<[0-9A-Fa-f\s]*>(?!>)", re.S)


def _file_key(data: bytes, objects: dict[int, bytes]) -> bytes | None:
    """The key of a file whose user password is empty; None if it has another, or a cipher that isn't here."""
    tail = data[max(0, data.rfind(b"/Encrypt") - 2000) :]
    ref = re.search(rb"/Encrypt\s+(\d+)\s+\d+\s+R", tail)
    said = objects.get(int(ref[1]), b"") if ref else b""
    ids = re.search(rb"/ID\s*\[\s*(<[0-9A-Fa-f\s]*>|\((?:\\.|[^\\()])*\))", tail, re.S)
    owner, user = (re.search(k + rb"\s*(\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>)", said, re.S) for k in (rb"/O", rb"/U"))
    number = lambda k, default: int(m[1]) if (m := re.search(k + rb"\s+(-?\d+)", said)) else default
    version, revision, rights, size = number(rb"/V", 0), number(rb"/R", 0), number(rb"/P", 0), number(rb"/Length", 40) // 8
    if version not in (1, 2) or revision not in (2, 3) or not owner or not user or not 5 <= size <= 16:
        return None
    size = 5 if revision == 2 else size
    first = _literal(ids[1]) if ids else b""
    key = hashlib.md5(_PAD + _literal(owner[1])[:32] + struct.pack("<i", rights if rights < 1 << 31 else rights - (1 << 32)) + first).digest()
    for _ in range(50 if revision == 3 else 0):
        key = hashlib.md5(key[:size]).digest()
    key = key[:size]
    if revision == 2:
        want = rc4(key, _PAD)
    else:
        want = hashlib.md5(_PAD + first).digest()
        for k in range(20):
            want = rc4(bytes(c ^ k for c in key), want)
    return key if _literal(user[1])[: len(want)] == want else None


def _opened(data: bytes, objects: dict[int, bytes], key: bytes) -> dict[int, bytes]:
    """The objects with their strings and streams decrypted; the one that tells of the encryption stays as it is."""
    ref = re.search(rb"/Encrypt\s+(\d+)", data)
    out = {}
    for k, body in objects.items():
        if ref and k == int(ref[1]):
            continue
        own = hashlib.md5(key + k.to_bytes(3, "little") + bytes(2)).digest()[: min(16, len(key) + 5)]
        m = re.search(rb"stream\r?\n", body)
        head, rest = (body[: m.start()], body[m.start() :]) if m else (body, b"")
        head = _STRING.sub(lambda x: b"<" + rc4(own, _literal(x[0])).hex().encode() + b">", head)
        if m:
            raw = rest[m.end() - m.start() :].rsplit(b"endstream", 1)[0]
            length = re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", head)
            raw = raw[: int(length[1])] if length else re.sub(rb"\r?\n$", b"", raw)
            rest = b"stream\n" + rc4(own, raw) + b"\nendstream"
        out[k] = head + rest
    return out


def png(width: int, height: int, channels: int, data: bytes) -> bytes:
    """An image of 8 bits a channel, grey or RGB, as PNG."""
    row = width * channels
    packed = zlib.compress(b"".join(b"\0" + data[k * row : (k + 1) * row] for k in range(height)), 6)
    part = lambda name, x: struct.pack(">I", len(x)) + name + x + struct.pack(">I", zlib.crc32(name + x))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0 if channels == 1 else 2, 0, 0, 0)) + part(b"IDAT", packed) + part(b"IEND", b"")


def page_images(objects: dict[int, bytes], page: int) -> tuple[list[tuple[str, bytes]], list[str], bool]:
    """(name, bytes) of a page's images, why others couldn't be taken, and whether there is any: JPEG as it is, plain grey and RGB as PNG."""
    out, skipped, any_ = [], [], False
    body, up = objects.get(page, b""), 0
    while b"/Resources" not in body and up < 64 and (parent := _refs(body, rb"/Parent")):
        body, up = objects.get(parent[0], b""), up + 1
    shared = [objects.get(r, b"") for r in _refs(body, rb"/Resources")]
    for holder in [*shared, body]:
        m = re.search(rb"/XObject\s*(?:<<(.*?)>>|(\d+)\s+\d+\s+R)", holder, re.S)
        if not m:
            continue
        listed = m[1] if m[1] is not None else objects.get(int(m[2]), b"")
        for k in map(int, re.findall(rb"/[^\s/<>]+\s+(\d+)\s+\d+\s+R", listed)):
            data = objects.get(k, b"")
            cut = re.search(rb"stream\r?\n", data)
            head = data[: cut.start()] if cut else data
            if not cut or not re.search(rb"/Subtype\s*/Image\b", head):
                continue
            any_ = True
            kinds = re.findall(rb"/([A-Za-z0-9]+)", f[1] if f[1] is not None else f[2]) if (f := re.search(rb"/Filter\s*(?:\[([^\]]*)\]|(/[A-Za-z0-9]+))", head)) else []
            number = lambda key, default: int(v[1]) if (v := re.search(key + rb"\s+(\d+)", head)) else default  # noqa: B023, E731
            if kinds[-1:] == [b"DCTDecode"]:
                raw = data[cut.end() :].rsplit(b"endstream", 1)[0]
                out.append((f"pdf-image-{k}-0.jpg", re.sub(rb"\r?\n$", b"", raw)))
            elif kinds[-1:] == [b"FlateDecode"]:
                bits, width, height = number(rb"/BitsPerComponent", 8), number(rb"/Width", 0), number(rb"/Height", 0)
                space = re.search(rb"/ColorSpace\s*/(DeviceRGB|DeviceGray)\b", head)
                channels = 3 if space and space[1] == b"DeviceRGB" else 1
                raw = _stream(data) if space and bits == 8 else b""
                why = f"FlateDecode({bits}bpc)" if bits != 8 else "FlateDecode(colorspace)" if not space else "FlateDecode(decompress)" if raw is None else "FlateDecode(dims)" if width * height * channels > TOTAL else "FlateDecode(short)" if len(raw) < width * height * channels else ""
                if why:
                    skipped.append(why)
                else:
                    out.append((f"pdf-image-{k}-0.png", png(width, height, channels, raw)))
            else:
                skipped.append(kinds[-1].decode() if kinds else "unknown")
        break
    return out, skipped, any_


def page_runs(content: bytes) -> list[tuple[float, float, float, str]]:
    """(x, y, size, text) of the text that a content stream shows; blank runs are left out."""
    out, stack, operands = [], [], []
    mult = lambda m, n: (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])
    unit = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    ctm = tm = line = unit
    size = leading = 0.0
    saved = []

    def show(text: str) -> None:
        m = mult(tm, ctm)
        if text.strip():
            out.append((m[4], m[5], abs(size * m[3]) or abs(size), text))

    for t in _TOKEN.finditer(content):
        t = t[0]
        c = t[:1]
        if c in b"(<" and c:
            operands.append(_string(t))
        elif c in b"[":
            stack, operands = [operands], []
        elif c == b"]":
            operands = [*(stack.pop() if stack else []), operands]
        elif c in b"/":
            operands.append(t.decode("latin-1"))
        elif re.fullmatch(rb"[-+]?\d*\.?\d+", t):
            operands.append(float(t))
        else:
            if stack:
                continue
            nums = [x for x in operands if isinstance(x, float)]
            match t:
                case b"q":
                    saved.append(ctm)
                case b"Q":
                    ctm = saved.pop() if saved else ctm
                case b"cm" if len(nums) == 6:
                    ctm = mult(tuple(nums), ctm)
                case b"BT":
                    tm = line = unit
                case b"Tf" if nums:
                    size = nums[-1]
                case b"TL" if nums:
                    leading = nums[-1]
                case b"Tm" if len(nums) == 6:
                    tm = line = tuple(nums)
                case b"Td" | b"TD" if len(nums) >= 2:
                    leading = -nums[1] if t == b"TD" else leading
                    tm = line = mult((1, 0, 0, 1, nums[0], nums[1]), line)
                case b"T*":
                    tm = line = mult((1, 0, 0, 1, 0, -leading), line)
                case b"Tj" if operands and isinstance(operands[-1], str):
                    show(operands[-1])
                case b"'" | b'"' if operands and isinstance(operands[-1], str):
                    tm = line = mult((1, 0, 0, 1, 0, -leading), line)
                    show(operands[-1])
                case b"TJ" if operands and isinstance(operands[-1], list):
                    show("".join(x if isinstance(x, str) else " " if x <= -100 else "" for x in operands[-1] if isinstance(x, str | float)))
            operands = []
    return out


def _lines(runs):
    """The rule of ``operators.layout.group_lines`` and ``lines``, for one page in memory."""
    out = []
    for x, y, size, text in sorted(runs, key=lambda r: (-r[1], r[0])):
        if out and abs(out[-1]["y"] - y) <= max(0.5 * size, 2):
            out[-1] |= {"size": max(out[-1]["size"], size), "text": out[-1]["text"] + ("" if text.startswith(" ") else " ") + text.strip()}
        else:
            out.append({"y": y, "size": size, "text": text.strip()})
    for line in out:
        line["text"] = line["text"].strip()
    return [line for line in out if line["text"]]


def parse_pdf(data: bytes, path: str):
    from .containers import Rejected

    objects = _objects(data)
    if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
        key = _file_key(data, objects)
        if key is None:
            raise Rejected("encrypted content")
        objects = _packed_objects(_opened(data, objects, key))
    root = next((b for b in objects.values() if re.search(rb"/Type\s*/Catalog", b)), b"")
    pages, seen, todo = [], set(), _refs(root, b"/Pages")[::-1]
    while todo:
        k = todo.pop()
        if k in seen or k not in objects:
            continue
        seen.add(k)
        if re.search(rb"/Type\s*/Page\b(?!s)", objects[k]):
            pages.append(k)
        else:
            todo += _refs(objects[k], b"/Kids")[::-1]
    outline = _outline(objects, root, pages)
    lines = [_lines(page_runs(b"\n".join(s for r in _refs(objects[k], b"/Contents") if (s := _stream(objects.get(r, b""))) is not None))) for k in pages]
    counted = Counter(round(x["size"]) for page in lines for x in page)
    body = min(counted, key=lambda s: (-counted[s], s)) if counted else 0
    out, assets, known = [], [], {}
    for number, page in enumerate(lines, 1):
        titles = outline.get(number, [])
        out += [block("heading", level=lv, text=t) for lv, t in titles]
        begin = len(out) - len(titles)
        printed = title_mask([x["text"] for x in page], [t for _, t in titles])
        last = None
        for x, again in zip(page, printed):
            ratio = x["size"] / body if body and not outline else 0
            level = 1 if ratio >= 1.8 else 2 if ratio >= 1.4 else 3 if ratio >= 1.15 else None
            if again:
                last = None
            elif level:
                out.append(block("heading", level=level, text=x["text"]))
                last = None
            elif last is not None and last["y"] - x["y"] <= 1.5 * max(last["size"], x["size"]):
                out[-1]["text"] += " " + x["text"]
                last = x
            else:
                out.append(block("para", text=x["text"]))
                last = x
        images, skipped, image = page_images(objects, pages[number - 1])
        for name, bytes_ in images:
            if name not in known:
                known[name] = f"{len(assets):03d}-{name}"
                assets.append({"key": name, "filename": known[name], "bytes": bytes_})
            out.append(block("figure", asset=known[name]))
        if image and not page:
            out.append(block("raw", text="scanned page: no text layer; OCR not enabled"))
        out += [block("raw", text=f"image not extracted (filter: {x})") for x in skipped]
        if not page and not titles and not image:
            out.append(block("raw", text=f"page {number}: no extractable text"))
        for b in out[begin:]:
            b["page"] = number
    for b in out:
        b["spans"] = [{"depth": 0, "kind": "text", "text": b["text"], "target": None}] if b["kind"] not in ("raw", "figure") else []
    info = next((objects[r] for r in _refs(data[data.rfind(b"trailer") :], b"/Info") if r in objects), b"")
    field = lambda key: (_string(m[1]).strip() if (m := re.search(key + rb"\s*(\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>)", info, re.S)) else "")
    name = path.rpartition("/")[2]
    return {"title": field(rb"/Title") or name.removesuffix(".pdf"), "authors": [x for x in [field(rb"/Author")] if x], "language": None, "source_format": "pdf"}, out, assets


def _outline(objects: dict[int, bytes], root: bytes, pages: list[int]) -> dict[int, list[tuple[int, str]]]:
    """Page -> (level, title) of its outline items; an outline that runs in circles or is too large or deep is dropped whole."""
    out: dict[int, list[tuple[int, str]]] = {}
    top = next((objects.get(r, b"") for r in _refs(root, b"/Outlines")), b"")
    todo, seen = [(r, 1) for r in _refs(top, b"/First")], set()
    place = {k: n for n, k in enumerate(pages, 1)}
    while todo:
        k, depth = todo.pop()
        if k in seen or depth > 64 or len(seen) > 10_000:
            return {}
        if k not in objects:
            continue
        seen.add(k)
        body = objects[k]
        todo += [(r, depth) for r in _refs(body, b"/Next")] + [(r, depth + 1) for r in _refs(body, b"/First")]
        m = re.search(rb"/Title\s*(\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>)", body, re.S)
        d = re.search(rb"/D(?:est)?\s*\[\s*(\d+)\s+\d+\s+R", body)
        title, page = _string(m[1]).strip() if m else "", place.get(int(d[1])) if d else None
        if title and page:
            out.setdefault(page, []).append((min(depth, 6), title))
    return out
