"""EPUB, PPTX, MOBI/AZW3 and PDF files as blocks.

Each parser takes bytes and gives (metadata, blocks, assets) or raises ``Rejected``; ``documents`` runs them over a table of files, one row of Arrow in, many out, and turns whatever goes wrong with
one file into a row that says so. Nothing here trusts a length, an offset or a reference that a file declares.
"""

from __future__ import annotations

import io
import posixpath
import re
import struct
import urllib.parse
import xml.etree.ElementTree as ET
import zipfile
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.guards import RATIO, TOTAL
from . import kindle
from .djvu import parse_djvu
from .markup import BLOCK, NAMES, block, blocks
from .math import omml_latex
from .pdf import parse_pdf


class Rejected(Exception):
    """Why a file wasn't converted: unsupported, protected, malformed, a bomb."""


# ---------------------------------------------------------------- ZIP


class Archive:
    """Entries of a ZIP file within the limits of what may come of it."""

    def __init__(self, data: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except (zipfile.BadZipFile, ValueError, struct.error) as e:
            raise Rejected(f"malformed input: {e}") from e
        self.total = 0

    def read(self, name: str) -> bytes | None:
        try:
            info = self.zip.getinfo(name)
        except KeyError:
            return None
        if self.total + info.file_size > TOTAL or info.compress_size and info.file_size // info.compress_size > RATIO:
            raise Rejected("input rejected: decompression bomb")
        try:
            with self.zip.open(info) as f:
                data = f.read(info.file_size + 1)
        except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, EOFError):
            return None
        self.total += len(data)
        return data


def resolve(base: str, target: str) -> str | None:
    """``guards.resolve_rel`` for one path."""
    out: list[str] = []
    for p in target.split("/") if target.startswith("/") else [*base.split("/"), *target.split("/")]:
        if p == "..":
            if not out:
                return None
            out.pop()
        elif p not in ("", "."):
            out.append(p)
    return "/".join(out) or None


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _attr(e: ET.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def _xml(data: bytes | None) -> ET.Element | None:
    try:
        return ET.fromstring(data) if data else None
    except (ET.ParseError, ValueError, LookupError):
        return None


def safe_name(path: str, n: int) -> str:
    return f"{n:03d}-" + re.sub(r"[^A-Za-z0-9._-]", "_", path.rpartition("/")[2])


# ---------------------------------------------------------------- EPUB


def parse_epub(data: bytes, path: str):
    z = Archive(data)
    container = (z.read("META-INF/container.xml") or b"").decode("utf-8", "replace")
    m = re.search(r"full-path=(['\"])(.*?)\1", container)
    opf = _xml(z.read(m[2])) if m else None
    if opf is None:
        raise Rejected("malformed input: no package document")
    base, title, authors, language, items, order = posixpath.dirname(m[2]), "", [], None, {}, []
    for e in opf.iter():
        name, text = _local(e), (e.text or "").strip()
        if name == "title" and text:
            title = text
        elif name == "creator" and text:
            authors.append(text)
        elif name == "language" and text:
            language = language or text
        elif name == "item":
            items[e.get("id")] = e.get("href", "")
        elif name == "itemref":
            order.append(e.get("idref"))
    out, where, first, notes = [], {}, {}, {}
    for href in (items[i] for i in order if i in items):
        full = resolve(base, urllib.parse.unquote(href))
        page = z.read(full) if full else None
        if page is None:
            continue
        heading = None
        for b in blocks(page.decode("utf-8", "replace"), xml=True):
            b["file"] = full
            if b["kind"] == "heading":
                heading = b
                first.setdefault(full, b)
            for i in b["ids"]:
                where[full, i] = b if b["kind"] == "heading" else heading
            if b["note"]:
                notes.setdefault(b["note"], len(notes) + 1)
            out.append(b)
    _fix_links(out, where, first, notes)
    out = _relocate(out)
    assets = _assets(out, lambda b: z.read(resolve(posixpath.dirname(b["file"]), urllib.parse.unquote(b["asset"])) or ""))
    return {"title": title.strip() or "Untitled", "authors": authors, "language": language, "source_format": "epub"}, out, assets


def _fix_links(out, where, first, notes) -> None:
    """Links to a place inside name the heading's number, ``#n``; those to nowhere lose their target; references to notes that there aren't go."""
    number = {id(b): k for k, b in enumerate(b for b in out if b["kind"] == "heading")}
    for b in out:
        kept = []
        for s in b["spans"]:
            if s["kind"] == "note":
                if s["target"] not in notes:
                    continue
                s["target"] = str(notes[s["target"]])
            elif s["kind"] == "link" and s["target"] and not re.match("[^/#?]*:", s["target"]):
                file, _, frag = s["target"].partition("#")
                full = resolve(posixpath.dirname(b.get("file", "")), urllib.parse.unquote(file)) if file else b.get("file")
                hit = where.get((full, frag)) or first.get(full)
                s["target"] = f"#{number[id(hit)]}" if hit is not None else None
            kept.append(s)
        b["spans"] = kept
        if b["note"]:
            b["note"] = str(notes[b["note"]])


def _relocate(out):
    """Footnotes stand after the block with their first reference, those without one where they were."""
    body = [b for b in out if not b["note"]]
    by: dict[str, list] = {}
    for b in out:
        if b["note"]:
            by.setdefault(b["note"], []).append(b)
    cited = {s["target"] for b in body for s in b["spans"] if s["kind"] == "note"}
    result = []
    for b in out:
        if b["note"]:
            if b["note"] not in cited:
                result.append(b)
            continue
        result.append(b)
        for s in b["spans"]:
            if s["kind"] == "note":
                result += by.pop(s["target"], [])
    return result


def _assets(out, read, suffix=lambda data: ""):
    """The figures' bytes, each once, under the name that the figure then has; a figure without becomes its caption or a note."""
    assets, known = [], {}
    for b in out:
        if b["kind"] != "figure":
            continue
        key = b["asset"] or ""
        if key not in known:
            data = read(b)
            known[key] = safe_name(key, len(assets)) + suffix(data) if data else None
            if data:
                assets.append({"key": key, "filename": known[key], "bytes": data})
        b["asset"] = known[key]
        if known[key] is None:
            caption = (b["caption"] or "").strip()
            b |= {"kind": "para", "text": caption, "spans": [{"depth": 0, "kind": "text", "text": caption, "target": None}]} if caption else {"kind": "raw", "text": f"image unavailable: {key}", "spans": []}
    return assets


# ---------------------------------------------------------------- PPTX


def _rels(z: Archive, part: str) -> dict[str, tuple[str, str, bool]]:
    folder, _, name = part.rpartition("/")
    root, out = _xml(z.read(f"{folder}/_rels/{name}.rels")), {}
    for e in root if root is not None else ():
        rid, target, outside = e.get("Id"), e.get("Target", ""), e.get("TargetMode") == "External"
        where = target if outside else resolve(folder, target)
        if rid and where:
            out[rid] = (e.get("Type", ""), where, outside)
    return out


def _paragraphs(body: ET.Element, rels) -> list[tuple[int, list[dict]]]:
    out = []
    for p in (e for e in body.iter() if _local(e) == "p"):
        level, spans = 0, []
        for e in p:
            match _local(e):
                case "pPr":
                    level = min(31, int(e.get("lvl", "0"))) if e.get("lvl", "0").isdigit() else 0
                case "r" | "fld":
                    text = "".join(t.text or "" for t in e if _local(t) == "t")
                    props = next((x for x in e if _local(x) == "rPr"), None)
                    link = next((rels.get(_attr(x, "id") or "", (0, None, False)) for x in props if _local(x) == "hlinkClick"), None) if props is not None else None
                    depth = 0
                    for kind, on in (("link", bool(link and link[2])), ("emph", props is not None and props.get("i") in ("1", "true")), ("strong", props is not None and props.get("b") in ("1", "true"))):
                        if on:
                            spans.append({"depth": depth, "kind": kind, "text": "", "target": link[1] if kind == "link" else None})
                            depth += 1
                    spans.append({"depth": depth, "kind": "text", "text": text, "target": None})
                case "br":
                    spans.append({"depth": 0, "kind": "text", "text": " ", "target": None})
        for m in (e for e in p.iter() if _local(e) in ("oMath",)):
            spans.append({"depth": 0, "kind": "math", "text": omml_latex(ET.tostring(m, encoding="unicode"))[0], "target": None})
        if any(s["text"].strip() for s in spans):
            out.append((level, spans))
    return out


def _plain(spans) -> str:
    return "".join(s["text"] for s in spans)


def parse_pptx(data: bytes, path: str):
    z = Archive(data)
    deck = _xml(z.read("ppt/presentation.xml"))
    if deck is None:
        raise Rejected("malformed input: no presentation")
    rels = _rels(z, "ppt/presentation.xml")
    order = [_attr(e, "id") for e in deck.iter() if _local(e) == "sldId"]
    order = [next((v for k, v in e.attrib.items() if k.endswith("}id")), None) for e in deck.iter() if _local(e) == "sldId"] or order
    out: list[dict] = []
    media: dict[str, str] = {}
    for seq, part in enumerate((rels[r][1] for r in order if r in rels and rels[r][0].endswith("/slide") and not rels[r][2]), 1):
        slide, own = _xml(z.read(part)), _rels(z, part)
        if slide is None:
            out += [block("heading", level=1, text=f"Slide {seq}"), block("raw", text="unparsable slide")]
            continue
        title, body = None, []
        for shape in slide.iter():
            kind = _local(shape)
            if kind == "sp":
                role = next((e.get("type") for e in shape.iter() if _local(e) == "ph"), None)
                paragraphs = [p for t in shape.iter() if _local(t) == "txBody" for p in _paragraphs(t, own)]
                if role in ("title", "ctrTitle") and title is None:
                    title = " ".join(_plain(s) for _, s in paragraphs)
                elif role not in ("sldNum", "dt", "ftr"):
                    alone = len(paragraphs) == 1 and paragraphs[0][0] == 0
                    body += [block("para" if alone else "item", text=_plain(s), spans=s, depth=lv, ordered=False) for lv, s in paragraphs]
            elif kind == "tbl":
                rows = [[" ".join("".join(t.text or "" for t in p.iter() if _local(t) == "t") for p in c.iter() if _local(p) == "p").replace(" ", " ") for c in r if _local(c) == "tc"] for r in shape if _local(r) == "tr"]
                merged = any(k in c.attrib for r in shape for c in r for k in ("gridSpan", "rowSpan", "hMerge", "vMerge"))
                body.append(block("table", rows=rows, has_merged=merged, text=" ".join(x for r in rows for x in r)))
            elif kind == "pic":
                rid = next((_attr(e, "embed") for e in shape.iter() if _local(e) == "blip"), None)
                alt = next((e.get("descr", "") for e in shape.iter() if _local(e) == "cNvPr"), "")
                if rid in own:
                    body.append(block("figure", asset=own[rid][1], text=alt, caption=alt))
        out.append(block("heading", level=1, text=(title or "").strip() or f"Slide {seq}"))
        out += body
        notes = next((v[1] for v in own.values() if v[0].endswith("/notesSlide")), None)
        tree = _xml(z.read(notes)) if notes else None
        if tree is not None:
            said = [p for shape in tree.iter() if _local(shape) == "sp" and any(e.get("type") == "body" for e in shape.iter() if _local(e) == "ph") for p in _paragraphs(shape, {})]
            if said:
                lead = [{"depth": 0, "kind": "strong", "text": "", "target": None}, {"depth": 1, "kind": "text", "text": "Notes", "target": None}]
                out.append(block("para", text="Notes", spans=lead))
                out += [block("para", text=_plain(s), spans=s) for _, s in said]
    for b in out:
        if b["kind"] == "heading" and not b["spans"]:
            b["spans"] = [{"depth": 0, "kind": "text", "text": b["text"], "target": None}]
    assets = _assets(out, lambda b: z.read(b["asset"]))
    return {"title": posixpath.splitext(posixpath.basename(path))[0] or "Untitled", "authors": [], "language": None, "source_format": "pptx"}, out, assets


# ---------------------------------------------------------------- MOBI and AZW3


def palmdoc(data: bytes) -> bytes:
    """PalmDoc's LZ77; a bad reference ends the text."""
    out, i = bytearray(), 0
    while i < len(data):
        c = data[i]
        i += 1
        if 1 <= c <= 8:
            out += data[i : i + c]
            i += c
        elif c < 0x80:
            out.append(c)
        elif c >= 0xC0:
            out += bytes([32, c ^ 0x80])
        else:
            if i >= len(data):
                break
            pair = c << 8 | data[i]
            i += 1
            back, n = pair >> 3 & 0x7FF, (pair & 7) + 3
            if not 0 < back <= len(out):
                break
            for _ in range(n):
                out.append(out[-back])
    return bytes(out)


def _trailing(data: bytes, flags: int) -> bytes:
    for bit in range(15, 0, -1):
        if flags >> bit & 1 and data:
            n = shift = 0
            for b in reversed(data[-4:]):
                n |= (b & 0x7F) << shift
                shift += 7
                if b & 0x80:
                    break
            data = data[: max(0, len(data) - max(n, 1))]
    if flags & 1 and data:
        data = data[: max(0, len(data) - (data[-1] & 3) - 1)]
    return data


def _image_kind(data: bytes) -> str | None:
    for head, kind in ((b"\x89PNG", "png"), (b"\xff\xd8", "jpg"), (b"GIF8", "gif"), (b"BM", "bmp")):
        if data.startswith(head):
            return kind
    return None


def parse_mobi(data: bytes, path: str):
    if data[60:68] != b"BOOKMOBI" or len(data) < 78:
        raise Rejected("malformed input: not a MOBI file")
    n = struct.unpack(">H", data[76:78])[0]
    starts = [struct.unpack(">I", data[78 + 8 * k : 82 + 8 * k])[0] for k in range(n) if 82 + 8 * k <= len(data)]
    if not starts or any(a > b for a, b in zip(starts, [*starts[1:], len(data)])):
        raise Rejected("malformed input: record offsets")
    records = [data[a:b] for a, b in zip(starts, [*starts[1:], len(data)])]
    head = records[0]
    if len(head) < 16:
        raise Rejected("malformed input: short header")
    u16 = lambda at: struct.unpack(">H", head[at : at + 2])[0] if len(head) >= at + 2 else 0
    u32 = lambda at: struct.unpack(">I", head[at : at + 4])[0] if len(head) >= at + 4 else 0
    if u16(12):
        raise Rejected("DRM-protected content is not supported")
    kind, flags = u16(0), u16(242) if u32(20) >= 228 else 0
    if kind not in (1, 2, 17480):
        raise Rejected("malformed input: compression")
    try:
        unpack = {1: bytes, 2: palmdoc}.get(kind) or _huffman(records, u32(112), u32(116))
        total, parts = 0, []
        for r in records[1 : 1 + u16(8)]:
            parts.append(unpack(_trailing(r, flags)))
            total += len(parts[-1])
            if total > TOTAL or total > RATIO * max(1, len(data)):
                raise Rejected("input rejected: decompression bomb")
        raw = b"".join(parts)[: u32(4) or None]
        version, none = u32(36), (0, 0xFFFFFFFF)
        first = u32(108)
        if version >= 8 and u32(248) not in none and u32(252) not in none:
            out = _kf8(raw, records, u32(248), u32(252))
        else:
            out = _mobi6(raw, u32(28) == 1252)
    except kindle.Damaged as e:
        raise Rejected(f"malformed input: {e}") from e

    def read(b):
        k = first + int(b["asset"]) - 1 if (b["asset"] or "").isdigit() and int(b["asset"]) else -1
        return records[k] if 0 < k < len(records) and _image_kind(records[k]) else None

    assets = _assets(out, read, lambda x: "." + (_image_kind(x) or "bin"))
    name = head[u32(84) : u32(84) + min(u32(88), 1024)].decode("utf-8", "replace").strip() if u32(88) else ""
    title = _exth(head).get(503, "").strip() or name or posixpath.splitext(posixpath.basename(path))[0]
    return {"title": title, "authors": [x for x in [_exth(head).get(100)] if x], "language": _exth(head).get(524), "source_format": "azw3" if u32(36) >= 8 else "mobi"}, out, assets


def _huffman(records: list[bytes], first: int, count: int):
    if not 0 < first < len(records) or not 1 < count <= 4096:
        raise kindle.Damaged("huffman: no table")
    coder = kindle.Huffman(records[first], records[first + 1 : first + count])
    return lambda data: coder.decoded(data, TOTAL)


def _book_blocks(parts: list[tuple[str, str]]) -> list[dict]:
    """The blocks of the parts (name, HTML) of a book, their links led to headings."""
    out, where, top = [], {}, {}
    for name, html in parts:
        heading = None
        html = re.sub(r"<p(?: [^>]*)?>(<img[^>]*/?>)</p>", r"\1", html)
        for b in blocks(html):
            b["file"] = name
            if b["kind"] == "heading":
                heading = b
                top.setdefault(name, b)
            for i in b["ids"]:
                where[name, i] = heading
            out.append(b)
    _fix_links(out, where, top, {})
    return out


def _mobi6(raw: bytes, western: bool) -> list[dict]:
    marks = [int(x) for x in re.findall(rb"filepos=[\"']?0*(\d{1,18})", raw)]
    raw = kindle.marked(raw, marks, "leafmill-fp-")
    text = kindle.cp1252(raw) if western else raw.decode("utf-8", "replace")
    text = re.sub(r"filepos=[\"']?0*(\d+)[\"']?", lambda m: f'href="#leafmill-fp-{int(m[1])}"', text)
    return _book_blocks([("book", re.sub(r"recindex=[\"']?0*(\d+)[\"']?", r'src="\1"', text))])


def _kf8(raw: bytes, records: list[bytes], frag_index: int, skel_index: int) -> list[dict]:
    skels, frags = kindle.skeletons(kindle.read_index(records, skel_index)), kindle.fragments(kindle.read_index(records, frag_index))
    if not skels:
        raise kindle.Damaged("kf8: empty skeleton table")
    parts, where = kindle.assembled(raw, skels, frags)
    marks, targets = {}, {}
    for address in kindle.positions(parts):
        if (place := kindle.resolved_position(address, where)) is not None:
            marks.setdefault(place[0], []).append(place[1])
            targets[address] = f"part{place[0]:04d}.xhtml#leafmill-kp-{place[1]}"
    out = []
    for k, part in enumerate(parts):
        text = kindle.marked(part, marks.get(k, []), "leafmill-kp-").decode("utf-8", "replace")
        text = re.sub(r"kindle:pos:fid:[^\"'<> \t\n]*", lambda m: targets.get(m[0], "#leafmill-unresolved"), text)
        out.append((f"part{k:04d}.xhtml", re.sub(r"src=([\"'])kindle:embed:([0-9A-Va-v]+)[^\"']*\1", lambda m: f'src="{int(m[2], 32)}"', text)))
    return _book_blocks(out)


def _exth(head: bytes) -> dict[int, str]:
    at, out = head.find(b"EXTH"), {}
    if at < 0 or len(head) < at + 12:
        return out
    count, k = struct.unpack(">I", head[at + 8 : at + 12])[0], at + 12
    for _ in range(min(count, 512)):
        if k + 8 > len(head):
            break
        kind, size = struct.unpack(">II", head[k : k + 8])
        if size < 8:
            break
        out.setdefault(kind, head[k + 8 : k + size].decode("utf-8", "replace"))
        k += size
    return out


# ---------------------------------------------------------------- all of them


def detect(data: bytes, path: str) -> str | None:
    hint = path.rpartition(".")[2]
    if data[:4] == b"%PDF":
        return "pdf"
    if len(data) > 68 and data[60:68] == b"BOOKMOBI":
        return "mobi"
    if data[:4] == b"AT&T":
        return "djvu"
    if data[:2] == b"PK":
        try:
            z = zipfile.ZipFile(io.BytesIO(data))
            if "mimetype" in z.namelist() and z.open("mimetype").read(64).strip() == b"application/epub+zip":
                return "epub"
            if any(n.startswith("ppt/") for n in z.namelist()):
                return "pptx"
        except (zipfile.BadZipFile, zlib.error, ValueError, NotImplementedError, RuntimeError):
            pass
    return {"azw3": "mobi", "djv": "djvu"}.get(hint, hint if hint in ("epub", "pptx", "mobi", "pdf", "djvu") else None)


PARSERS = {"epub": parse_epub, "pptx": parse_pptx, "mobi": parse_mobi, "pdf": parse_pdf, "djvu": parse_djvu}


def register_adapter(name: str, parser) -> None:
    """Let ``parser`` (bytes, path) -> (metadata, blocks, assets) read the format ``name``: files that ``detect`` takes for it, or else those with its extension. It travels to the workers
    with every query that is made from then on."""
    PARSERS[name] = parser


def parse(data: bytes | None, path: str, parsers: dict | None = None):
    """(status, error, metadata, blocks, assets) of one file; never raises."""
    parsers = PARSERS if parsers is None else parsers
    try:
        kind, hint = detect(data or b"", path or ""), (path or "").rpartition(".")[2].lower()
        kind = hint if kind is None and hint in parsers else kind
        if kind is None:
            raise Rejected("unsupported or unrecognized format")
        if kind not in parsers:
            raise Rejected("unsupported format")
        meta, out, assets = parsers[kind](data or b"", path or "")
        for k, b in enumerate(out, 1):
            b["ord"] = k
        return "ok", None, meta, out, assets
    except Rejected as e:
        return "failed", str(e), {}, [], []
    except Exception as e:  # noqa: BLE001  one hostile file must not end the batch
        return "failed", f"malformed input: {type(e).__name__}", {}, [], []


_DOC = "doc_id long, path string, status string, error string, title string, authors array<string>, language string, source_format string"


#: Rows of a batch that are held as Python objects, with all that comes of them, before it is sent on.
ROWS = 64


def sliced(batches, rows: int = ROWS):
    """The batches of ``mapInPandas`` in slices, as a batch of Arrow has up to ten thousand rows whatever comes of each."""
    for pdf in batches:
        for k in range(0, len(pdf), rows):
            yield pdf.iloc[k : k + rows]


def documents(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", content_col: str = "content") -> DataFrame:
    """A row for each file: its metadata, ``blocks`` and ``assets``; or, if it couldn't be converted, why not. Null content is an unrecognized format."""
    schema = f"{_DOC}, blocks array<struct<{', '.join(x.replace(' ', ':', 1) for x in BLOCK.split(', '))}>>, assets array<struct<key:string,filename:string,bytes:binary>>"

    parsers = dict(PARSERS)

    def run(batches):
        for pdf in sliced(batches):
            rows = []
            for doc, path, data in zip(pdf["doc_id"], pdf["path"], pdf["content"]):
                status, error, meta, out, assets = parse(data, path or "", parsers)
                rows.append((doc, path, status, error, meta.get("title"), meta.get("authors", []), meta.get("language"), meta.get("source_format"), [{k: b[k] for k in NAMES} for b in out], assets))
            yield pd.DataFrame(rows, columns=["doc_id", "path", "status", "error", "title", "authors", "language", "source_format", "blocks", "assets"])

    return files.select(F.col(id_col).cast("long").alias("doc_id"), F.col(path_col).alias("path"), F.col(content_col).alias("content")).mapInPandas(run, schema)


def block_rows(parsed: DataFrame) -> DataFrame:
    """(doc_id, block columns...) of ``documents``."""
    return parsed.select("doc_id", F.explode("blocks").alias("b")).select("doc_id", "b.*")


def name_filter() -> str:
    """The pattern of the supported files' names, and of those that adapters were registered for, whatever the case of their extensions."""
    names = sorted({"epub", "pptx", "mobi", "azw3", "pdf", "djvu", "djv", *PARSERS})
    return "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in x) for x in names) + "}"


def read_files(spark: SparkSession, *paths: str) -> DataFrame:
    """(doc_id, path, content) of the supported files under ``paths``, folders or files; the names are filtered before a byte is read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name_filter()).load(list(paths))
    return df.select(F.xxhash64("path").alias("doc_id"), "path", "content")
