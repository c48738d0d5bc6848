"""Files in, trees out."""

import os
import re
import urllib.parse

import pytest

from leafmill.operators import library
from leafmill.plans import container_queries as Q
from leafmill.sources import containers as C
from leafmill.sources import markup, pdf
from leafmill.streaming import ingest

TURNS = [("One & two", "First <text> with words " * 80), ("Three", "more"), ("Four", "x * y _ z " * 90)]


@pytest.fixture
def books(tmp_path):
    root = tmp_path / "in"
    for name, make in (("a/one.epub", Q.epub), ("a/two.pptx", Q.pptx), ("b/three.mobi", Q.mobi), ("b/four.pdf", Q.pdf)):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(make("A Title", TURNS))
    (root / "b" / "notes.txt").write_text("no book")
    return root


def test_convert(spark, books, tmp_path):
    out = tmp_path / "out"
    assert library.convert(spark, str(books), str(out)) == 0
    assert (out / "index.md").read_text().count("](") == 4 and "4 of 4 inputs converted" in (out / "index.md").read_text()
    for d in ("a/one", "a/two", "b/three", "b/four"):
        index = (out / d / "index.md").read_text()
        for link in [x.split(")")[0] for x in index.split("](")[1:]]:
            assert (out / d / link).exists()
    text = "".join(p.read_text() for p in (out / "a" / "one").rglob("*.md"))
    assert "First \\<text>" in text and "x \\* y \\_ z" in text and "One & two" in text
    with pytest.raises(FileExistsError):
        library.convert(spark, str(books), str(out))
    (books / "a" / "bad.pdf").write_bytes(b"%PDF-1.4 /Encrypt 1 0 R")
    assert library.convert(spark, str(books), str(out), force=True) == 3
    assert "encrypted content" in (out / "index.md").read_text()
    (books / "a" / "one.pdf").write_bytes(b"%PDF")
    with pytest.raises(ValueError):
        library.convert(spark, str(books), str(out), force=True)


def rich_epub():
    """A book with what links, images and lists can do wrong."""
    one = """<h1 id="a">A] #1 *x* #</h1><p>To <a href="two.xhtml#deep">deep</a>, <a href="two.xhtml">two</a>, <a href="#b">here</a>, <a href="http://x.y/a b">out</a>, <a href="nowhere.xhtml#q">lost</a>.
      A note<a epub:type="noteref" href="#fn">1</a>.</p><aside epub:type="footnote" id="fn"><p>The note.</p></aside>
      <ol><li>first</li><li>second<ul><li>inner</li><li>more</li></ul></li><li>third</li></ol><ul><li>bullet</li></ul>
      <figure><img src="../img/p q(1).png" alt="alt"/><figcaption>A [caption]</figcaption></figure><p><img src="../img/p q(1).png" alt="again"/></p><p><img src="none.png" alt="missing"/></p>
      <table><tr><th>h</th><th>k</th></tr><tr><td colspan="2">a&lt;b</td></tr></table><h2 id="b">Same</h2><p>x</p><h2 id="b2">Same</h2><p><a href="#b2">self</a></p>"""
    two = '<h1 id="two">Second</h1>' + "".join(f"<p>{'long text ' * 60}{k}</p>" for k in range(20)) + f'<h2 id="deep">Deep</h2><p>{"much more text " * 80}<a href="one.xhtml#a">back</a></p>'
    pages = {f"OPS/t/{k}.xhtml": f'<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body>{v}</body></html>' for k, v in (("one", one), ("two", two))}
    opf = '<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>The *Book*</dc:title></metadata><manifest><item id="1" href="t/one.xhtml"/><item id="2" href="t/two.xhtml"/></manifest><spine><itemref idref="1"/><itemref idref="2"/></spine></package>'
    return Q._zip({"mimetype": "application/epub+zip", "META-INF/container.xml": '<container><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>', "OPS/book.opf": opf, "OPS/img/p q(1).png": "\x89PNG data"} | pages)


def anchors_of(text):
    from collections import Counter

    out, seen, fence = set(), Counter(), False
    for line in text.split("\n"):
        fence ^= line.startswith("```")
        m = re.match(r"#{1,6} (.*)", line)
        if m and not fence:
            shown = re.sub(r"\\(.)", r"\1", m[1]).strip()
            base = re.sub(r"[^\w\- ]", "", shown.lower()).replace(" ", "-") or "section"
            out.add(base if not seen[base] else f"{base}-{seen[base]}")
            seen[base] += 1
    return out


def test_every_link_and_image_of_a_rich_book_resolves(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    (root / "BOOK.EPUB").write_bytes(rich_epub())
    out = tmp_path / "out"
    assert library.convert(spark, str(root), str(out)) == 0
    top = out / "BOOK"
    texts = {p.relative_to(top).as_posix(): p.read_text() for p in top.rglob("*.md")}
    links = 0
    for name, text in texts.items():
        for target in re.findall(r"\]\(([^()\s]+)\)", text):
            if target.startswith("http"):
                assert target == "http://x.y/a%20b"
                continue
            path, _, anchor = target.partition("#")
            where = os.path.normpath(os.path.join(os.path.dirname(name), urllib.parse.unquote(path))) if path else name
            assert (top / where).is_file(), (name, target)
            assert not anchor or anchor in anchors_of(texts[where]), (name, target)
            links += bool(anchor)
    assert links == 5
    whole = "\n".join(texts.values())
    assert "The note." in whole and "[^1]: The note." in whole and "note[^1]" in whole and "lost" in whole and "](nowhere" not in whole
    assert "1. first\n2. second\n   - inner\n   - more\n3. third\n\n- bullet" in whole
    assert whole.count("](_assets/000-p_q_1_.png)") == 2 and len(list((top / "_assets").iterdir())) == 1 and "![A \\[caption\\]]" in whole and "missing" in whole
    assert "<th>h</th>" in whole and "<td>a&lt;b</td>" in whole
    index = texts["index.md"]
    assert index.startswith('---\ntitle: "The *Book*"\nbreadcrumb: "The *Book*"\nnext: "01-') and "# The \\*Book\\*" in index and "prev" not in index
    assert "[A\\] #1 \\*x\\* #](" in index
    first = next(p for p in texts if p.startswith("01-"))
    assert 'prev: "' in texts[first] and "## A\\] #1 \\*x\\* \\#\n" in texts[first]
    parts = [p for p in texts if "part-" in p]
    assert len(parts) >= 2 and all(len(texts[p]) < 12_000 for p in parts) and "Part 1" in texts["02-second/index.md"]
    # reading order is one chain through all files
    at, seen = "index.md", []
    while at:
        seen.append(at)
        m = re.search(r'^next: "(.*)"$', texts[at], re.M)
        at = os.path.normpath(os.path.join(os.path.dirname(at), m[1])) if m else None
    assert sorted(seen) == sorted(texts)


def test_pdf_images_and_empty_passwords():
    import hashlib
    import struct
    import zlib

    grey = zlib.compress(bytes(range(6)))
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R /Resources << /XObject << /A 4 0 R /B 5 0 R /C 6 0 R /D 4 0 R >> >> >>",
               b"<< /Subtype /Image /Width 3 /Height 2 /BitsPerComponent 8 /ColorSpace /DeviceGray /Filter /FlateDecode /Length %d >>\nstream\n" % len(grey) + grey + b"\nendstream",
               b"<< /Subtype /Image /Filter /DCTDecode /Length 4 >>\nstream\n\xff\xd8ab\nendstream", b"<< /Subtype /Image /Filter /JPXDecode /Length 1 >>\nstream\nx\nendstream"]
    whole = lambda o, tail=b"": b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n" % k + x + b"\nendobj\n" for k, x in enumerate(o, 1)) + b"trailer << /Root 1 0 R /Info 7 0 R " + tail + b">>"
    status, _, _, out, assets = C.parse(whole(objects), "x.pdf")
    assert status == "ok" and [b["kind"] for b in out] == ["figure", "figure", "figure", "raw", "raw"] and [a["filename"] for a in assets] == ["000-pdf-image-4-0.png", "001-pdf-image-5-0.jpg"]
    assert out[0]["asset"] == out[2]["asset"] == assets[0]["filename"] and assets[0]["bytes"][:4] == b"\x89PNG" and assets[1]["bytes"] == b"\xff\xd8ab" and "JPXDecode" in out[4]["text"]
    # the same kind of file encrypted with an empty password, by the standard's own steps
    owner, first, rights = bytes(range(32)), b"0123456789abcdef", -4
    for revision, size in ((2, 5), (3, 16)):
        key = hashlib.md5(pdf._PAD + owner + struct.pack("<i", rights) + first).digest()
        for _ in range(50 if revision == 3 else 0):
            key = hashlib.md5(key[:size]).digest()
        key = key[:size]
        user = pdf.rc4(key, pdf._PAD) if revision == 2 else hashlib.md5(pdf._PAD + first).digest()
        for k in range(20 if revision == 3 else 0):
            user = pdf.rc4(bytes(c ^ k for c in key), user)
        own = lambda n, x: pdf.rc4(hashlib.md5(key + n.to_bytes(3, "little") + b"\0\0").digest()[: min(16, size + 5)], x)  # noqa: B023, E731
        text = own(4, b"BT /F 12 Tf 10 700 Td (secret words) Tj ET")
        made = [*objects[:2], b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>", b"<< /Length %d >>\nstream\n" % len(text) + text + b"\nendstream", b"<< /Filter /Standard /V %d /R %d /Length %d /P %d /O <%s> /U <%s> >>" % (revision - 1, revision, 8 * size, rights, owner.hex().encode(), user.hex().encode()), b"<<>>", b"<< /Title <%s> >>" % own(7, b"Told").hex().encode()]
        status, error, meta, out, _ = C.parse(whole(made, b"/Encrypt 5 0 R /ID [<%s> <00>]" % first.hex().encode()), "x.pdf")
        assert (status, error, meta["title"]) == ("ok", None, "Told") and [b["text"] for b in out] == ["secret words"]
        assert C.parse(whole([*made[:4], made[4].replace(user.hex().encode(), b"00" * 32), *made[5:]], b"/Encrypt 5 0 R /ID [<%s> <00>]" % first.hex().encode()), "x.pdf")[1] == "encrypted content"


def test_djvu():
    from leafmill.sources import djvu

    made = Q.djvu("T", [("One", "some words of text " * 9), ("Two", "")])
    status, _, meta, out, _ = C.parse(made, "a/Book.djvu")
    assert status == "ok" and meta["title"] == "Book" and [(b["kind"], b["level"], b["page"]) for b in out] == [("heading", 1, 1), ("para", None, 1), ("heading", 1, 2)] and out[1]["text"] == ("some words of text " * 9).strip()
    assert "indirect" in C.parse(made.replace(b"\x81", b"\x01", 1), "x.djvu")[1]
    for k in range(0, len(made), 3):
        assert C.parse(made[:k] + b"\xff" + made[k + 1 :], "x.djvu")[0] in ("ok", "failed")
    empty = b"AT&TFORM" + (12).to_bytes(4, "big") + b"DJVU" + b"Sjbz" + bytes(4)
    assert [b["text"] for b in C.parse(empty, "x.djvu")[3]] == ["scanned page: no text layer; OCR not enabled"]
    assert djvu.lines(djvu.Zone("page", (0, 0, 9, 9), "", [djvu.Zone("word", (0, 0, 9, 5), "alone", [])])) == [("alone", 5, False)]


def test_skeletons_and_fragments():
    from leafmill.sources import kindle as K

    raw = b"<b></b>" + b"one" + b"two" + b"<c></c>" + b"three"
    parts, where = K.assembled(raw, [K.Skeleton(2, 0, 7), K.Skeleton(1, 13, 7)], [K.Fragment(3, 3), K.Fragment(3, 3), K.Fragment(16, 5)])
    assert parts == [b"<b>onetwo</b>", b"<c>three</c>"] and where == [(0, 3), (0, 6), (1, 3)]
    for skels, frags in (([(9, 0, 7), (1, 13, 7)], [(3, 3)]), ([(1, 0, 7), (1, 13, 7)], [(99, 3), (16, 5)]), ([(1, 0, 9999), (1, 13, 7)], [(3, 3), (16, 5)])):
        parts, where = K.assembled(raw, [K.Skeleton(*x) for x in skels], [K.Fragment(*x) for x in frags])
        assert parts[0] == K.DAMAGED and where[0] is None and (len(frags) < 2 or parts[1] == b"<c>three</c>" and where[1] == (1, 3))
    assert K.resolved_position("kindle:pos:fid:0001:off:000A", [None, (2, 5)]) == (2, 15) and K.resolved_position("kindle:pos:fid:0000:off:0", [None]) is None and K.resolved_position("x", []) is None
    html = b"<p>a</p><h2>b</h2><p>c</p>"
    assert K.marked(html, [8, 8, 2, 999], "m") == b'<p>a<a id="m2"></a></p><h2>b</h2><a id="m8"></a><p>c</p><a id="m999"></a>'
    big = b"<p>x</p>" * 20_000
    assert K.marked(big, list(range(0, len(big), 8)), "m").count(b"<a id") == 20_000
    assert K.cp1252(b"\x80\x81\xe9") == "\u20ac\x81\xe9"


def test_damaged_kindle_tables():
    book = Q.azw3("T", TURNS)
    status, _, meta, out, _ = C.parse(book, "x.azw3")
    assert status == "ok" and meta["source_format"] == "azw3" and [b["text"] for b in out if b["kind"] == "heading"] == ["One & two", "Three", "Four"]
    for k in range(0, len(book), 37):  # no byte may break more than its own file
        assert C.parse(book[:k] + b"\xff" + book[k + 1 :], "x.azw3")[0] in ("ok", "failed")
    assert "INDX" in C.parse(book.replace(b"INDX", b"XXXX"), "x.azw3")[1]


def test_huffman_records():
    from leafmill.sources import kindle as K

    table = b"HUFF" + bytes(4) + (24).to_bytes(4, "big") + (24 + 1024).to_bytes(4, "big") + bytes(8) + b"".join((255 << 8 | 0x80 | 8).to_bytes(4, "big") for _ in range(256)) + bytes(256)
    phrases = [(b"abc", True), (b"\xff\xff", False), (b"z", True)]  # the second is coded: twice the first
    body, places = b"", []
    for data, plain in phrases:
        places.append(2 * len(phrases) + len(body))
        body += (len(data) | (0x8000 if plain else 0)).to_bytes(2, "big") + data
    book = b"CDIC" + bytes(4) + len(phrases).to_bytes(4, "big") + (8).to_bytes(4, "big") + b"".join(x.to_bytes(2, "big") for x in places) + body
    coder = K.Huffman(table, [book])
    assert coder.decoded(bytes([255, 254, 253]), 1000) == b"abcabcabcz"
    with pytest.raises(K.Damaged):
        coder.decoded(bytes([3]), 1000)
    loop = K.Huffman(table, [b"CDIC" + bytes(4) + (1).to_bytes(4, "big") + (8).to_bytes(4, "big") + (2).to_bytes(2, "big") + (1).to_bytes(2, "big") + b"\xff"])
    with pytest.raises(K.Damaged):
        loop.decoded(b"\xff", 1000)


def test_lists():
    items = [(0, True, "a"), (1, False, "b\nc"), (2, True, "d"), (1, False, "e"), (0, True, "f"), (0, False, "g"), (5, False, "h")]
    assert library.list_markdown(items) == "1. a\n   - b\n     c\n     1. d\n   - e\n2. f\n- g\n  - h"
    assert library.list_markdown([(0, True, str(k)) for k in range(11)]).endswith("\n11. 10")


def test_registered_adapters_travel(spark, tmp_path):
    (tmp_path / "a.TXT").write_text("hello")
    C.register_adapter("txt", lambda data, path: ({"title": "T", "authors": [], "language": None, "source_format": "txt"}, [markup.block("para", text=data.decode())], []))
    try:
        rows = C.documents(C.read_files(spark, str(tmp_path))).collect()
        assert [(r.status, r.title, r.blocks[0].text) for r in rows] == [("ok", "T", "hello")]
    finally:
        del C.PARSERS["txt"]


def test_titles_that_pages_print(spark):
    from leafmill.functions.text import title_mask

    assert title_mask(["***", "The End", "the", "-", "end", "THE", "END!"], ["The end", "the END", "***"]) == [False, True, False, False, False, True, True]
    from leafmill.sources.pdf import _lines

    assert [x["text"] for x in _lines([(10, 100, 10, "a"), (5, 99, 10, " b"), (1, 50, 10, "  "), (30, 100, 10, "c ")])] == ["a cb"]


def test_hostile_files():
    book = Q.mobi("T", TURNS)
    assert C.parse(b"%PDF-", "x.pdf")[0] == "ok"  # a file without pages has no blocks
    for data in (None, b"", b"PK\x03\x04junk", book[:100], book[:78], Q.epub("T", TURNS)[:300], b"AT&TFORM", os.urandom(500)):
        status, error, *_ = C.parse(data, "x.epub")
        assert status == "failed" and error
    drm = bytearray(book)
    at = int.from_bytes(book[78:82], "big")
    drm[at + 12 : at + 14] = b"\0\2"
    assert C.parse(bytes(drm), "x.mobi")[1] == "DRM-protected content is not supported"
    assert C.parse(b"text", "x.txt")[1] == "unsupported or unrecognized format" and "DjVu" in C.parse(b"AT&TFORM", "x")[1]


def test_palmdoc():
    assert C.palmdoc(b"abc\x80\x1b") == b"abcabcabc"[: 3 + 6] and C.palmdoc(b"\x02\xff\xfea\xc1") == b"\xff\xfea A" and C.palmdoc(b"a\x80") == b"a" and C.palmdoc(b"\x9f\xff") == b""


def test_markup():
    deep = markup.blocks("<p>" + "<em>" * 5000 + "x" + "</em>" * 5000 + "</p>")
    assert deep[0]["text"] == "x" and markup.blocks("") == [] and [b["kind"] for b in markup.blocks("<h1>a<p>b<li>c")] == ["heading", "para", "item"]
    t = markup.blocks("<table><tr><td>a<td colspan=2>b<tr><td>c</table>")[0]
    assert t["rows"] == [["a", "b"], ["c", ""]] and t["has_merged"]
    assert [b["text"] for b in markup.blocks("<script>var t='</p>';</script><p>x &copy; y")] == ["x © y"]


def test_pdf_operators():
    runs = pdf.page_runs(b"q 2 0 0 2 0 0 cm BT /F 10 Tf 5 5 Td [(a) -200 (b\\051)] TJ 12 TL T* <4142> Tj ET Q BT /F 9 Tf 1 0 0 1 3 4 Tm (z) Tj ( ) Tj ET")
    assert [(x, y, s, t) for x, y, s, t in runs] == [(10, 10, 20, "a b)"), (10, -14, 20, "AB"), (3, 4, 9, "z")]


def test_stream(spark, books, tmp_path):
    query = ingest.parse_into(ingest.incoming(spark, str(books)), str(tmp_path / "t"), str(tmp_path / "c"))
    assert query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "t")).where("status = 'ok'").count() == 4
