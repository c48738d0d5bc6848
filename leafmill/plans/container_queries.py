"""Queries of the container parsers: conversations written as EPUB, PPTX, MOBI and PDF files and read back, pages as HTML."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from html import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import register, table
from ..functions import containers as R
from ..functions.inline import inline_markdown, inline_text
from ..operators import library
from ..sources import containers as C
from ..sources import markup, math
from . import atlas


def _zip(entries: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in entries.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text)
    return out.getvalue()


def epub(title: str, turns: list[tuple[str, str]]) -> bytes:
    """A book of a chapter for each turn."""
    pages = {f"OPS/c{k}.xhtml": f'<html xmlns="http://www.w3.org/1999/xhtml"><body><h2 id="t{k}">{escape(a)}</h2><p>{escape(b)}</p></body></html>' for k, (a, b) in enumerate(turns)}
    manifest = "".join(f'<item id="c{k}" href="c{k}.xhtml" media-type="application/xhtml+xml"/>' for k in range(len(turns)))
    spine = "".join(f'<itemref idref="c{k}"/>' for k in range(len(turns)))
    opf = f'<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{escape(title)}</dc:title></metadata><manifest>{manifest}</manifest><spine>{spine}</spine></package>'
    return _zip({"mimetype": "application/epub+zip", "META-INF/container.xml": '<container><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>', "OPS/book.opf": opf} | pages)


def pptx(title: str, turns: list[tuple[str, str]]) -> bytes:
    """A deck of a slide for each turn."""
    ns = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    base = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    text = lambda t: f"<p:txBody><a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p></p:txBody>"
    slides = {f"ppt/slides/slide{k}.xml": f'<p:sld {ns}><p:cSld><p:spTree><p:sp><p:nvSpPr><p:nvPr><p:ph type="title"/></p:nvPr></p:nvSpPr>{text(a)}</p:sp><p:sp>{text(b)}</p:sp></p:spTree></p:cSld></p:sld>' for k, (a, b) in enumerate(turns)}
    order = "".join(f'<p:sldId id="{256 + k}" r:id="rId{k}"/>' for k in range(len(turns)))
    rels = "".join(f'<Relationship Id="rId{k}" Type="{base}/slide" Target="slides/slide{k}.xml"/>' for k in range(len(turns)))
    return _zip({"ppt/presentation.xml": f"<p:presentation {ns}><p:sldIdLst>{order}</p:sldIdLst></p:presentation>", "ppt/_rels/presentation.xml.rels": f"<Relationships>{rels}</Relationships>"} | slides)


def mobi(title: str, turns: list[tuple[str, str]]) -> bytes:
    """A book of plain records."""
    body = ("<html><body>" + "".join(f"<h2>{escape(a)}</h2><p>{escape(b)}</p>" for a, b in turns) + "</body></html>").encode()
    texts = [body[k : k + 4096] for k in range(0, len(body), 4096)]
    name = title.encode()
    head = struct.pack(">HHIHHHH", 1, 0, len(body), len(texts), 4096, 0, 0) + b"MOBI" + struct.pack(">IIIII", 232, 2, 65001, 1, 6)
    head = head.ljust(84, b"\0") + struct.pack(">II", 256, len(name)) + b"\0" * 16 + struct.pack(">I", 0)
    head = head.ljust(256, b"\0") + name
    return _palm(title, [head, *texts])


def _palm(title: str, records: list[bytes]) -> bytes:
    at, table_ = 78 + 8 * len(records) + 2, b""
    for k, r in enumerate(records):
        table_ += struct.pack(">II", at, k)
        at += len(r)
    return title.encode()[:31].ljust(32, b"\0") + b"\0" * 28 + b"BOOKMOBI" + b"\0" * 8 + struct.pack(">H", len(records)) + table_ + b"\0\0" + b"".join(records)


def _number(x: int) -> bytes:
    out = [x & 0x7F | 0x80]
    while x := x >> 7:
        out.insert(0, x & 0x7F)
    return bytes(out)


def _index(entries: list[tuple[bytes, bytes, list[int]]], tags: bytes) -> list[bytes]:
    """The records of an index of (name, control byte, numbers)."""
    chunks = [entries[k : k + 500] for k in range(0, len(entries), 500)] or [[]]
    out = [b"INDX" + struct.pack(">I", 192) + bytes(16) + struct.pack(">I", len(chunks)) + bytes(192 - 28) + b"TAGX" + struct.pack(">II", 12 + len(tags), 1) + tags]
    for chunk in chunks:
        body, places = b"", []
        for name, control, numbers in chunk:
            places.append(192 + len(body))
            body += bytes([len(name)]) + name + control + b"".join(map(_number, numbers))
        out.append(b"INDX" + struct.pack(">I", 192) + bytes(12) + struct.pack(">II", 192 + len(body), len(chunk)) + bytes(192 - 28) + body + b"IDXT" + b"".join(struct.pack(">H", p) for p in places))
    return out


def azw3(title: str, turns: list[tuple[str, str]]) -> bytes:
    """A book of skeletons and fragments: a part for each turn, its heading and its text in fragments of their own, and a link to the next part's heading by position."""
    raw, skel, frag = b"", [], []
    for k, (a, b) in enumerate(turns):
        after = f"kindle:pos:fid:{_base32(2 * ((k + 1) % len(turns)), 4)}:off:{_base32(0, 10)}"
        frame, pieces = b"<html><body></body></html>", [f"<h2>{escape(a)}</h2>".encode(), f'<p>{escape(b)} <a href="{after}">next</a></p>'.encode()]
        start = len(raw)
        skel.append((b"SKEL%010d" % k, b"\x05", [2, start, len(frame)]))
        frag += [(b"%010d" % (start + 12), b"\x08", [0, len(x)]) for x in pieces]
        raw += frame + b"".join(pieces)
    texts, name = [raw[k : k + 4096] for k in range(0, len(raw), 4096)], title.encode()
    frags = _index(frag, bytes([2, 1, 1, 0, 3, 1, 2, 0, 4, 1, 4, 0, 6, 2, 8, 0, 0, 0, 0, 1]))
    skels = _index(skel, bytes([1, 1, 3, 0, 6, 2, 12, 0, 0, 0, 0, 1]))
    head = struct.pack(">HHIHHHH", 1, 0, len(raw), len(texts), 4096, 0, 0) + b"MOBI" + struct.pack(">IIIII", 264, 2, 65001, 1, 8)
    head = head.ljust(84, b"\0") + struct.pack(">II", 280, len(name)) + b"\0" * 16 + struct.pack(">I", 0)
    head = head.ljust(248, b"\0") + struct.pack(">II", 1 + len(texts), 1 + len(texts) + len(frags))
    return _palm(title, [head.ljust(280, b"\0") + name, *texts, *frags, *skels])


def _base32(x: int, width: int) -> str:
    out = ""
    while x:
        out, x = "0123456789ABCDEFGHIJKLMNOPQRSTUV"[x % 32] + out, x // 32
    return out.rjust(width, "0")


def pdf(title: str, turns: list[tuple[str, str]]) -> bytes:
    """A page for each turn: a large line and small ones."""
    out, objects = io.BytesIO(b"%PDF-1.4\n"), []
    quoted = lambda t: t.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
    kids = " ".join(f"{4 + 2 * k} 0 R" for k in range(len(turns))).encode()
    objects += [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [" + kids + b"] /Count %d >>" % len(turns), b"<< /Title (" + quoted(title) + b") >>"]
    for k, (a, b) in enumerate(turns):
        text = b"BT /F1 24 Tf 72 720 Td (" + quoted(a) + b") Tj /F1 12 Tf 0 -60 Td (" + quoted(" ".join(b.split())) + b") Tj 0 -40 Td (end of page) Tj 0 -14 Td (end of turn) Tj ET"
        packed = zlib.compress(text)
        objects += [b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (5 + 2 * k), b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(packed) + packed + b"\nendstream"]
    out.seek(0, 2)
    for k, o in enumerate(objects, 1):
        out.write(b"%d 0 obj\n" % k + o + b"\nendobj\n")
    out.write(b"trailer << /Root 1 0 R /Info 3 0 R >>\n%%EOF")
    return out.getvalue()


def djvu(title: str, turns: list[tuple[str, str]]) -> bytes:
    """A page for each turn, with its text as zones: a tall line, and the text's lines in a paragraph."""

    def chunk(name: bytes, data: bytes) -> bytes:
        return name + struct.pack(">I", len(data)) + data + b"\0" * (len(data) & 1)

    def zone(kind: int, h: int, start: int, length: int, children: list[bytes], y: int = 0) -> bytes:
        return bytes([kind]) + struct.pack(">5H", *(v + 0x8000 for v in (0, y, 600, h, start))) + length.to_bytes(3, "big") + len(children).to_bytes(3, "big") + b"".join(children)

    made = b""
    for a, b in turns:
        texts = [a, *(" ".join(b.split()[k : k + 12]) for k in range(0, len(b.split()), 12))]
        data, paras = b"", []
        raw = [t.encode() for t in texts]
        heads = zone(4, 40, 0, len(raw[0]), [zone(5, 40, 0, len(raw[0]), [])])
        rest = [zone(5, 20, 0, len(r), []) for r in raw[1:]]
        paras = [heads] + ([zone(4, 20 * len(rest), 0, sum(map(len, raw[1:])), rest)] if rest else [])
        data = b"".join(raw)
        layer = len(data).to_bytes(3, "big") + data + b"\1" + zone(1, 800, 0, len(data), paras)
        made += chunk(b"FORM", b"DJVU" + chunk(b"INFO", bytes(10)) + chunk(b"TXTa", layer))
    body = b"DJVM" + chunk(b"DIRM", b"\x81" + struct.pack(">H", len(turns))) + made
    return b"AT&TFORM" + struct.pack(">I", len(body)) + body


def files(conversations: DataFrame, make, extension: str) -> DataFrame:
    """(doc_id, path, content): a file for each conversation."""
    books = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def run(batches):
        for pdf_ in C.sliced(batches):
            made = [make(f"Conversation {c}", [(f"Turn {t['turn']} by {t['role']}", t["text"]) for t in turns]) for c, turns in zip(pdf_["conv_id"], pdf_["turns"])]
            yield pd.DataFrame({"doc_id": pdf_["conv_id"], "path": [f"in/{c}.{extension}" for c in pdf_["conv_id"]], "content": made})

    return books.mapInPandas(run, "doc_id long, path string, content binary")


def _converted(make, extension):
    return lambda s, d: C.block_rows(C.documents(files(table(s, d, "conversations"), make, extension))).select("doc_id", "ord", "kind", "text")


def atlas_epub(title: str, nations: list[tuple[str, list[tuple[int, str]]]]) -> bytes:
    """A book of a file for each nation, whose headings link to each other."""
    pages = {}
    for k, (nation, customers) in enumerate(nations):
        after = (k + 1) % len(nations)
        body = f'<h1 id="n">{escape(nation)}</h1><p>Next is <a href="n{after}.xhtml#n">{escape(nations[after][0])}</a>, not <a href="gone.xhtml#n">a lost one</a>.</p>'
        for i, (key, name) in enumerate(customers):
            back = f' and <a href="#c{customers[i - 1][0]}">the one before</a>' if i else ""
            body += f'<h2 id="c{key}">{escape(name)}</h2><p>Of <a href="#n">this nation</a>{back}.</p>'
        pages[f"OPS/n{k}.xhtml"] = f'<html xmlns="http://www.w3.org/1999/xhtml"><body>{body}</body></html>'
    manifest = "".join(f'<item id="n{k}" href="n{k}.xhtml" media-type="application/xhtml+xml"/>' for k in range(len(nations)))
    spine = "".join(f'<itemref idref="n{k}"/>' for k in range(len(nations)))
    opf = f'<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{escape(title)}</dc:title></metadata><manifest>{manifest}</manifest><spine>{spine}</spine></package>'
    return _zip({"mimetype": "application/epub+zip", "META-INF/container.xml": '<container><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>', "OPS/book.opf": opf} | pages)


def site_links(s, d):
    """Regions written as books, read back, structured and rendered: the links between headings that stand in the Markdown."""
    c, n = table(s, d, "customer"), table(s, d, "nation")
    own = c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.sort_array(F.collect_list(F.struct("c_custkey", "c_name"))).alias("customers"))
    books = n.join(own, "n_nationkey", "left").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name", "customers"))).alias("nations"))

    def run(batches):
        for pdf_ in C.sliced(batches):
            made = [atlas_epub(f"Book {r}", [(x["n_name"], [(y["c_custkey"], y["c_name"]) for y in (x["customers"] if x["customers"] is not None else [])]) for x in nations]) for r, nations in zip(pdf_["n_regionkey"], pdf_["nations"])]
            yield pd.DataFrame({"doc_id": pdf_["n_regionkey"], "path": [f"in/{r}.epub" for r in pdf_["n_regionkey"]], "content": made})

    parsed = C.documents(books.mapInPandas(run, "doc_id long, path string, content binary"))
    files = library.site(parsed, 0, 1 << 40)
    links = files.select("doc_id", F.col("path").alias("source"), F.explode(F.regexp_extract_all("markdown", F.lit(r"\]\(([^()\s]*#[^()\s]*)\)"), F.lit(1))).alias("link"))
    return links.groupBy("doc_id", "source", "link").agg(F.count("*").alias("n"))


register(
    "site_links",
    site_links,
    f"""WITH o AS (SELECT n_regionkey::BIGINT AS doc_id, n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k, count(*) OVER (PARTITION BY n_regionkey) AS total, EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey) AS has FROM nation),
a AS (SELECT *, printf('%02d', k) || '-' || lower(n_name) AS dir, printf('%02d', k) || '-' || lower(n_name) || CASE WHEN has THEN '/index.md' ELSE '.md' END AS path FROM o),
c AS (SELECT a.doc_id, a.path AS up, lower(a.n_name) AS up_anchor, a.dir || '/' || printf('%02d', i) || '-' || replace(lower(c_name), '#', '-') || '.md' AS path, replace(lower(c_name), '#', '') AS anchor, i, n_nationkey FROM a JOIN (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i FROM customer) ON c_nationkey = n_nationkey),
l AS (SELECT x.doc_id, x.path AS source, y.path AS target, lower(y.n_name) AS anchor FROM a x JOIN a y ON x.doc_id = y.doc_id AND y.k = x.k % x.total + 1
  UNION ALL SELECT doc_id, path, up, up_anchor FROM c
  UNION ALL SELECT x.doc_id, x.path, y.path, y.anchor FROM c x JOIN c y ON x.n_nationkey = y.n_nationkey AND y.i = x.i - 1)
SELECT doc_id, source, {atlas.relative_sql('source', 'target')} || '#' || anchor AS link, count(*) AS n FROM l GROUP BY ALL""",
)

_TWO = r"""SELECT conv_id AS doc_id, (2 * n - 1 + k)::INTEGER AS ord, ['heading', 'para'][k + 1] AS kind, CASE k WHEN 0 THEN 'Turn ' || turn || ' by ' || role ELSE {} END AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) CROSS JOIN range(0, 2) r(k)"""
register("epb_convert", _converted(epub, "epub"), _TWO.format(r"trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g'))"))
register("ppt_convert", _converted(pptx, "pptx"), _TWO.format("text"))
register("mob_convert", _converted(mobi, "mobi"), _TWO.format(r"trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g'))"))
register("djv_convert", _converted(djvu, "djvu"), r"""SELECT conv_id AS doc_id, (2 * n - 1 + k)::INTEGER AS ord, ['heading', 'para'][k + 1] AS kind, CASE k WHEN 0 THEN 'Turn ' || turn || ' by ' || role ELSE trim(regexp_replace(text, '\s+', ' ', 'g')) END AS text
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) CROSS JOIN range(0, 2) r(k)""")
_CLEAN = r"trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g'))"
register("mob_azw3_convert", _converted(azw3, "azw3"), _TWO.format(f"trim({_CLEAN} || ' next')"))


def azw3_links(s, d):
    """The number of the heading that each part's link leads to."""
    b = C.block_rows(C.documents(files(table(s, d, "conversations"), azw3, "azw3"))).where("kind = 'para'")
    return b.select("doc_id", "ord", F.explode("spans").alias("s")).where("s.kind = 'link'").select("doc_id", "ord", F.col("s.target").alias("target"))


register("mob_azw3_links", azw3_links, "SELECT conv_id AS doc_id, (2 * n)::INTEGER AS ord, '#' || (n % total) AS target FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations)")
register(
    "pdf_convert",
    _converted(pdf, "pdf"),
    r"""SELECT conv_id AS doc_id, (3 * n - 2 + k)::INTEGER AS ord, ['heading', 'para', 'para'][k + 1] AS kind, CASE k WHEN 0 THEN 'Turn ' || turn || ' by ' || role WHEN 1 THEN trim(regexp_replace(text, '\s+', ' ', 'g')) ELSE 'end of page end of turn' END AS text
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) CROSS JOIN range(0, 3) r(k)""",
)


def outcomes(s, d):
    """Good files, protected ones, broken ones and none at all, in one batch."""
    x = files(table(s, d, "conversations"), mobi, "mobi")
    bad = F.when(F.col("doc_id") % 4 == 1, F.concat(F.substring("content", 1, 200), F.lit(b"x"))).when(F.col("doc_id") % 4 == 2, F.lit(b"plain text")).when(F.col("doc_id") % 4 == 3, F.lit(None)).otherwise(F.col("content"))
    return C.documents(x.withColumn("content", bad).withColumn("path", F.when(F.col("doc_id") % 4 == 2, "a.txt").otherwise(F.col("path")))).select("doc_id", "status", "error", "title")


register("bat_outcomes", outcomes, "SELECT DISTINCT conv_id AS doc_id, CASE WHEN conv_id % 4 = 0 THEN 'ok' ELSE 'failed' END AS status, [NULL, 'malformed input: record offsets', 'unsupported or unrecognized format', 'malformed input: not a MOBI file'][conv_id % 4 + 1] AS error, CASE WHEN conv_id % 4 = 0 THEN 'Conversation ' || conv_id END AS title FROM conversations")


def html_blocks(s, d):
    schema = f"page_id long, {markup.BLOCK}"

    def run(batches):
        for pdf_ in C.sliced(batches):
            rows = [(p, *(b[k] for k in markup.NAMES)) for p, html in zip(pdf_["page_id"], pdf_["html"]) for b in markup.blocks(html or "")]
            yield pd.DataFrame(rows, columns=["page_id", *markup.NAMES])

    x = table(s, d, "pages").select("page_id", "html").mapInPandas(run, schema)
    return x.select("page_id", "ord", "kind", "level", "text", inline_markdown("spans").alias("markdown"), inline_text("spans").alias("plain"))


register("epb_html_blocks", html_blocks)


def inline(s, d):
    """The words of a line as spans of every kind, by their place."""
    w = table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "t")).where("t <> ''").withColumn("w", F.split("t", " "))
    kind = lambda i: F.when(i % 2 == 0, "text").when(i % 8 == 1, "emph").when(i % 8 == 3, "strong").when(i % 8 == 5, "code").otherwise("link")
    text, link = lambda i: i % 2 == 0, lambda i: i % 8 == 7
    piece = lambda x, i: F.array(F.struct(F.lit(0).alias("depth"), kind(i).alias("kind"), F.when(text(i), F.concat(F.lit(" "), x, F.lit(" "))).otherwise("").alias("text"), F.when(link(i), "http://x.y").alias("target")), F.struct(F.lit(1).alias("depth"), F.lit("text").alias("kind"), F.when(text(i), "").otherwise(x).alias("text"), F.lit(None).cast("string").alias("target")))
    return w.select("doc_id", "k", inline_markdown(F.flatten(F.transform("w", piece))).alias("markdown"))


register("wrt_inline_markdown", inline)


def formulas(s, d):
    p = table(s, d, "part").select("p_partkey", F.format_string("<math><mfrac><mi>%s</mi><msqrt><mn>%d</mn></msqrt></mfrac></math>", F.col("p_name"), "p_size").alias("xml"))

    def latex(batch: pd.Series) -> pd.Series:
        return batch.map(lambda x: math.mathml_latex(x)[0])

    return p.select("p_partkey", F.pandas_udf(latex, "string")("xml").alias("latex"))


register("mth_mathml_latex", formulas, "SELECT p_partkey, '\\frac{' || p_name || '}{\\sqrt{' || p_size || '}}' AS latex FROM part".replace("\\\\", "\\"))


def omml(s, d):
    p = table(s, d, "part").select("p_partkey", F.format_string("<oMath><sSup><e><r><t>%s</t></r></e><sup><r><t>%d</t></r></sup></sSup></oMath>", F.col("p_name"), "p_size").alias("xml"))

    def latex(batch: pd.Series) -> pd.Series:
        return batch.map(lambda x: math.omml_latex(x)[0])

    return p.select("p_partkey", F.pandas_udf(latex, "string")("xml").alias("latex"))


register("mth_omml_latex", omml, "SELECT p_partkey, '{' || p_name || '}^{' || p_size || '}' AS latex FROM part")


# ---------------------------------------------------------------- small rules


_P = "SELECT p_partkey, {} AS out FROM part"


def _parts(expression):
    return lambda s, d: table(s, d, "part").select("p_partkey", expression().alias("out"))


_S = lambda c: F.col(c).cast("string")
_padded = lambda x, n: F.lpad(x, F.greatest(F.lit(n), F.length(x)), "0")  # noqa: E731  lpad alone cuts what is longer
register("epb_package_path", _parts(lambda: R.package_path(F.concat(F.lit("<rootfile full-path='OPS/"), "p_brand", F.lit(".opf' x='y'>")))), _P.format("'OPS/' || p_brand || '.opf'"))
register("epb_has_type", _parts(lambda: R.has_type(F.when(F.col("p_size") % 2 == 0, " a  footnote ").otherwise("footnotes"), "footnote")), _P.format("p_size % 2 = 0"))
register("epb_is_inline", _parts(lambda: R.is_inline(F.element_at(F.array(*map(F.lit, ("EM", "div", "math", "section", "math"))), (F.col("p_partkey") % 5 + 1).cast("int")), F.when(F.col("p_partkey") % 5 == 4, "block"))), _P.format("p_partkey % 5 IN (0, 2)"))
register("ppt_rels_path", _parts(lambda: R.rels_path(F.concat(F.lit("ppt/slides/"), "p_brand", F.lit(".xml")))), _P.format("'ppt/slides/_rels/' || p_brand || '.xml.rels'"))
register("mob_base32", _parts(lambda: R.base32(F.conv(_S("p_partkey"), 10, 32))), _P.format("p_partkey"))
register("mob_positions", _parts(lambda: F.concat_ws(":", R.position_of(F.concat(F.lit("kindle:pos:fid:"), _padded(F.conv(_S("p_partkey"), 10, 32), 4), F.lit(":off:"), _padded(F.conv(_S("p_size"), 10, 32), 10))).getField("fragment").cast("string"), R.position_of(F.concat(F.lit("kindle:pos:fid:1:off:"), F.conv(_S("p_size"), 10, 32))).getField("offset").cast("string"))), _P.format("p_partkey || ':' || p_size"))
register("mob_position_links", _parts(lambda: F.array_join(R.position_links(F.concat(F.lit("<a href='kindle:pos:fid:0001:off:"), _S("p_size"), F.lit("'>x</a><a href=\"kindle:pos:fid:0002:off:0\">y</a><a href='kindle:pos:fid:0001:off:"), _S("p_size"), F.lit("'>"))), " ")), _P.format("'kindle:pos:fid:0001:off:' || p_size || ' kindle:pos:fid:0002:off:0'"))
register("mob_byte_positions", _parts(lambda: F.array_join(R.byte_positions(F.concat(F.lit("<a filepos="), _S("p_partkey"), F.lit("><a filepos='0000000001'><a filepos=\"1\">"))).cast("array<string>"), " ")), _P.format("CASE WHEN p_partkey = 1 THEN '1' ELSE least(p_partkey, 1) || ' ' || greatest(p_partkey, 1) END"))
register("mob_resource_number", _parts(lambda: R.resource_number(F.concat(F.when(F.col("p_size") % 2 == 0, "kindle:embed:").otherwise("x:"), F.conv(_S("p_partkey"), 10, 32), F.lit("?mime=image/jpg")))), _P.format("CASE WHEN p_size % 2 = 0 AND p_partkey > 0 THEN p_partkey END"))
register("mob_unwrap_images", _parts(lambda: R.unwrap_images(F.concat(F.lit("<p class='a'><img src='"), "p_brand", F.lit("'/></p><p>x<img/></p>")))), _P.format("'<img src=''' || p_brand || '''/><p>x<img/></p>'"))
register("mob_document_title", _parts(lambda: R.document_title(F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise(" "), F.when(F.col("p_size") % 3 == 1, F.col("p_type")), F.concat(F.lit("in/"), "p_brand", F.lit(".mobi")))), _P.format("CASE p_size % 3 WHEN 0 THEN trim(p_name) WHEN 1 THEN trim(p_type) ELSE p_brand END"))
register("djv_page_of", _parts(lambda: R.page_of(F.concat(F.when(F.col("p_size") % 2 == 0, " #").otherwise("page"), _S("p_partkey")))), _P.format("CASE WHEN p_size % 2 = 0 THEN p_partkey ELSE 0 END::INTEGER"))
