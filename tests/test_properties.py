"""What must hold whatever comes in: slugs, anchors, escapes, guards and parsers over generated input."""

import io
import re
import zipfile

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from leafmill.functions import inline, text
from leafmill.operators import recognition
from leafmill.plans import container_queries as Q
from leafmill.sources import containers as C
from leafmill.sources import kindle, markup, math, pdf

FAST = settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))


@FAST
@given(st.text(max_size=200))
def test_slugs_are_closed(title):
    slug = text.slug_of(title)
    assert slug and len(slug.encode()) <= 64 and not re.search(r"[/\\.\s#?%<>()]", slug) and slug[0] != "-" and slug[-1] != "-"
    assert text.anchor_of(title) and not re.search(r"[ /\\#?%<>()\[\]]", text.anchor_of(title))


@FAST
@given(st.lists(st.sampled_from(["a", "A", "b c", "", "#", "é", "a-1"]), max_size=12))
def test_anchors_count_their_own_base(titles):
    got = text.anchors_of(titles)
    for k, t in enumerate(titles):
        n = sum(text.anchor_of(x) == text.anchor_of(t) for x in titles[:k])
        assert got[k] == text.anchor_of(t) + (f"-{n}" if n else "")


def unescaped(s):
    s = re.sub(r"&#(32|9);", lambda m: chr(int(m[1])), s)
    return re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", s)


@FAST
@given(st.text(alphabet="ab \t\n\\`*_[]<~$&#;x1.)->=|!", max_size=40), st.booleans())
def test_escaped_text_reads_as_it_was(value, start):
    out = inline.escape_text(value, start)
    assert unescaped(out) == value
    assert not re.search(r"(?<!\\)(?:\\\\)*[`*\[\]<$]", out) or all(m for m in re.findall(r"\\.", out))


@FAST
@given(st.text(alphabet="a` \n", max_size=30))
def test_code_spans_can_not_be_closed_from_within(value):
    out = inline.code(value)
    fence = re.match("`+", out)[0]
    inner = out[len(fence) : -len(fence)]
    assert out.endswith(fence) and fence not in re.findall("`+", inner) and "\n" not in out


SPAN = st.fixed_dictionaries({"depth": st.integers(0, 4), "kind": st.sampled_from(["text", "emph", "strong", "code", "math", "link", "note"]), "text": st.text(alphabet="ab *_`$\n", max_size=6), "target": st.sampled_from([None, "1", "http://x y"])})


@FAST
@given(st.lists(SPAN, max_size=12))
def test_inline_rendering_ends_and_keeps_words(spans):
    out = inline.render(inline.tree(spans))
    for n in inline.tree(spans):
        if n.kind == "text" and not n.children:
            assert set(re.findall("[ab]+", n.text)) <= set(re.findall("[ab]+", out)) or any(w in out for w in re.findall("[ab]+", n.text))


@FAST
@given(st.binary(max_size=300), st.sampled_from(["x.epub", "x.pptx", "x.mobi", "x.azw3", "x.pdf", "x.djvu", "x"]))
def test_any_bytes_give_a_row(data, name):
    for head in (b"", b"%PDF-1.4\n", b"PK\x03\x04", b"AT&TFORM", b"x" * 60 + b"BOOKMOBI"):
        status, error, meta, blocks, assets = C.parse(head + data, name)
        assert status in ("ok", "failed") and (status == "ok") == (error is None)
        assert all(b["kind"] and (b["depth"] or 0) <= markup.DEPTH for b in blocks)
        assert all(re.fullmatch(r"[A-Za-z0-9._-]+", a["filename"]) for a in assets)


@FAST
@given(st.text(max_size=200))
def test_any_markup_gives_blocks(html):
    for part in (html, f"<p>{html}<math>{html}</math>", f"<table><tr><td>{html}", f"<pre>{html}"):
        for k, b in enumerate(markup.blocks(part), 1):
            assert b["ord"] == k and all(s["depth"] <= markup.DEPTH for s in b["spans"])
    assert isinstance(math.mathml_latex(f"<math>{html}</math>")[0], str)


@FAST
@given(st.binary(max_size=200))
def test_decoders_end(data):
    assert len(C.palmdoc(data)) <= 10 * len(data) + 8
    assert isinstance(pdf.page_runs(data), list)
    kindle.marked(data, [0, len(data), 5], "m")
    with pytest.raises(kindle.Damaged):
        kindle.read_index([b"", data], 1)


@FAST
@given(st.lists(st.sampled_from(["..", ".", "a", "", "b c", "%2e%2e"]), max_size=6))
def test_resolved_paths_stay_inside(parts):
    out = C.resolve("OPS/t", "/".join(parts))
    assert out is None or out and ".." not in out.split("/") and not out.startswith("/")


def test_bombs_are_refused():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", b"<rootfile full-path='b.opf'/>" + b" " * 3_000_000)
    assert C.parse(out.getvalue(), "x.epub")[1] == "input rejected: decompression bomb"


def test_recognisers(spark):
    def words(image: bytes, language: str):
        if image == b"bad":
            raise OSError("engine")
        return recognition.tsv_words("5\t1\t1\t1\t1\t1\t10\t20\t30\t12\t91.5\thello\n4\t1\n5\t1\t1\t1\t1\t2\t50\t20\t30\t12\tx\tno\n5\t1\t1\t1\t1\t2\t50\t20\t30\t12\t88\t" + language)

    pages = spark.createDataFrame([(1, 1, bytearray(b"img")), (1, 2, bytearray(b"bad")), (2, 1, None)], "doc_id long, page int, image binary")
    rows = recognition.recognised_words(pages, words, "deu").collect()
    assert [(r.doc_id, r.page, r.text, r.conf) for r in rows] == [(1, 1, "hello", 91.5), (1, 1, "deu", 88.0)]
    recognition.ensure_recogniser(words, "deu+eng", ["deu", "eng"])
    for bad in ((None, "deu", None), (words, "d u", None), (words, "fra", ["deu"])):
        with pytest.raises(ValueError):
            recognition.ensure_recogniser(*bad)


def test_command_line(spark, tmp_path, capsys):
    from leafmill.__main__ import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.epub").write_bytes(Q.epub("T", [("One", "two")]))
    assert main([str(tmp_path / "in"), str(tmp_path / "out"), "--min-tokens", "0"]) == 0 and (tmp_path / "out" / "a" / "01-one.md").exists()
    assert main([str(tmp_path / "in"), str(tmp_path / "out")]) == 1 and "not empty" in capsys.readouterr().err
