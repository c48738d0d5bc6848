"""Text rules on the cases that are hard."""

import pytest
from pyspark.sql import functions as F

from leafmill.functions import guards as G
from leafmill.functions import text as X
from leafmill.operators import layout as L
from leafmill.operators import structure as S


def each(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_anchors(spark):
    cases = {"Don't Panic": "dont-panic", "Background & Notes": "background--notes", "Fig ½": "fig-", "①はじめに": "はじめに", "***": "section", "a  b": "a--b", "line\nbreak": "line-break", "  x  ": "x", None: None, "ΣΑΣ": "σασ"}
    assert each(spark, X.anchor_slug, list(cases)) == list(cases.values())


def test_path_slugs(spark):
    got = each(spark, X.path_slug, ["Hello, World!", "", None, "é" * 60, "--a--", "A" * 100, "日本 語"])
    assert got[:3] == ["hello-world", "section", None] and got[3] == "é" * 32 and got[4] == "a" and got[5] == "a" * 64 and got[6] == "日本-語"


@pytest.mark.parametrize("source,target,link", [("a/b/c.md", "a/x.md#y", "../x.md#y"), ("01-intro/index.md", "02-methods.md#m", "../02-methods.md#m"), ("index.md", "a/b.md", "a/b.md"), ("a/b.md", "a/b.md", "b.md"), ("a/b/c.md", "index.md", "../../index.md")])
def test_relativize(spark, source, target, link):
    assert spark.range(1).select(S.relativize(F.lit(source), F.lit(target)).alias("o")).first().o == link


def test_guards(spark):
    df = spark.createDataFrame([("a/b", "../c.x", "a/c.x"), ("a", "../../c", None), ("a", "/c/./d", "c/d"), ("", ".", None), ("a", "..", None)], "b string, t string, w string")
    assert all(r.o == r.w for r in df.select("w", G.resolve_rel("b", "t").alias("o")).collect())
    assert each(spark, G.percent_decode, ["a%20b", "%zz%4", "%ff", "a+b", None]) == ["a b", "%zz%4", "%ff", "a+b", None]
    assert each(spark, G.has_scheme, ["http://x", "a/b:c", "mailto:x", "?a:b", ""]) == [True, False, True, False, False]
    sizes = spark.createDataFrame([(200, 1, True), (201, 1, False), (5, 0, True), (600 << 20, 600 << 20, False)], "d long, c long, ok boolean")
    assert all(r.o == r.ok for r in sizes.select("ok", G.within_expansion("d", "c").alias("o")).collect())


def test_markdown(spark):
    assert each(spark, X.escape_flow, ["# a", "1. b", "12) c", "a*b_c", " x", "AT&T &amp; &#1;", "- x"]) == ["\\# a", "1\\. b", "12\\) c", "a\\*b\\_c", "&#32;x", "AT&T \\&amp; \\&#1;", "\\- x"]
    assert each(spark, X.code_span, ["a", "", "  ", "a`b", "``", " x"]) == ["`a`", "` `", "`  `", "`` a`b ``", "``` `` ```", "`  x `"]
    assert each(spark, X.comment_note, ["a--b", "x---", "-"]) == ["<!-- a- -b -->", "<!-- x- - -  -->", "<!-- -  -->"]
    assert each(spark, X.atx_closing, ["a #", "a#", "#", "a ## "]) == ["a \\#", "a#", "\\#", "a \\## "]
    assert each(spark, X.math_block, ["x", "a$b", "a\n\nb"])[0] == "$$\nx\n$$\n" and each(spark, X.math_block, ["a$b"])[0].startswith("```\n")
    assert each(spark, X.yaml_scalar, ['a"b\\c\n']) == ['"a\\"b\\\\c "']


def test_balance(spark):
    rows = [(1, 1, "heading", 1, "A"), (1, 2, "para", None, "x" * 400), (1, 3, "heading", 2, "B"), (1, 4, "para", None, "y"), (1, 5, "heading", 3, "C"), (1, 6, "para", None, "z"), (1, 7, "heading", 2, "D"), (1, 8, "para", None, "d" * 900), (1, 9, "heading", 1, "E")]
    blocks = spark.createDataFrame(rows, "doc_id long, ord long, kind string, level int, text string")
    got = {r.title: (r.into, r.body_tokens, r.alive) for r in S.merge_small(S.sections(S.fold_sections(blocks)), 50, 1000).collect()}
    assert got == {"A": (1, 101 + 1 + 1 + 1 + 1, True), "B": (1, 3, False), "C": (1, 1, False), "D": (7, 226, True), "E": (9, 0, True)}
    assert {r.title: r.parent for r in S.sections(S.fold_sections(blocks)).collect()} == {"A": 0, "B": 1, "C": 3, "D": 1, "E": 0}


def test_titles_claim_in_turn(spark):
    lines = spark.createDataFrame([(1, 1, i, t) for i, t in enumerate(["Chapter", "One", "text", "Chapter One", "more"], 1)], "doc_id long, page int, line long, text string")
    titles = spark.createDataFrame([(1, 1, 1, "chapter one"), (1, 1, 2, "Chapter One!")], "doc_id long, page int, seq int, title string")
    marked = L.printed_titles(lines, titles)
    assert [r.printed for r in marked.orderBy("line").collect()] == [True, True, False, True, False]
    assert L.without_printed(marked).count() == 2
    with_start = marked.withColumn("para_start", F.col("line") == 4)
    assert [r.para_start for r in L.without_printed(with_start).orderBy("line").collect()] == [False, True]


def test_empty_streams(spark):
    blocks = spark.createDataFrame([], "doc_id long, ord long, kind string, level int, text string")
    tree = S.sections(S.fold_sections(blocks))
    assert S.merge_small(tree).count() == 0 and S.frontmatter(S.navigation(S.assign_paths(tree))).count() == 0
