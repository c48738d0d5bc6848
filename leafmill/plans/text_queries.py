"""Queries of the text rules and guards over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register, table
from ..functions import guards as G
from ..functions import text as X

_LINES = "l AS (SELECT doc_id, unnest(range(0, len(x))) AS k, unnest(x) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))"
_TITLES = "t AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)"


def _lines(s, d):
    return table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "t")).withColumn("k", F.col("k").cast("long"))


def _titles(s, d):
    return table(s, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


def _over_lines(name, f, sql):
    register(name, lambda s, d: _lines(s, d).select("doc_id", "k", f("t").alias("out")), f"WITH {_LINES} SELECT doc_id, k, {sql} AS out FROM l")


def _over_titles(name, f, sql, more=""):
    register(name, lambda s, d: _titles(s, d).select("page_id", f("title").alias("out")), f"WITH {_TITLES}{more} SELECT page_id, {sql} AS out FROM t")


_over_titles("gfm_anchor_slug", X.anchor_slug, r"coalesce(nullif(replace(regexp_replace(lower(trim(title)), '[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\- ]', '', 'g'), ' ', '-'), ''), 'section')")
register(
    "gfm_path_slug",
    lambda s, d: _titles(s, d).select("page_id", X.path_slug("title").alias("out")),
    rf"""WITH {_TITLES}, s AS (SELECT page_id, regexp_replace(regexp_replace(lower(nfc_normalize(title)), '[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}]+', '-', 'g'), '^-|-$', '', 'g') AS s FROM t)
SELECT page_id, coalesce(nullif(rtrim(CASE WHEN octet_length(encode(s)) <= 64 THEN s ELSE list_last(list_filter(list_transform(range(1, 65), lambda n: substr(s, 1, n)), lambda x: octet_length(encode(x)) <= 64)) END, '-'), ''), 'section') AS out FROM s""",
)
_over_lines("gfm_fold_newlines", lambda c: X.fold_newlines(F.concat(c, F.lit("\r\n\n"), c)), r"regexp_replace(t || chr(13) || chr(10) || chr(10) || t, '[\r\n]+', ' ', 'g')")
_over_lines("epb_collapse_ws", X.collapse_ws, r"regexp_replace(t, '[ \t\n\r\f]+', ' ', 'g')")
_over_titles("dup_normalize_title", X.normalize_title, r"trim(regexp_replace(lower(title), '[^\p{L}\p{N}]+', ' ', 'g'))")
_ENTITY = r"regexp_replace(regexp_replace(regexp_replace({}, '&(#\d+;)', '\\&\1', 'g'), '&(#[xX][0-9a-fA-F]+;)', '\\&\1', 'g'), '&([A-Za-z0-9]+;)', '\\&\1', 'g')"
_over_lines("wrt_escape_flow", X.escape_flow, "regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + _ENTITY.format(r"regexp_replace(t, '([\\`*_\[\]<~$])', '\\\1', 'g')") + r", '^([#\-+>=|])', '\\\1'), '^(\d{1,9})([.)])', '\1\\\2'), '^ ', '&#32;'), '^\t', '&#9;')")
_over_lines("wrt_escape_cell", X.escape_cell, "regexp_replace(regexp_replace(" + _ENTITY.format(r"regexp_replace(t, '([\\`*_\[\]<~$|])', '\\\1', 'g')") + r", ' $', '&#32;'), '\t$', '&#9;')")
_over_lines("wrt_html_text", X.html_text, "replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')")
register("wrt_yaml_scalar", lambda s, d: table(s, d, "conversations").select("conv_id", "turn", X.yaml_scalar("text").alias("out")), r"""SELECT conv_id, turn, '"' || regexp_replace(regexp_replace(text, '([\\"])', '\\\1', 'g'), '[\x00-\x1F\x7F]', ' ', 'g') || '"' AS out FROM conversations""")
_over_lines("wrt_fence_length", lambda c: X.fence_length(F.translate(c, "e", "`")).cast("long"), r"greatest(3, coalesce(list_max(list_transform(regexp_extract_all(replace(t, 'e', '`'), '`+'), lambda r: len(r))), 0) + 1)")
_over_lines("wrt_code_span", lambda c: X.code_span(F.translate(c, "e", "`")), r"""CASE WHEN t = '' THEN '` `' ELSE repeat('`', (coalesce(list_max(list_transform(regexp_extract_all(replace(t, 'e', '`'), '`+'), lambda r: len(r))), 0) + 1)::INTEGER) ||
 CASE WHEN regexp_full_match(t, ' *') THEN '' WHEN contains(replace(t, 'e', '`'), '`') OR t[1] = ' ' OR t[-1] = ' ' THEN ' ' ELSE '' END || replace(regexp_replace(t, '[\r\n]+', ' ', 'g'), 'e', '`') || CASE WHEN regexp_full_match(t, ' *') THEN '' WHEN contains(replace(t, 'e', '`'), '`') OR t[1] = ' ' OR t[-1] = ' ' THEN ' ' ELSE '' END ||
 repeat('`', (coalesce(list_max(list_transform(regexp_extract_all(replace(t, 'e', '`'), '`+'), lambda r: len(r))), 0) + 1)::INTEGER) END""")
_FENCE = "repeat('`', (coalesce(list_max(list_transform(regexp_extract_all(t, '`+'), lambda r: len(r))), 0) + 1)::INTEGER)"
_SPACE = "CASE WHEN regexp_full_match(t, ' *') THEN '' WHEN contains(t, '`') OR t[1] = ' ' OR t[-1] = ' ' THEN ' ' ELSE '' END"
_over_lines("wrt_math_span", X.math_span, rf"""CASE WHEN regexp_matches(t, '[$\r\n]') THEN {_FENCE} || {_SPACE} || regexp_replace(t, '[\r\n]+', ' ', 'g') || {_SPACE} || {_FENCE} ELSE '$' || t || '$' END""")
_over_lines("wrt_comment_note", lambda c: X.comment_note(F.translate(c, "e", "-")), r"'<!-- ' || regexp_replace(regexp_replace(regexp_replace(replace(t, 'e', '-'), '--', '- -', 'g'), '--', '- -', 'g'), '-$', '- ') || ' -->'")
_over_lines("wrt_atx_closing", lambda c: X.atx_closing(F.regexp_replace(c, r"\.$", " ##")), r"regexp_replace(regexp_replace(t, '\.$', ' ##'), '(^|[ \t])(#+[ \t]*)$', '\1\\\2')")
_over_lines("wrt_footnote_body", lambda c: X.footnote_body(F.concat(c, F.lit("\n"), c, F.lit("\n"))), r"t || chr(10) || CASE WHEN regexp_matches(t, '\S') THEN '    ' ELSE '' END || t || chr(10)")
_over_lines("mth_sanitize", X.sanitize_math, r"regexp_replace(replace(regexp_replace(replace(t, '\', chr(1)), '([${}])', '\\\1', 'g'), chr(1), '\backslash '), '[\r\n]+', ' ', 'g')")


def _dest(x: str, chars: str) -> str:
    for c in chars:
        quoted = c.replace("'", "''")
        x = f"replace({x}, '{quoted}', '%{ord(c):02X}')"
    return x


register("wrt_dest_path", lambda s, d: table(s, d, "pages").select("page_id", X.dest_path("url").alias("out")), f"SELECT page_id, {_dest('url', '%#? ()<>' + chr(92) + chr(34))} AS out FROM pages")
register("wrt_dest_url", lambda s, d: _titles(s, d).select("page_id", X.dest_url("title").alias("out")), f"WITH {_TITLES} SELECT page_id, {_dest('title', ' ()<>' + chr(92) + chr(34))} AS out FROM t")
register(
    "wrt_gfm_table",
    lambda s, d: table(s, d, "nation").groupBy("n_regionkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.array(x["n_nationkey"].cast("string"), x["n_name"])).alias("r")).select("n_regionkey", X.gfm_table(F.array(F.lit("Key"), F.lit("Name")), F.col("r")).alias("out")),
    "SELECT n_regionkey, '| Key | Name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || replace(n_name, '_', '\\_') || ' |' || chr(10), '' ORDER BY n_nationkey) AS out FROM nation GROUP BY n_regionkey",
)


def markdown_files(s, d):
    x = table(s, d, "conversations").withColumn("md", F.concat(F.lit("## "), X.atx_closing("role"), F.lit("\n\n"), X.escape_flow(X.fold_newlines("text")), F.lit("\n")))
    return x.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "md"))), lambda r: r["md"]), "\n").alias("markdown"))


register("wrt_markdown_files", markdown_files, "WITH c AS (SELECT conv_id, turn, role, regexp_replace(text, '[\\r\\n]+', ' ', 'g') AS t FROM conversations), e AS (SELECT conv_id, turn, '## ' || role || chr(10) || chr(10) || regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + _ENTITY.format(r"regexp_replace(t, '([\\`*_\[\]<~$])', '\\\1', 'g')") + r", '^([#\-+>=|])', '\\\1'), '^(\d{1,9})([.)])', '\1\\\2'), '^ ', '&#32;'), '^\t', '&#9;') || chr(10) AS md FROM c) SELECT conv_id, string_agg(md, chr(10) ORDER BY turn) AS markdown FROM e GROUP BY conv_id")

# ---------------------------------------------------------------- guards

register("grd_within_expansion", lambda s, d: table(s, d, "orders").select("o_orderkey", G.within_expansion((F.col("o_totalprice") * 4000).cast("long"), F.col("o_custkey") * 1000).alias("out")), "SELECT o_orderkey, d <= 536870912 AND (c = 0 OR d // greatest(c, 1) <= 200) AS out FROM (SELECT o_orderkey, trunc(o_totalprice * 4000)::BIGINT AS d, o_custkey * 1000 AS c FROM orders)")
_HREFS = "h AS (SELECT page_id, unnest(range(0, len(x))) AS k, unnest(x) AS href FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS x FROM pages))"


def _hrefs(s, d):
    return table(s, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("k", "href")).withColumn("k", F.col("k").cast("long"))


register("grd_has_scheme", lambda s, d: table(s, d, "pages").select("page_id", G.has_scheme("url").alias("whole"), G.has_scheme(F.regexp_replace("url", "^https?:", "")).alias("bare")), "SELECT page_id, regexp_matches(url, '^[^/#?]*:') AS whole, regexp_matches(regexp_replace(url, '^https?:', ''), '^[^/#?]*:') AS bare FROM pages")
register("grd_parent_dir", lambda s, d: table(s, d, "pages").select("page_id", G.parent_dir("url").alias("out")), "SELECT page_id, regexp_extract(url, '^(.*)/[^/]*$', 1) AS out FROM pages")
register("grd_media_filename", lambda s, d: table(s, d, "pages").select("page_id", G.media_filename("url", F.col("page_id") % 50).alias("out")), "SELECT page_id, lpad((page_id % 50)::VARCHAR, 3, '0') || '-' || regexp_replace(regexp_extract(url, '([^/]*)$', 1), '[^A-Za-z0-9._-]', '_', 'g') AS out FROM pages")
register(
    "grd_resolve_rel",
    lambda s, d: _hrefs(s, d).select("page_id", "k", G.resolve_rel(F.lit("text/part"), F.concat(F.repeat(F.lit("../"), (F.col("k") % 4).cast("int")), F.lit("./"), "href")).alias("out")),
    f"""WITH {_HREFS} SELECT page_id, k, CASE WHEN k % 4 = 3 THEN NULL ELSE array_to_string(list_concat(['text', 'part'][1:2 - k % 4], list_filter(string_split(href, '/'), lambda p: p <> '' AND p <> '.')), '/') END AS out FROM h""",
)
register(
    "grd_percent_decode",
    lambda s, d: table(s, d, "documents").select("doc_id", G.percent_decode(F.concat(F.replace(F.replace("text", F.lit("%"), F.lit("%25")), F.lit("e"), F.lit("%65")), F.lit("%C3%A9%41+%2"))).alias("out")),
    "SELECT doc_id, text || 'éA+%2' AS out FROM documents",
)
