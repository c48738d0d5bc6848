"""Queries of links, footnotes, figures and batches: events as a stream of elements, labels as outcomes, URLs as paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register, table
from ..operators import batch as B
from ..operators import links as K

_EL = "el AS (SELECT user_id AS doc_id, event_id // 100 AS file, event_id AS pos, CASE WHEN event_id % 4 = 0 THEN event_id END AS heading_id, CASE WHEN event_id % 3 = 0 THEN event_type || event_id % 7 END AS frag FROM events)"


def elements(s, d):
    e = F.col("event_id")
    return table(s, d, "events").select(F.col("user_id").alias("doc_id"), F.floor(e / 100).alias("file"), e.alias("pos"), F.when(e % 4 == 0, e).alias("heading_id"), F.when(e % 3 == 0, F.concat("event_type", (e % 7).cast("string"))).alias("frag"))


_NEAR = _EL + """, near AS (SELECT doc_id, file, pos, frag, coalesce(last_value(heading_id IGNORE NULLS) OVER (PARTITION BY doc_id, file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(heading_id IGNORE NULLS) OVER (PARTITION BY doc_id, file ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS anchor_heading FROM el)"""
register("epb_nearest_headings", lambda s, d: K.nearest_headings(elements(s, d)).select("doc_id", "file", "pos", "frag", "anchor_heading"), f"WITH {_NEAR} SELECT doc_id, file, pos, frag, anchor_heading FROM near WHERE frag IS NOT NULL")


def fix_links(s, d):
    near = K.nearest_headings(elements(s, d)).groupBy("doc_id", "file", "frag").agg(F.max("anchor_heading").alias("anchor_heading"))
    first = elements(s, d).where("heading_id IS NOT NULL").groupBy("doc_id", "file").agg(F.min("heading_id").alias("heading_id"))
    e = F.col("event_id")
    links = table(s, d, "events").select(F.col("user_id").alias("doc_id"), e.alias("pos"), F.floor(e / 100).alias("file"), F.concat("event_type", (e % 9).cast("string")).alias("frag"), F.when(e % 11 == 0, "http://x").when(e % 13 == 0, "").otherwise("part").alias("href"))
    return K.fix_links(links, near, first).select("doc_id", "pos", "block")


register(
    "epb_fix_links",
    fix_links,
    f"""WITH {_NEAR}, a AS (SELECT doc_id, file, frag, max(anchor_heading) AS h FROM near WHERE frag IS NOT NULL GROUP BY ALL), f AS (SELECT doc_id, file, min(heading_id) AS h FROM el WHERE heading_id IS NOT NULL GROUP BY ALL)
SELECT e.user_id AS doc_id, event_id AS pos, CASE WHEN event_id % 11 <> 0 AND event_id % 13 <> 0 THEN coalesce(a.h, f.h) END AS block FROM events e LEFT JOIN a ON a.doc_id = user_id AND a.file = event_id // 100 AND a.frag = event_type || event_id % 9 LEFT JOIN f ON f.doc_id = user_id AND f.file = event_id // 100""",
)


def _refs(s, d):
    e = F.col("event_id")
    return table(s, d, "events").select(F.col("user_id").alias("doc_id"), e.alias("ord"), (e % 3).alias("seq"), (e % 40 + F.when(e % 5 == 1, 0).otherwise(100)).alias("note_id"))


#: Four of five references are to notes that no node is.
_NOTE = "(event_id % 40 + CASE WHEN event_id % 5 = 1 THEN 0 ELSE 100 END)"


def relocate(s, d):
    e = F.col("event_id")
    nodes = table(s, d, "events").select(F.col("user_id").alias("doc_id"), e.alias("ord"), F.when(e % 6 == 0, e % 40).alias("note_id"))
    return K.relocate_footnotes(nodes, _refs(s, d)).select("doc_id", "ord", F.col("place").cast("long"))


register(
    "epb_relocate_footnotes",
    relocate,
    f"""WITH f AS (SELECT user_id AS doc_id, {_NOTE} AS note_id, min((event_id, event_id % 3)) AS r FROM events GROUP BY ALL),
n AS (SELECT user_id AS doc_id, event_id AS ord, CASE WHEN event_id % 6 = 0 THEN event_id % 40 END AS note_id FROM events)
SELECT n.doc_id, ord, row_number() OVER (PARTITION BY n.doc_id ORDER BY coalesce(r[1], ord), CASE WHEN r IS NULL THEN 0 ELSE 1 END, coalesce(r[2], 0), ord) AS place FROM n LEFT JOIN f USING (doc_id, note_id)""",
)


def _figures(s, d):
    e = F.col("event_id")
    return table(s, d, "events").select(F.col("user_id").alias("doc_id"), e.alias("ord"), F.concat(F.lit("img/"), F.col("event_type"), (e % 5).cast("string"), F.lit(".png")).alias("key"), F.when(e % 2 == 0, F.col("event_type")).otherwise("").alias("caption"))


register("epb_figure_assets", lambda s, d: K.figure_assets(_figures(s, d)).withColumn("n", F.col("n").cast("long")), "SELECT doc_id, key, row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS n FROM (SELECT user_id AS doc_id, 'img/' || event_type || event_id % 5 || '.png' AS key, min(event_id) AS o FROM events GROUP BY ALL)")
register(
    "epb_degrade_figures",
    lambda s, d: K.degrade_figures(_figures(s, d), _figures(s, d).where("ord % 4 = 0")).select("doc_id", "ord", "kind", "text"),
    """WITH f AS (SELECT user_id AS doc_id, event_id AS ord, 'img/' || event_type || event_id % 5 || '.png' AS key, CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END AS caption FROM events), a AS (SELECT DISTINCT doc_id, key FROM f WHERE ord % 4 = 0)
SELECT f.doc_id, ord, CASE WHEN a.key IS NOT NULL THEN 'figure' WHEN caption <> '' THEN 'para' ELSE 'raw' END AS kind, CASE WHEN a.key IS NOT NULL OR caption <> '' THEN caption ELSE 'image unavailable: ' || f.key END AS text FROM f LEFT JOIN a USING (doc_id, key)""",
)
register("epb_distinct_note_refs", lambda s, d: K.distinct_note_refs(_refs(s, d).withColumn("ord", F.floor(F.col("ord") / 50)).withColumn("seq", F.col("seq") + F.col("note_id") * 3)).withColumn("n", F.col("n").cast("long")), f"SELECT doc_id, ord, note_id, seq, row_number() OVER (PARTITION BY doc_id, ord ORDER BY seq) AS n FROM (SELECT user_id AS doc_id, event_id // 50 AS ord, {_NOTE} AS note_id, min(event_id % 3 + {_NOTE} * 3) AS seq FROM events GROUP BY ALL)")
register("epb_spine", lambda s, d: K.spine(table(s, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("seq"), (F.col("o_custkey") % 40).alias("id")), table(s, d, "customer").select(F.col("c_custkey").alias("doc_id"), (F.col("c_custkey") % 40 + F.when(F.col("c_custkey") % 7 == 0, 1000).otherwise(0)).alias("id"), F.col("c_name").alias("href"))), "SELECT o_custkey AS doc_id, o_orderkey AS seq, o_custkey % 40 AS id, c_name AS href FROM orders JOIN (SELECT *, c_custkey % 40 + CASE WHEN c_custkey % 7 = 0 THEN 1000 ELSE 0 END AS own FROM customer) ON o_custkey = c_custkey AND o_custkey % 40 = own")
register(
    "ppt_relationship_targets",
    lambda s, d: K.relationship_targets(table(s, d, "part").select(F.col("p_partkey").alias("doc_id"), F.lit("ppt/slides").alias("base"), F.when(F.col("p_partkey") % 9 == 0, "").otherwise(F.concat(F.lit("rId"), F.col("p_partkey").cast("string"))).alias("id"), F.concat(F.repeat(F.lit("../"), (F.col("p_partkey") % 4).cast("int")), F.lit("media/"), "p_brand").alias("target"), (F.col("p_partkey") % 5 == 0).alias("external"))).select("doc_id", "id", "path"),
    "SELECT p_partkey AS doc_id, 'rId' || p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN repeat('../', (p_partkey % 4)::INTEGER) || 'media/' || p_brand ELSE ['ppt/slides/', 'ppt/', ''][p_partkey % 4 + 1] || 'media/' || p_brand END AS path FROM part WHERE p_partkey % 9 <> 0 AND (p_partkey % 4 < 3 OR p_partkey % 5 = 0)",
)
register("ppt_slide_titles", lambda s, d: K.slide_titles(table(s, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 4 == 0, F.lit(None)).when(F.col("o_orderkey") % 4 == 1, " ").otherwise(F.col("o_orderpriority")).alias("title"))).select("doc_id", "seq", "heading", "note"), "SELECT o_custkey AS doc_id, o_orderkey AS seq, CASE WHEN o_orderkey % 4 < 2 THEN 'Slide ' || o_orderkey ELSE trim(o_orderpriority) END AS heading, CASE WHEN o_orderkey % 4 = 0 THEN 'unparsable slide' END AS note FROM orders")
register("ppt_nest_items", lambda s, d: K.nest_items(table(s, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("ord"), (F.col("event_id") * 7 % 5).cast("int").alias("level"))).select("doc_id", "ord", "parent"), "WITH e AS (SELECT user_id AS doc_id, event_id AS ord, event_id * 7 % 5 AS level FROM events) SELECT a.doc_id, a.ord, coalesce(max(b.ord), 0) AS parent FROM e a LEFT JOIN e b ON a.doc_id = b.doc_id AND b.ord < a.ord AND b.level < a.level GROUP BY ALL")

# ---------------------------------------------------------------- batch

_PATHS = "p AS (SELECT page_id, regexp_replace(url, '^https?://([^?#]*).*$', '\\1') AS rel FROM pages)"


def _paths(s, d):
    return table(s, d, "pages").select("page_id", F.regexp_replace("url", r"^https?://([^?#]*).*$", "$1").alias("rel"))


register("src_out_dir", lambda s, d: _paths(s, d).select("page_id", B.out_dir(F.col("rel")).alias("out_dir"), B.supported(F.concat("rel", F.lit(".PDF"))).alias("yes"), B.supported(F.col("rel")).alias("no")), f"WITH {_PATHS} SELECT page_id, regexp_replace(rel, '([^/])\\.[^./]*$', '\\1') AS out_dir, true AS yes, false AS no FROM p")
register("src_equal_outputs", lambda s, d: B.equal_outputs(_paths(s, d).select(F.regexp_extract("rel", "^([^/]*/[^/]*)", 1).alias("out_dir"))), f"WITH {_PATHS} SELECT regexp_extract(rel, '^([^/]*/[^/]*)', 1) AS out_dir, count(*) AS n FROM p GROUP BY ALL HAVING count(*) > 1")
register(
    "src_nested_outputs",
    lambda s, d: B.nested_outputs(_paths(s, d).select(F.when(F.col("page_id") % 3 == 0, F.regexp_extract("rel", "^([^/]*/[^/]*)", 1)).when(F.col("page_id") % 3 == 1, F.regexp_extract("rel", "^([^/]*)", 1)).otherwise(F.regexp_replace("rel", "/$", "")).alias("out_dir"))),
    f"""WITH {_PATHS}, o AS (SELECT DISTINCT CASE page_id % 3 WHEN 0 THEN regexp_extract(rel, '^([^/]*/[^/]*)', 1) WHEN 1 THEN regexp_extract(rel, '^([^/]*)', 1) ELSE regexp_replace(rel, '/$', '') END AS out_dir FROM p)
SELECT a.out_dir, arg_max(b.out_dir, len(b.out_dir)) AS within FROM o a JOIN o b ON a.out_dir <> b.out_dir AND starts_with(a.out_dir, b.out_dir || '/') GROUP BY ALL""",
)
_MAGIC = "CASE page_id % 6 WHEN 0 THEN '%PDF-1.7' WHEN 1 THEN 'AT&TFORM' WHEN 2 THEN repeat('x', 60) || 'BOOKMOBI!' WHEN 3 THEN 'PK' || chr(3) || chr(4) ELSE url END"
register(
    "src_detected",
    lambda s, d: table(s, d, "pages").select("page_id", B.detected(F.expr("encode(" + _MAGIC.replace("chr(3)", "char(3)").replace("chr(4)", "char(4)") + ", 'UTF-8')"), F.when(F.col("page_id") % 6 == 4, "djv").otherwise("PDF")).alias("format")),
    "SELECT page_id, ['pdf', 'djvu', 'mobi', 'zip', 'djvu', NULL][page_id % 6 + 1] AS format FROM pages",
)
_ERR = "CASE WHEN quality = 0 AND toxic = 1 THEN 'encrypted content' WHEN quality = 0 THEN 'malformed input: x' END"
register(
    "bat_exit_codes",
    lambda s, d: B.batch_exit_code(table(s, d, "labels").join(table(s, d, "documents"), "doc_id").select("source", F.expr(_ERR).alias("error")), ["source"]).withColumn("code", F.col("code").cast("int")),
    f"WITH o AS (SELECT source, {_ERR} AS error FROM labels JOIN documents USING (doc_id)) SELECT source, count(*) AS total, count(error) AS failed, CASE WHEN count(error) = 0 THEN 0 WHEN count(error) < count(*) THEN 3 WHEN bool_and(regexp_matches(error, 'unsupported|DRM|encrypted')) THEN 2 ELSE 1 END AS code FROM o GROUP BY source",
)
register(
    "snk_library_index",
    lambda s, d: B.library_index(table(s, d, "documents").join(table(s, d, "labels"), "doc_id").select(F.col("source").alias("library"), F.col("doc_id").alias("ord"), F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.concat(F.lit("Doc "), F.col("doc_id").cast("string"))).alias("title"), F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("rel_dir"), F.lit("epub").alias("format"), (F.col("n_chars") % 9).alias("files"), F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".epub")).alias("input"), F.expr(_ERR).alias("error"))),
    f"""WITH o AS (SELECT source AS library, doc_id AS ord, CASE WHEN doc_id % 3 = 0 THEN 'd/' || doc_id ELSE 'Doc ' || doc_id END AS title, 'd/' || doc_id AS dir, n_chars % 9 AS files, {_ERR} AS error FROM documents JOIN labels USING (doc_id))
SELECT library, '---' || chr(10) || 'kind: library' || chr(10) || 'documents: ' || (count(*) - count(error)) || chr(10) || 'failed: ' || count(error) || chr(10) || '---' || chr(10) || chr(10) || '# Converted documents' || chr(10) || chr(10) || (count(*) - count(error)) || ' of ' || count(*) || ' inputs converted.' || chr(10) || chr(10)
 || coalesce(string_agg('- [' || title || '](' || dir || '/index.md) — epub, ' || files || ' files' || chr(10), '' ORDER BY ord) FILTER (error IS NULL), '') || CASE WHEN count(error) > 0 THEN chr(10) || '## Failed' || chr(10) || chr(10) || string_agg('- `' || dir || '.epub` — ' || error || chr(10), '' ORDER BY ord) FILTER (error IS NOT NULL) ELSE '' END AS markdown FROM o GROUP BY library""",
)
