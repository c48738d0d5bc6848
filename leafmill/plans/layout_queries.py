"""Queries of page layout: order lines as positioned runs and recognised words, regions and nations as zones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register, table
from ..operators import layout as L

#: An order is a page of the document o (its key modulo 50), a line item a run.
_RUNS = """runs AS (SELECT l_orderkey % 50 AS doc_id, l_orderkey AS page, l_linenumber::BIGINT AS seq, (l_partkey % 100)::DOUBLE AS x, (700 - 12 * (l_suppkey % 8))::DOUBLE + (l_partkey % 5) AS y, CASE WHEN l_quantity > 48 THEN 24 WHEN l_quantity > 46 THEN 18 WHEN l_quantity > 44 THEN 14 WHEN l_quantity > 42 THEN 10 ELSE 12 END::DOUBLE AS size, CASE l_linenumber WHEN 5 THEN ' part ' || l_partkey WHEN 6 THEN '  ' ELSE 'part ' || l_partkey END AS text FROM lineitem),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY y DESC, x, seq) AS r FROM runs),
g AS (SELECT doc_id, page, r, seq, x, y, size, text, y AS first_y, 1::BIGINT AS line FROM s WHERE r = 1
  UNION ALL SELECT s.doc_id, s.page, s.r, s.seq, s.x, s.y, s.size, s.text, CASE WHEN abs(g.first_y - s.y) <= greatest(s.size * 0.5, 2) THEN g.first_y ELSE s.y END, CASE WHEN abs(g.first_y - s.y) <= greatest(s.size * 0.5, 2) THEN g.line ELSE g.line + 1 END FROM g JOIN s ON s.doc_id = g.doc_id AND s.page = g.page AND s.r = g.r + 1)"""
_LINES = _RUNS + """, lines AS (SELECT doc_id, page, line, min(x) AS x, max(y) AS y, max(size) AS size, trim(string_agg(CASE WHEN text[1] = ' ' THEN '' ELSE ' ' END || trim(text), '' ORDER BY r)) AS text FROM g GROUP BY ALL HAVING trim(string_agg(text, '')) <> ''),
body AS (SELECT doc_id, arg_min(b, (-n, b)) AS body FROM (SELECT doc_id, round(size)::BIGINT AS b, count(*) AS n FROM lines GROUP BY ALL) GROUP BY doc_id)"""


def runs(s, d):
    q = F.col("l_quantity")
    size = F.when(q > 48, 24.0).when(q > 46, 18.0).when(q > 44, 14.0).when(q > 42, 10.0).otherwise(12.0)
    return table(s, d, "lineitem").select(
        (F.col("l_orderkey") % 50).alias("doc_id"), F.col("l_orderkey").alias("page"), F.col("l_linenumber").cast("long").alias("seq"), (F.col("l_partkey") % 100).cast("double").alias("x"),
        ((700 - 12 * (F.col("l_suppkey") % 8)) + (F.col("l_partkey") % 5)).cast("double").alias("y"), size.alias("size"), F.when(F.col("l_linenumber") == 6, "  ").otherwise(F.concat(F.when(F.col("l_linenumber") == 5, " ").otherwise(""), F.lit("part "), F.col("l_partkey").cast("string"))).alias("text"),
    )


def _grouped(s, d):
    return L.group_lines(runs(s, d)).withColumn("line", F.col("line").cast("long"))


def _lines(s, d):
    return L.lines(_grouped(s, d))


register("pdf_group_lines", lambda s, d: _grouped(s, d).select("doc_id", "page", "seq", "line"), f"WITH RECURSIVE {_RUNS} SELECT doc_id, page, seq, line FROM g")
register("pdf_lines", _lines, f"WITH RECURSIVE {_LINES} SELECT * FROM lines")
register("pdf_body_size", lambda s, d: L.body_size(_lines(s, d)), f"WITH RECURSIVE {_LINES} SELECT * FROM body")


def page_blocks(s, d):
    lines = _lines(s, d)
    return L.page_blocks(lines, L.body_size(lines)).withColumn("block", F.col("block").cast("long"))


register(
    "pdf_page_blocks",
    page_blocks,
    f"""WITH RECURSIVE {_LINES}, v AS (SELECT lines.*, CASE WHEN size / body >= 1.8 THEN 1 WHEN size / body >= 1.4 THEN 2 WHEN size / body >= 1.15 THEN 3 END AS level FROM lines JOIN body USING (doc_id)),
b AS (SELECT *, CASE WHEN level IS NOT NULL OR lag(level) OVER w IS NOT NULL OR lag(line) OVER w IS NULL OR abs(lag(y) OVER w - y) > 1.5 * greatest(size, lag(size) OVER w) THEN 1 ELSE 0 END AS new FROM v WINDOW w AS (PARTITION BY doc_id, page ORDER BY line)),
k AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page ORDER BY line)::BIGINT AS block FROM b)
SELECT doc_id, page, block, CASE WHEN max(level) IS NULL THEN 'para' ELSE 'heading' END AS kind, max(level) AS level, string_agg(text, ' ' ORDER BY line) AS text FROM k GROUP BY ALL""",
)
register("grd_cumulative_bytes", lambda s, d: L.cumulative_bytes(table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text")).select("doc_id", "page", "total"), "SELECT conv_id AS doc_id, turn AS page, sum(octet_length(encode(text))) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS total FROM conversations")
register(
    "pdf_page_notes",
    lambda s, d: table(s, d, "orders").select(F.col("o_orderkey").alias("page"), L.page_note(F.col("o_orderstatus") == "F", F.col("o_custkey") % 3 > 0, F.col("o_custkey") % 5 == 0, F.when(F.col("o_custkey") % 2 == 0, F.element_at(F.array(F.lit("text"), F.lit("fallback"), F.lit("note")), (F.col("o_custkey") % 3 + 1).cast("int"))), F.col("o_orderkey")).alias("note")),
    """SELECT o_orderkey AS page, CASE WHEN o_orderstatus = 'F' THEN NULL WHEN o_custkey % 3 > 0 AND o_custkey % 2 > 0 THEN 'scanned page: no text layer; OCR not enabled' WHEN o_custkey % 3 = 1 THEN 'page image only; OCR found no confident text' WHEN o_custkey % 3 = 2 THEN 'no text recovered by OCR'
 WHEN o_custkey % 5 <> 0 THEN 'page ' || o_orderkey || ': no extractable text' END AS note FROM orders""",
)

_WORDS = "w AS (SELECT l_orderkey % 50 AS doc_id, l_orderkey AS page, 1::BIGINT AS block, l_suppkey % 2 AS par, l_suppkey % 4 AS line, l_linenumber::BIGINT AS word, (l_partkey % 500)::DOUBLE AS \"left\", (l_suppkey % 700)::DOUBLE AS top, 20 + l_quantity AS width, 12::DOUBLE AS height, CASE WHEN l_linenumber = 7 THEN -1 ELSE floor(l_extendedprice)::BIGINT % 101 END::DOUBLE AS conf, CASE WHEN l_tax > 0.07 THEN ' ' ELSE l_returnflag || l_partkey END AS text FROM lineitem)"


def words(s, d):
    c = F.col
    return table(s, d, "lineitem").select(
        (c("l_orderkey") % 50).alias("doc_id"), c("l_orderkey").alias("page"), F.lit(1).cast("long").alias("block"), (c("l_suppkey") % 2).alias("par"), (c("l_suppkey") % 4).alias("line"), c("l_linenumber").cast("long").alias("word"), (c("l_partkey") % 500).cast("double").alias("left"),
        (c("l_suppkey") % 700).cast("double").alias("top"), (20 + c("l_quantity")).alias("width"), F.lit(12.0).alias("height"), F.when(c("l_linenumber") == 7, -1.0).otherwise((F.floor("l_extendedprice") % 101).cast("double")).alias("conf"), F.when(c("l_tax") > 0.07, " ").otherwise(F.concat("l_returnflag", c("l_partkey").cast("string"))).alias("text"),
    )


def rounded(c: str, n: int):
    """To ``n`` decimal places as SQL's round does, of the binary number times a power of ten; Spark's rounds the number's decimal digits, which differs where those end in a 5."""
    return F.round(F.col(c) * 10.0**n) / 10.0**n


_OCR = _WORDS + """, l AS (SELECT doc_id, page, block, par, line, min("left") AS "left", min(top) AS top, max("left" + width) AS "right", max(top + height) AS bottom, avg(conf) AS conf, string_agg(text, ' ' ORDER BY word, text) AS text FROM w WHERE conf >= 0 AND trim(text) <> '' GROUP BY doc_id, page, block, par, line)"""
register("ocr_lines", lambda s, d: L.recognised_lines(words(s, d)).withColumn("conf", rounded("conf", 6)), f'WITH {_OCR} SELECT doc_id, page, block, par, line, "left", top, "right", bottom, round(conf, 6) AS conf, text FROM l')
register("ocr_outcome", lambda s, d: L.recognition_outcome(L.recognised_lines(words(s, d)).withColumn("conf", rounded("conf", 6))).withColumn("conf", rounded("conf", 5)), f"WITH {_OCR}, o AS (SELECT doc_id, page, sum(len(trim(text)))::BIGINT AS chars, avg(round(conf, 6)) AS c FROM l GROUP BY ALL) SELECT doc_id, page, chars, round(c, 5) AS conf, CASE WHEN chars >= 8 AND c >= 60 THEN 'text' ELSE 'fallback' END AS outcome FROM o")
register("ocr_outcome_forced", lambda s, d: L.recognition_outcome(L.recognised_lines(words(s, d)), force_text=True).drop("conf"), f"WITH {_OCR}, o AS (SELECT doc_id, page, sum(len(trim(text)))::BIGINT AS chars FROM l GROUP BY ALL) SELECT doc_id, page, chars, CASE WHEN chars >= 8 THEN 'text' ELSE 'note' END AS outcome FROM o")
register("ocr_page_lines", lambda s, d: L.recognised_page_lines(L.recognised_lines(words(s, d))).withColumn("line", F.col("line").cast("long")), f'WITH {_OCR} SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY block, par, line) AS line, "left" AS x, -top AS y, bottom - top AS size, text FROM l')


def printed(s, d):
    docs = table(s, d, "documents")
    lines = docs.select("doc_id", F.lit(1).alias("page"), F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("line", F.col("line").cast("long"))
    lines = lines.withColumn("text", F.when(F.col("line") % 5 == 0, "***").otherwise(F.col("text")))
    second = F.element_at(F.split("text", "\n"), F.least(F.lit(2), F.size(F.split("text", "\n"))))
    titles = docs.select("doc_id", F.lit(1).alias("page"), F.lit(1).alias("seq"), F.concat(F.lit("*"), second, F.lit("!")).alias("title"))
    return L.printed_titles(lines, titles).select("doc_id", "line", "printed")


register(
    "dup_printed_titles",
    printed,
    r"""WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents), l AS (SELECT doc_id, unnest(range(0, len(x))) AS line, unnest(x) AS t0 FROM x),
n AS (SELECT doc_id, trim(regexp_replace(lower(x[least(2, len(x))]), '[^\p{L}\p{N}]+', ' ', 'g')) AS title FROM x),
y AS (SELECT doc_id, line, nullif(trim(regexp_replace(lower(CASE WHEN line % 5 = 0 THEN '***' ELSE t0 END), '[^\p{L}\p{N}]+', ' ', 'g')), '') AS t FROM l),
c AS (SELECT y.*, lead(t, 1) OVER w AS t2, lead(t, 2) OVER w AS t3 FROM y WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
m AS (SELECT c.doc_id, line, CASE WHEN t = title THEN 1 WHEN t || ' ' || t2 = title THEN 2 WHEN t || ' ' || t2 || ' ' || t3 = title THEN 3 END AS run FROM c JOIN n USING (doc_id) WHERE title <> ''),
f AS (SELECT doc_id, min((line, run)) AS f FROM m WHERE run IS NOT NULL GROUP BY doc_id)
SELECT l.doc_id, line, coalesce(line >= f[1] AND line < f[1] + f[2], false) AS printed FROM l LEFT JOIN f USING (doc_id)""",
)

_ZONES = """z AS (SELECT r_regionkey::BIGINT AS doc_id, 1::BIGINT AS page, [0] AS node_path, 'page' AS kind, '' AS text, 0::DOUBLE AS y0, 900::DOUBLE AS y1 FROM region
  UNION ALL SELECT n_regionkey, 1, [0, n_nationkey], CASE WHEN n_nationkey % 2 = 0 THEN 'para' ELSE 'column' END, '', 0, 100 FROM nation
  UNION ALL SELECT n_regionkey, 1, [0, n_nationkey, c_custkey], 'line', CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END, 10, 20 + c_custkey % 13 FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT n_regionkey, 1, [0, n_nationkey, c_custkey, w], 'word', c_mktsegment || w, 10, 20 FROM customer JOIN nation ON c_nationkey = n_nationkey CROSS JOIN range(1, 3) r(w))"""


def zones(s, d):
    r, n, c = (table(s, d, x) for x in ("region", "nation", "customer"))
    own = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    L_ = lambda x: F.lit(x).cast("double")
    path = lambda *x: F.array(*(F.lit(v).cast("long") if isinstance(v, int) else F.col(v).cast("long") for v in x))

    def of(df, doc, p, kind, text, y0, y1):
        return df.select(F.col(doc).cast("long").alias("doc_id"), F.lit(1).cast("long").alias("page"), p.alias("node_path"), kind.alias("kind"), text.alias("text"), y0.alias("y0"), y1.alias("y1"))

    two = own.withColumn("w", F.explode(F.array(F.lit(1), F.lit(2))))
    return (
        of(r, "r_regionkey", path(0), F.lit("page"), F.lit(""), L_(0), L_(900))
        .unionByName(of(n, "n_regionkey", path(0, "n_nationkey"), F.when(F.col("n_nationkey") % 2 == 0, "para").otherwise("column"), F.lit(""), L_(0), L_(100)))
        .unionByName(of(own, "n_regionkey", path(0, "n_nationkey", "c_custkey"), F.lit("line"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name")), L_(10), (20 + F.col("c_custkey") % 13).cast("double")))
        .unionByName(of(two, "n_regionkey", path(0, "n_nationkey", "c_custkey", "w"), F.lit("word"), F.concat("c_mktsegment", F.col("w").cast("string")), L_(10), L_(20)))
    )


_ZLINES = _ZONES + """, ln AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY node_path) AS line, lag(node_path[2]) OVER (PARTITION BY doc_id ORDER BY node_path) AS before FROM z WHERE kind = 'line'),
zl AS (SELECT l.doc_id, l.page, l.line, coalesce(nullif(trim(l.text), ''), w.joined, '') AS text, l.y1 - l.y0 AS size, l.before IS NULL OR l.before <> l.node_path[2] AS para_start FROM ln l LEFT JOIN (SELECT doc_id, node_path[1:3] AS p, string_agg(text, ' ' ORDER BY node_path) AS joined FROM z WHERE kind = 'word' GROUP BY ALL) w ON w.doc_id = l.doc_id AND w.p = l.node_path)"""


def _zone_lines(s, d):
    return L.zone_lines(zones(s, d)).withColumn("line", F.col("line").cast("long"))


def zone_blocks(s, d):
    lines = _zone_lines(s, d)
    return L.zone_blocks(lines, L.body_size(lines)).withColumn("block", F.col("block").cast("long"))


register("djv_zone_lines", _zone_lines, f"WITH {_ZLINES} SELECT * FROM zl")
register(
    "djv_zone_blocks",
    zone_blocks,
    f"""WITH {_ZLINES}, body AS (SELECT doc_id, arg_min(b, (-n, b)) AS body FROM (SELECT doc_id, round(size)::BIGINT AS b, count(*) AS n FROM zl GROUP BY ALL) GROUP BY doc_id),
v AS (SELECT zl.*, CASE WHEN size / body >= 1.8 THEN 1 WHEN size / body >= 1.4 THEN 2 WHEN size / body >= 1.15 THEN 3 END AS level FROM zl JOIN body USING (doc_id)),
b AS (SELECT *, CASE WHEN level IS NOT NULL OR lag(level) OVER w IS NOT NULL OR para_start OR lag(line) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM v WINDOW w AS (PARTITION BY doc_id, page ORDER BY line)),
k AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page ORDER BY line)::BIGINT AS block FROM b)
SELECT doc_id, page, block, CASE WHEN max(level) IS NULL THEN 'para' ELSE 'heading' END AS kind, max(level) AS level, string_agg(text, ' ' ORDER BY line) AS text FROM k GROUP BY ALL""",
)


def outline(s, d):
    z = zones(s, d).select("doc_id", "node_path", F.when(F.col("kind") == "column", F.when(F.element_at("node_path", 2) % 3 == 0, " ").otherwise("column")).otherwise(F.concat("kind", "text")).alias("title"), F.concat(F.when(F.size("node_path") > 2, "#").otherwise("p"), F.element_at("node_path", -1).cast("string")).alias("url"))
    return L.outline_levels(z).withColumn("node_path", F.array_join(F.col("node_path").cast("array<string>"), "."))


register(
    "djv_outline_levels",
    outline,
    f"""WITH {_ZONES}, b AS (SELECT doc_id, node_path, CASE WHEN kind = 'column' THEN CASE WHEN node_path[2] % 3 = 0 THEN ' ' ELSE 'column' END ELSE kind || text END AS title, CASE WHEN len(node_path) > 2 THEN '#' ELSE 'p' END || node_path[-1] AS url FROM z)
SELECT doc_id, CASE WHEN url[1] = '#' THEN url[2:]::INTEGER ELSE 0 END AS page, array_to_string(node_path, '.') AS node_path, least(len(node_path), 6)::INTEGER AS level, trim(title) AS title FROM b WHERE NOT EXISTS (SELECT 1 FROM b t WHERE t.doc_id = b.doc_id AND trim(t.title) = '' AND b.node_path[1:len(t.node_path)] = t.node_path)""",
)
