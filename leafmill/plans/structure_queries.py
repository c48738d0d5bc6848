"""Queries of the structuring engine over the atlas, the documents and the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register, table
from ..operators import structure as S
from ..storage import saved
from . import atlas

MIN, MAX = 40, 120
#: A title within a line, in SQL.
_LABEL = r"regexp_replace({}, '([\\`*_\[\]<~$])', '\\\1', 'g')"


def _files(spark, d):
    return saved(S.assign_paths(S.sections(saved(S.fold_sections(atlas.blocks(spark, d)))), ascii_titles=True))


def _site(spark, d):
    return S.rooted(_files(spark, d), atlas.documents(spark, d))


def _crumbs(df):
    return df.withColumn("breadcrumb", F.array_join("breadcrumb", " > ")).withColumn("ordinal_path", F.array_join(F.transform("ordinal_path", lambda x: x.cast("string")), "."))


register("core_fold_sections", lambda s, d: S.fold_sections(atlas.blocks(s, d)).select("doc_id", "ord", "kind", "section", "parent"), f"WITH {atlas.FOLDED} SELECT doc_id, ord, kind, section, parent FROM folded")
register("core_section_pages", lambda s, d: S.section_pages(S.fold_sections(atlas.blocks(s, d))), f"WITH {atlas.FOLDED} SELECT doc_id, section, min(page_from) AS page_from, max(page_to) AS page_to FROM folded WHERE kind <> 'heading' GROUP BY ALL")
register("core_section_tokens", lambda s, d: S.sections(S.fold_sections(atlas.blocks(s, d))).drop("parent_level"), f"WITH {atlas.SECTIONS} SELECT * FROM sections")


def token_estimate(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.sum(S.tokens(F.lit("para"), F.col("line"))).alias("tokens"), F.count("*").alias("blocks"))


register("core_token_estimate", token_estimate, "SELECT doc_id, sum(octet_length(encode(line)) // 4 + 1)::BIGINT AS tokens, count(*) AS blocks FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id")

register(
    "core_merge_small_sections",
    lambda s, d: S.merge_small(S.sections(S.fold_sections(atlas.blocks(s, d))), MIN, MAX).select("doc_id", "section", F.col("into"), "body_tokens", "alive"),
    f"""WITH {atlas.SECTIONS}, small3 AS (SELECT * FROM sections WHERE level = 3 AND body_tokens < {MIN} AND parent > 0),
g2 AS (SELECT s.*, s.body_tokens + coalesce((SELECT sum(k.body_tokens + octet_length(encode(k.title)) // 4 + 1) FROM small3 k WHERE k.doc_id = s.doc_id AND k.parent = s.section), 0) AS t,
       (SELECT count(*) FROM sections k WHERE k.doc_id = s.doc_id AND k.parent = s.section) - (SELECT count(*) FROM small3 k WHERE k.doc_id = s.doc_id AND k.parent = s.section) AS kids FROM sections s WHERE level = 2),
small2 AS (SELECT * FROM g2 WHERE kids = 0 AND t <= {MAX} AND t < {MIN}),
g1 AS (SELECT s.*, s.body_tokens + coalesce((SELECT sum(k.t + octet_length(encode(k.title)) // 4 + 1) FROM small2 k WHERE k.doc_id = s.doc_id AND k.parent = s.section), 0) AS t FROM sections s WHERE level = 1),
u AS (SELECT doc_id, section, section AS into1, t, true AS alive FROM g1
  UNION ALL SELECT g.doc_id, g.section, CASE WHEN k.section IS NULL THEN g.section ELSE g.parent END, g.t, k.section IS NULL FROM g2 g LEFT JOIN small2 k USING (doc_id, section)
  UNION ALL SELECT s.doc_id, s.section, CASE WHEN k.section IS NULL THEN s.section WHEN m.section IS NULL THEN s.parent ELSE m.parent END, s.body_tokens, k.section IS NULL FROM sections s LEFT JOIN small3 k USING (doc_id, section) LEFT JOIN small2 m ON m.doc_id = s.doc_id AND m.section = s.parent WHERE s.level = 3)
SELECT doc_id, section, into1 AS "into", t::BIGINT AS body_tokens, alive FROM u""",
)


def split_parts(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line")).select("doc_id", "ord", S.tokens(F.lit("para"), F.col("line")).alias("t"))
    return S.split_parts(lines, ["doc_id"], "ord", "t", 200).select("doc_id", F.col("ord").cast("long"), "t", F.col("part").cast("long"))


register(
    "core_split_parts",
    split_parts,
    """WITH RECURSIVE l AS (SELECT doc_id, unnest(range(0, len(x))) AS ord, unnest(list_transform(x, lambda y: octet_length(encode(y)) // 4 + 1)) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
p AS (SELECT doc_id, ord, t, t AS c, 1::BIGINT AS part FROM l WHERE ord = 0
  UNION ALL SELECT l.doc_id, l.ord, l.t, CASE WHEN p.c > 0 AND p.c + l.t > 200 THEN l.t ELSE p.c + l.t END, p.part + CASE WHEN p.c > 0 AND p.c + l.t > 200 THEN 1 ELSE 0 END FROM p JOIN l ON l.doc_id = p.doc_id AND l.ord = p.ord + 1)
SELECT doc_id, ord, t, part FROM p""",
)



def balanced(spark, d):
    """Every block with the file that it stands in, and every file, where sections are merged and texts cut into parts."""
    folded = saved(S.fold_sections(atlas.blocks(spark, d)))
    _, places = S.balanced(folded, MIN, PARTS)
    return places.select("doc_id", "ord", (F.col("section") / S.SCALE).cast("long").alias("section"), F.pmod("section", F.lit(S.SCALE)).cast("long").alias("part"))


#: With it, a region's merged sections are more than one part.
PARTS = 60

register(
    "core_balanced_parts",
    balanced,
    f"""WITH RECURSIVE {atlas.SECTIONS}, small3 AS (SELECT * FROM sections WHERE level = 3 AND body_tokens < {MIN} AND body_tokens <= {PARTS}),
g2 AS (SELECT s.*, s.body_tokens + coalesce((SELECT sum(k.body_tokens + octet_length(encode(k.title)) // 4 + 1) FROM small3 k WHERE k.doc_id = s.doc_id AND k.parent = s.section), 0) AS t,
       (SELECT count(*) FROM sections k WHERE k.doc_id = s.doc_id AND k.parent = s.section) - (SELECT count(*) FROM small3 k WHERE k.doc_id = s.doc_id AND k.parent = s.section) AS kids FROM sections s WHERE level = 2),
small2 AS (SELECT * FROM g2 WHERE kids = 0 AND t <= {PARTS} AND t < {MIN}),
f AS (SELECT *, octet_length(encode(text)) // 4 + 1 AS tok FROM folded),
b AS (SELECT f.doc_id, f.ord, f.tok, CASE WHEN k.section IS NULL THEN coalesce(CASE WHEN m0.section IS NULL THEN f.section ELSE m0.parent END, 0) WHEN m.section IS NULL THEN k.parent ELSE m.parent END AS node, f.kind = 'heading' AND k.section IS NULL AND m0.section IS NULL AS own
      FROM f LEFT JOIN small3 k ON k.doc_id = f.doc_id AND k.section = f.section LEFT JOIN small2 m ON m.doc_id = f.doc_id AND m.section = k.parent LEFT JOIN small2 m0 ON m0.doc_id = f.doc_id AND m0.section = f.section),
x AS (SELECT doc_id, ord, node, tok, row_number() OVER (PARTITION BY doc_id, node ORDER BY ord) AS r, sum(tok) OVER (PARTITION BY doc_id, node) AS total FROM b WHERE NOT own),
p AS (SELECT doc_id, node, r, ord, tok AS c, 1::BIGINT AS part FROM x WHERE r = 1 AND total > {PARTS}
  UNION ALL SELECT x.doc_id, x.node, x.r, x.ord, CASE WHEN p.c + x.tok > {PARTS} THEN x.tok ELSE p.c + x.tok END, p.part + CASE WHEN p.c + x.tok > {PARTS} THEN 1 ELSE 0 END FROM p JOIN x ON x.doc_id = p.doc_id AND x.node = p.node AND x.r = p.r + 1)
SELECT x.doc_id, x.ord, x.node AS section, coalesce(p.part, 0) AS part FROM x LEFT JOIN p USING (doc_id, node, ord)""",
)

register("core_assign_paths", lambda s, d: _crumbs(_files(s, d)).select("doc_id", "section", "path", F.col("ordinal").cast("long"), "ordinal_path", "breadcrumb"), f"{atlas.FILES} SELECT doc_id, section, path, ordinal, array_to_string(ordinal_path, '.') AS ordinal_path, array_to_string(breadcrumb, ' > ') AS breadcrumb FROM tree")


def anchor_dedup(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.concat("event_type", F.lit("?")).alias("text"))
    return S.anchors(e, ["user_id"], "event_id").select("user_id", "event_id", "anchor")


register("core_anchor_numbers", anchor_dedup, "SELECT user_id, event_id, a || CASE WHEN n = 0 THEN '' ELSE '-' || n END AS anchor FROM (SELECT user_id, event_id, a, row_number() OVER (PARTITION BY user_id, a ORDER BY event_id) - 1 AS n FROM (SELECT *, regexp_replace(replace(lower(event_type), ' ', '-'), '[^a-z0-9_-]', '', 'g') AS a FROM events))")


def resolve_refs(spark, d):
    tree = _files(spark, d)
    files = tree.where("level = 3").select("doc_id", F.regexp_extract("title", "([0-9]+)$", 1).cast("long").alias("target"), F.col("path").alias("to_path"), S.anchor_slug("title").alias("anchor"))
    at = tree.where("level = 2").select("doc_id", "title", "path")
    c, n, o = (table(spark, d, t) for t in ("customer", "nation", "orders"))
    links = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").cast("long").alias("doc_id"), F.col("o_orderkey").alias("ord"), F.col("n_name").alias("title"), F.when(F.col("o_orderkey") % 7 == 0, -F.col("o_custkey")).otherwise(F.col("o_custkey")).alias("target"), F.col("c_name").alias("text")).join(at, ["doc_id", "title"]).drop("title")
    return S.resolve_refs(links, files).select("ord", "path", "text", "href")


register(
    "core_resolve_refs",
    resolve_refs,
    f"""{atlas.FILES}, a AS (SELECT doc_id, regexp_extract(title, '([0-9]+)$', 1)::BIGINT AS target, path AS to_path, regexp_replace(replace(lower(title), ' ', '-'), '[^a-z0-9_-]', '', 'g') AS anchor FROM tree WHERE level = 3),
l AS (SELECT n_regionkey AS doc_id, o_orderkey AS ord, CASE WHEN o_orderkey % 7 = 0 THEN -o_custkey ELSE o_custkey END AS target, c_name AS text, t.path FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN tree t ON t.doc_id = n_regionkey AND t.level = 2 AND t.title = n_name)
SELECT ord, path, text, CASE WHEN to_path IS NOT NULL THEN {atlas.relative_sql("path", "to_path")} || '#' || anchor END AS href FROM l LEFT JOIN a USING (doc_id, target)""",
)


def relativize(spark, d):
    """Every file with itself, its parent, its children, the files before and after it, and its region's: a number of pairs in proportion to the files."""
    f = _files(spark, d).select("doc_id", "section", "parent", "level", "path", "ordinal_path")
    near = S.reading_order(f).withColumn("target", F.explode(F.array("path", "before", "after"))).where("target IS NOT NULL").select("doc_id", F.col("path").alias("source"), "target")
    up = f.select("doc_id", F.col("parent").alias("section"), F.col("path").alias("source")).join(f.select("doc_id", "section", F.col("path").alias("target")), ["doc_id", "section"]).drop("section")
    down = up.select("doc_id", F.col("target").alias("source"), F.col("source").alias("target"))
    region = f.select("doc_id", F.col("path").alias("source")).join(f.where("level = 1").select("doc_id", F.col("path").alias("target")), "doc_id")
    return near.unionByName(up).unionByName(down).unionByName(region).distinct().withColumn("link", S.relativize("source", "target"))


register(
    "core_relativize",
    relativize,
    f"""{atlas.FILES}, n AS (SELECT doc_id, path, lag(path) OVER w AS p, lead(path) OVER w AS x FROM tree WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal_path)),
up AS (SELECT k.doc_id, k.path AS a, u.path AS b FROM tree k JOIN tree u ON u.doc_id = k.doc_id AND u.section = k.parent),
e AS (SELECT doc_id, path AS a, path AS b FROM tree UNION SELECT doc_id, path, p FROM n WHERE p IS NOT NULL UNION SELECT doc_id, path, x FROM n WHERE x IS NOT NULL UNION SELECT * FROM up UNION SELECT doc_id, b, a FROM up
 UNION SELECT t.doc_id, t.path, r.path FROM tree t JOIN tree r ON r.doc_id = t.doc_id AND r.level = 1)
SELECT doc_id, a AS source, b AS target, {atlas.relative_sql('a', 'b')} AS link FROM e""",
)

_NAV = f"""{atlas.SITE}, n AS (SELECT *, row_number() OVER w AS reading, lag(path) OVER w AS p, lead(path) OVER w AS x FROM site WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal_path)),
nav AS (SELECT n.*, CASE WHEN p IS NOT NULL THEN {atlas.relative_sql("n.path", "p")} END AS prev, CASE WHEN x IS NOT NULL THEN {atlas.relative_sql("n.path", "x")} END AS next, CASE WHEN n.parent IS NOT NULL THEN {atlas.relative_sql("n.path", "coalesce(u.path, 'index.md')")} END AS parent_link, coalesce(k.c, []) AS children
  FROM n LEFT JOIN (SELECT doc_id, section, path FROM site) u ON u.doc_id = n.doc_id AND u.section = n.parent LEFT JOIN (SELECT doc_id, parent AS section, list(path ORDER BY ordinal) AS c FROM site WHERE parent IS NOT NULL GROUP BY ALL) k ON k.doc_id = n.doc_id AND k.section = n.section)"""
register("core_navigation", lambda s, d: S.navigation(_site(s, d)).select("doc_id", "path", F.col("reading").cast("long"), "prev", "next", "parent_link", F.array_join("children", ",").alias("children")), f"{_NAV} SELECT doc_id, path, reading, prev, next, parent_link, array_to_string(children, ',') AS children FROM nav")
register("core_contents", lambda s, d: S.contents(_site(s, d)), f"{atlas.SITE} SELECT k.doc_id, k.parent AS section, string_agg('- [' || {_LABEL.format('k.title')} || '](' || {atlas.relative_sql('p.path', 'k.path')} || ')', chr(10) ORDER BY k.ordinal) AS toc FROM site k JOIN site p ON p.doc_id = k.doc_id AND p.section = k.parent GROUP BY ALL")
register(
    "wrt_frontmatter",
    lambda s, d: S.frontmatter(S.navigation(_site(s, d))).select("doc_id", "path", "yaml"),
    f"""{_NAV} SELECT doc_id, path, '---' || chr(10) || 'title: "' || title || '"' || chr(10) || 'breadcrumb: "' || array_to_string(breadcrumb, ' > ') || '"' || chr(10) || coalesce('parent: "' || parent_link || '"' || chr(10), '') || coalesce('prev: "' || prev || '"' || chr(10), '') || coalesce('next: "' || next || '"' || chr(10), '')
 || CASE WHEN len(children) > 0 THEN 'children:' || chr(10) || array_to_string(list_transform(children, lambda c: '  - "' || c || '"' || chr(10)), '') ELSE '' END || '---' || chr(10) AS yaml FROM nav""",
)


def site(spark, d):
    """The flagship: every file of every document with its place, its links and its text."""
    from ..functions.text import escape_flow, title_line

    folded = saved(S.fold_sections(atlas.blocks(spark, d)))
    tree = saved(S.assign_paths(S.sections(folded), ascii_titles=True))
    files = S.frontmatter(S.navigation(S.toc(S.rooted(tree, atlas.documents(spark, d)))))
    body = folded.where("kind <> 'heading'").groupBy("doc_id", "section").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", escape_flow("text").alias("t")))), lambda x: x["t"]), "\n\n").alias("body"))
    x = files.join(body, ["doc_id", "section"], "left")
    text = F.concat("yaml", F.lit("\n"), title_line("title", F.size("breadcrumb")), F.lit("\n\n"), F.coalesce(F.concat("toc", F.lit("\n\n")), F.lit("")), F.coalesce(F.concat("body", F.lit("\n")), F.lit("")))
    return x.select("doc_id", "path", text.alias("markdown"))


register(
    "site_files",
    site,
    f"""{_NAV}, y AS (SELECT doc_id, section, title, level, path, len(breadcrumb) AS depth, '---' || chr(10) || 'title: "' || title || '"' || chr(10) || 'breadcrumb: "' || array_to_string(breadcrumb, ' > ') || '"' || chr(10) || coalesce('parent: "' || parent_link || '"' || chr(10), '') || coalesce('prev: "' || prev || '"' || chr(10), '') || coalesce('next: "' || next || '"' || chr(10), '')
 || CASE WHEN len(children) > 0 THEN 'children:' || chr(10) || array_to_string(list_transform(children, lambda c: '  - "' || c || '"' || chr(10)), '') ELSE '' END || '---' || chr(10) AS yaml FROM nav),
toc AS (SELECT k.doc_id, k.parent AS section, string_agg('- [' || {_LABEL.format('k.title')} || '](' || {atlas.relative_sql('p.path', 'k.path')} || ')', chr(10) ORDER BY k.ordinal) AS toc FROM site k JOIN site p ON p.doc_id = k.doc_id AND p.section = k.parent GROUP BY ALL),
body AS (SELECT doc_id, section, string_agg(text, chr(10) || chr(10) ORDER BY ord) AS body FROM folded WHERE kind <> 'heading' GROUP BY ALL)
SELECT y.doc_id, y.path, yaml || chr(10) || repeat('#', depth::INTEGER) || ' ' || {_LABEL.format('title')} || chr(10) || chr(10) || coalesce(toc || chr(10) || chr(10), '') || coalesce(body || chr(10), '') AS markdown FROM y LEFT JOIN toc USING (doc_id, section) LEFT JOIN body USING (doc_id, section)""",
)
