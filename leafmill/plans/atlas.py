"""The driver's tables as documents: each region a document of nations (level 2) and customers (level 3), each customer with a paragraph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import table
from ..operators.structure import span

#: The same stream in SQL, as a common table expression.
SQL = """atlas AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n, c, k) AS ord, kind, level, text, page_from, page_to FROM (
  SELECT r_regionkey::BIGINT AS doc_id, -1::BIGINT AS n, -1::BIGINT AS c, 0 AS k, 'heading' AS kind, 1 AS level, r_name AS text, NULL::BIGINT AS page_from, NULL::BIGINT AS page_to FROM region
  UNION ALL SELECT n_regionkey, n_nationkey, -1, 0, 'heading', 2, n_name, NULL, NULL FROM nation
  UNION ALL SELECT n_regionkey, n_nationkey, c_custkey, 0, 'heading', 3, c_name, NULL, NULL FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT n_regionkey, n_nationkey, c_custkey, 1, 'para', NULL, c_name || ' buys for ' || lower(c_mktsegment) || repeat(' and more', (c_custkey % 40)::INTEGER) || '.', c_custkey % 97 + 1, c_custkey % 97 + 1 + c_custkey % 3 FROM customer JOIN nation ON c_nationkey = n_nationkey))"""

#: Folded: each block's section and each heading's parent, by the last heading of every level before it.
FOLDED = SQL + """, last AS (SELECT *, max(CASE WHEN kind = 'heading' AND level = 1 THEN ord END) OVER w AS l1, max(CASE WHEN kind = 'heading' AND level = 2 THEN ord END) OVER w AS l2, max(CASE WHEN kind = 'heading' THEN ord END) OVER (PARTITION BY doc_id ORDER BY ord) AS lh
  FROM atlas WINDOW w AS (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
folded AS (SELECT doc_id, ord, kind, level, text, page_from, page_to, coalesce(lh, 0) AS section, CASE WHEN kind = 'heading' THEN greatest(0, CASE WHEN level > 1 THEN coalesce(l1, 0) ELSE 0 END, CASE WHEN level > 2 THEN coalesce(l2, 0) ELSE 0 END) END AS parent FROM last)"""

SECTIONS = FOLDED + """, sections AS (SELECT h.doc_id, h.ord AS section, h.parent, h.level, h.text AS title, coalesce(b.t, 0)::BIGINT AS body_tokens FROM folded h
  LEFT JOIN (SELECT doc_id, section, sum(octet_length(encode(text)) // 4 + 1) AS t FROM folded WHERE kind <> 'heading' GROUP BY ALL) b ON b.doc_id = h.doc_id AND b.section = h.ord WHERE h.kind = 'heading')"""

#: Paths by recursion; titles are ASCII.
FILES = "WITH RECURSIVE " + SECTIONS + """, named AS (SELECT s.*, row_number() OVER (PARTITION BY doc_id, parent ORDER BY section) AS ordinal, EXISTS (SELECT 1 FROM sections k WHERE k.doc_id = s.doc_id AND k.parent = s.section) AS has FROM sections s),
slugged AS (SELECT *, printf('%02d', ordinal) || '-' || coalesce(nullif(rtrim(substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9_]+', '-', 'g'), '^-|-$', '', 'g'), 1, 64), '-'), ''), 'section') AS name FROM named),
tree AS (SELECT doc_id, section, parent, level, title, ordinal, [ordinal] AS ordinal_path, [title] AS breadcrumb, name || '/' AS dir, name || CASE WHEN has THEN '/index.md' ELSE '.md' END AS path FROM slugged WHERE parent = 0
  UNION ALL SELECT s.doc_id, s.section, s.parent, s.level, s.title, s.ordinal, list_append(t.ordinal_path, s.ordinal), list_append(t.breadcrumb, s.title), t.dir || s.name || '/', t.dir || s.name || CASE WHEN s.has THEN '/index.md' ELSE '.md' END FROM slugged s JOIN tree t ON s.doc_id = t.doc_id AND s.parent = t.section)"""



#: The same with each region's own file, and its title before every breadcrumb.
SITE = FILES + """, site AS (SELECT doc_id, section, parent, level, title, ordinal, ordinal_path, list_prepend('Atlas ' || doc_id, breadcrumb) AS breadcrumb, path FROM tree
  UNION ALL SELECT r_regionkey::BIGINT, 0, NULL, 0, 'Atlas ' || r_regionkey, 0, [], ['Atlas ' || r_regionkey], 'index.md' FROM region)"""


def relative_sql(source: str, target: str) -> str:
    """The SQL expression for ``structure.relativize`` of two paths without anchors."""
    a, b = f"string_split({source}, '/')", f"string_split({target}, '/')"
    same = f"len(list_filter(range(1, least(len({a}), len({b}))), lambda i: {a}[1:i] = {b}[1:i]))"
    return f"repeat('../', (len({a}) - 1 - {same})::INTEGER) || array_to_string({b}[({same} + 1):], '/')"


def blocks(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("long")
    region, nation, customer = (table(spark, d, n) for n in ("region", "nation", "customer"))
    owner = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))

    def part(df, doc, n, c, k, kind, level, text, first=none, last=none):
        return df.select(F.col(doc).cast("long").alias("doc_id"), n.cast("long").alias("n"), c.cast("long").alias("c"), F.lit(k).alias("k"), F.lit(kind).alias("kind"), F.lit(level).cast("int").alias("level"), text.alias("text"), first.alias("page_from"), last.alias("page_to"))

    key = F.col("c_custkey")
    story = F.concat("c_name", F.lit(" buys for "), F.lower("c_mktsegment"), F.repeat(F.lit(" and more"), (key % 40).cast("int")), F.lit("."))
    x = (
        part(region, "r_regionkey", F.lit(-1), F.lit(-1), 0, "heading", 1, F.col("r_name"))
        .unionByName(part(nation, "n_regionkey", F.col("n_nationkey"), F.lit(-1), 0, "heading", 2, F.col("n_name")))
        .unionByName(part(owner, "n_regionkey", F.col("n_nationkey"), key, 0, "heading", 3, F.col("c_name")))
        .unionByName(part(owner, "n_regionkey", F.col("n_nationkey"), key, 1, "para", None, story, key % 97 + 1, key % 97 + 1 + key % 3))
    )
    # numbered in spans of a nation's customers, after what the spans before hold
    x = x.withColumn("_span", span("c"))
    held = x.groupBy("doc_id", "n", "_span").agg(F.count("*").alias("held"))
    held = held.select("doc_id", "n", "_span", F.coalesce(F.sum("held").over(Window.partitionBy("doc_id").orderBy("n", "_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("less"))
    own = F.row_number().over(Window.partitionBy("doc_id", "n", "_span").orderBy("c", "k"))
    return x.withColumn("own", own).join(held, ["doc_id", "n", "_span"]).withColumn("ord", (F.col("less") + F.col("own")).cast("long")).drop("n", "c", "k", "_span", "own", "less")


def documents(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, title)."""
    return table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("doc_id"), F.concat(F.lit("Atlas "), F.col("r_regionkey").cast("string")).alias("title"))
