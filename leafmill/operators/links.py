"""References between the parts of a container: spines, identifiers, links, footnotes and figures, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def spine(itemrefs: DataFrame, manifest: DataFrame) -> DataFrame:
    """(doc_id, seq, id, href): the reading order; references that the manifest lacks are skipped."""
    return itemrefs.join(manifest, ["doc_id", "id"]).select("doc_id", "seq", "id", "href")


def relationship_targets(rels: DataFrame, base: str = "base") -> DataFrame:
    """``rels`` (doc_id, base, id, target, external) with ``path``: an external target as it is, another resolved inside the archive; those that leave it, and rows without id, go."""
    from ..functions.guards import resolve_rel

    return rels.where("id <> ''").withColumn("path", F.when(F.col("external"), F.col("target")).otherwise(resolve_rel(base, "target"))).where("path IS NOT NULL")


def nearest_headings(elements: DataFrame) -> DataFrame:
    """``elements`` (doc_id, file, pos, frag, heading_id) with ``anchor_heading``: for each identifier its own heading, or the nearest before it in the file, or the file's first."""
    w = Window.partitionBy("doc_id", "file").orderBy("pos")
    before = F.last("heading_id", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("heading_id", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return elements.withColumn("anchor_heading", F.coalesce(before, after)).where("frag IS NOT NULL")


def fix_links(links: DataFrame, anchors: DataFrame, first_headings: DataFrame) -> DataFrame:
    """``links`` (doc_id, pos, file, frag, href) with ``block``: the heading of the exact fragment, else the file's first; null for an outside address or none."""
    a = anchors.select("doc_id", "file", "frag", F.col("anchor_heading").alias("exact")).dropDuplicates(["doc_id", "file", "frag"])
    f = first_headings.select("doc_id", "file", F.col("heading_id").alias("any"))
    inside = ~F.col("href").rlike("^[^/#?]*:") & (F.col("href") != "")
    return links.join(a, ["doc_id", "file", "frag"], "left").join(f, ["doc_id", "file"], "left").withColumn("block", F.when(inside, F.coalesce("exact", "any"))).drop("exact", "any")


def relocate_footnotes(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """``nodes`` (doc_id, ord, note_id) with ``place`` from 1: a footnote stands directly after the node with its first reference of ``refs`` (doc_id, ord, seq, note_id), notes of one node in the
    order of their references; others stay."""
    first = refs.groupBy("doc_id", "note_id").agg(F.min(F.struct("ord", "seq")).alias("r"))
    x = nodes.join(first, ["doc_id", "note_id"], "left")
    w = Window.partitionBy("doc_id").orderBy(F.coalesce("r.ord", "ord"), F.when(F.col("r").isNull(), 0).otherwise(1), F.coalesce("r.seq", F.lit(0)), "ord")
    return x.withColumn("place", F.row_number().over(w)).drop("r")


def distinct_note_refs(refs: DataFrame) -> DataFrame:
    """The first of each node's references to a note, numbered in order."""
    first = refs.groupBy("doc_id", "ord", "note_id").agg(F.min("seq").alias("seq"))
    return first.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "ord").orderBy("seq")))


def figure_assets(figures: DataFrame) -> DataFrame:
    """(doc_id, key, n): the distinct figures of each document in the order of their first occurrence, from 0."""
    first = figures.groupBy("doc_id", "key").agg(F.min("ord").alias("ord"))
    return first.select("doc_id", "key", (F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1).alias("n"))


def degrade_figures(figures: DataFrame, assets: DataFrame) -> DataFrame:
    """``figures`` (doc_id, ord, key, caption) with ``kind`` and ``text``: one whose bytes aren't among ``assets`` (doc_id, key) becomes its caption, or a note if it has none."""
    x = figures.join(assets.select("doc_id", "key", F.lit(True).alias("there")).distinct(), ["doc_id", "key"], "left")
    return x.withColumn("kind", F.when(F.col("there"), "figure").when(F.trim("caption") != "", "para").otherwise("raw")).withColumn("text", F.when(F.col("there") | (F.trim("caption") != ""), F.col("caption")).otherwise(F.concat(F.lit("image unavailable: "), "key"))).drop("there")


def slide_titles(slides: DataFrame) -> DataFrame:
    """``slides`` (doc_id, seq, title) with ``heading``: the title, or the slide's number; null titles mean an unreadable slide and get a note."""
    return slides.withColumn("heading", F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.concat(F.lit("Slide "), F.col("seq").cast("string")))).withColumn("note", F.when(F.col("title").isNull(), F.lit("unparsable slide")))


def nest_items(paragraphs: DataFrame) -> DataFrame:
    """``paragraphs`` (doc_id, ord, level) with ``parent``: the last one before of a lower level, 0 for none."""
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.when(F.col("level") > k, F.max(F.when(F.col("level") == k, F.col("ord"))).over(w)) for k in range(32)]
    return paragraphs.withColumn("parent", F.greatest(F.lit(0), *last))
