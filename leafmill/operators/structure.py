"""A flat stream of blocks becomes a tree of files.

``blocks`` is (doc_id, ord, kind, level, text, page_from, page_to): ``ord`` orders a document's blocks from 1, headings have kind ``heading`` and a
level from 1 to 6. Hierarchy is implied by the levels; every step here is a window, a grouping or an equi-join on (doc_id, ...). What spans a whole document, its folding and
its reading order, is done in spans or ranges of it, so that a document of any size has many tasks. Nothing is collected.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import anchor_slug, ascii_path_slug, label, numbered, path_slug, yaml_scalar
from ..storage import saved

LEVELS = range(1, 7)
MAX_TOKENS, MIN_TOKENS = 2000, 200


#: How many numbers of a document's blocks a window spans; what the spans before it leave is joined.
SPAN = 1 << 16


def span(order: str) -> Column:
    return F.floor(F.col(order) / SPAN)


def fold_sections(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``section`` (the ord of the heading that each block stands under; a heading's own; 0 before any) and ``parent`` (for a heading, that of the
    nearest one before it with a lower level; 0 for none) and ``parent_level``. A document is folded in spans of its numbers; the last headings of each go to those after it. ``blocks`` is
    read twice."""
    heading = F.col("kind") == "heading"
    own = blocks.withColumn("_span", span("ord"))
    place = Window.partitionBy("doc_id", "_span").orderBy("ord")
    before, upto = place.rowsBetween(Window.unboundedPreceding, -1), place.rowsBetween(Window.unboundedPreceding, 0)
    last = {f"_last{k}": F.max(F.when(heading & (F.col("level") == k), F.col("ord"))) for k in LEVELS}
    any_ = F.max(F.when(heading, F.col("ord")))
    inside = own.select("*", any_.over(upto).alias("section"), *(x.over(before).alias(c) for c, x in last.items()))
    earlier = Window.partitionBy("doc_id").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    ends = own.groupBy("doc_id", "_span").agg(any_.alias("section"), *(x.alias(c) for c, x in last.items()))
    ends = ends.select("doc_id", "_span", *(F.max(c).over(earlier).alias(f"_before_{c}") for c in ("section", *last)))
    folded = inside.join(ends, ["doc_id", "_span"], "left").withColumns({c: F.greatest(c, f"_before_{c}") for c in ("section", *last)}).withColumn("section", F.coalesce("section", F.lit(0)))
    parent = F.greatest(F.lit(0), *(F.when(F.col("level") > k, F.col(f"_last{k}")) for k in LEVELS))
    folded = folded.withColumn("parent", F.when(heading, parent))
    level = F.coalesce(*(F.when((F.col("parent") > 0) & (F.col(f"_last{k}") == F.col("parent")), F.lit(k)) for k in LEVELS))
    return folded.withColumn("parent_level", level).select(*blocks.columns, "section", "parent", "parent_level")


def section_pages(folded: DataFrame) -> DataFrame:
    """(doc_id, section, page_from, page_to): the pages of each section's own blocks; headings don't count."""
    return folded.where("kind <> 'heading'").groupBy("doc_id", "section").agg(F.min("page_from").alias("page_from"), F.max("page_to").alias("page_to"))


def tokens(kind: Column | str = "kind", text: Column | str = "text") -> Column:
    """The estimated tokens of a block: a quarter of its bytes, with what its kind adds, and one."""
    kind, text = (F.col(x) if isinstance(x, str) else x for x in (kind, text))
    extra = F.when(kind == "table", F.lit(20)).when(kind == "figure", F.lit(16)).otherwise(F.lit(0))
    return (F.floor((F.octet_length(F.coalesce(text, F.lit(""))) + extra) / 4) + 1).cast("long")


def sections(folded: DataFrame) -> DataFrame:
    """(doc_id, section, parent, parent_level, level, title, body_tokens) of every heading."""
    heads = folded.where("kind = 'heading'").select("doc_id", F.col("ord").alias("section"), "parent", "parent_level", "level", F.col("text").alias("title"))
    body = folded.where("kind <> 'heading'").groupBy("doc_id", "section").agg(F.sum(tokens()).alias("body_tokens"))
    return heads.join(body, ["doc_id", "section"], "left").withColumn("body_tokens", F.coalesce("body_tokens", F.lit(0)))


def merge_small(tree: DataFrame, min_tokens: int = MIN_TOKENS, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``sections`` with ``into``: the section whose file holds each one's blocks, itself or, if it has no child left and less than ``min_tokens``, its parent's, from
    the deepest level up; a section at the root stays. A merged heading counts in its new section's ``body_tokens``; a section over ``max_tokens`` will
    be split and so is no longer childless. One window a level and direction, all over one partitioning by document."""
    x = tree.repartition("doc_id")
    x = x.withColumn("alive", F.lit(True)).withColumn("children", F.lit(0).cast("long"))
    family = lambda level: Window.partitionBy("doc_id", F.when(F.col("parent_level") == level, F.col("parent")).otherwise(F.col("section")))
    for level in reversed(LEVELS):  # parents of this level take their small children
        kid = F.col("parent_level") == level
        small = kid & (F.col("children") == 0) & (F.col("body_tokens") < min_tokens)
        x = x.withColumn("small", F.coalesce(small, F.lit(False))).withColumn("kid", F.coalesce(kid, F.lit(False)))
        w = family(level)
        gain = F.sum(F.when(F.col("small"), F.col("body_tokens") + tokens(F.lit("heading"), F.col("title"))).otherwise(0)).over(w)
        left = F.sum((F.col("kid") & ~F.col("small")).cast("long")).over(w)
        x = x.withColumn("gain", gain).withColumn("left", left)
        here = F.col("level") == level
        total = F.when(here & ~F.col("kid"), F.col("body_tokens") + F.col("gain")).otherwise(F.col("body_tokens"))
        x = x.withColumn("body_tokens", total).withColumn("alive", F.col("alive") & ~F.col("small"))
        x = x.withColumn("children", F.when(here & ~F.col("kid"), F.col("left") + (F.col("body_tokens") > max_tokens).cast("long")).otherwise(F.col("children")))
    x = x.withColumn("into", F.col("section"))
    for level in LEVELS:  # and hand their own place down to them
        kid = F.coalesce(F.col("parent_level") == level, F.lit(False))
        up = F.max(F.when(~kid & (F.col("level") == level), F.col("into"))).over(family(level))
        x = x.withColumn("up", up).withColumn("into", F.when(kid & ~F.col("alive"), F.col("up")).otherwise(F.col("into")))
    return x.select("doc_id", "section", "parent", "parent_level", "level", "title", "body_tokens", "into", "alive")


def _parts(weights: pd.Series, most: pd.Series) -> pd.Series:
    def fold(w, limit: int) -> list[int]:
        part, held, out = 1, 0, []
        for k, x in enumerate(w.tolist()):
            if k and held and held + x > limit:
                part, held = part + 1, 0
            held += x
            out.append(part)
        return out

    return pd.Series([fold(w, m) for w, m in zip(weights, most)])


def split_parts(items: DataFrame, keys: list[str], order: str, weight: str, most: int = MAX_TOKENS) -> DataFrame:
    """``items`` with ``part`` from 1: within each group of ``keys``, in ``order``, a new part starts where the current one isn't empty and would exceed ``most``. A group's weights are
    folded in one pass, as an array; nothing else of it travels."""
    packed = items.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(weight).cast("long").alias("w")))).alias("s"))
    numbered_ = packed.select(*keys, F.col("s.o").alias("o"), F.pandas_udf(_parts, "array<int>")(F.col("s.w"), F.lit(most)).alias("part"))
    parts = numbered_.select(*keys, F.explode(F.arrays_zip("o", "part")).alias("z")).select(*keys, F.col("z.o").alias(order), F.col("z.part").alias("part"))
    return items.join(parts, [*keys, order])


#: A section's number among those of a document's files: the ord of its heading, and below it the number of a part of its text. A long: from an ord of 2048 it is beyond an int.
SCALE = 1 << 20


def scaled(section: str) -> Column:
    return F.col(section).cast("long") * SCALE


def balanced(folded: DataFrame, min_tokens: int = MIN_TOKENS, max_tokens: int = MAX_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(tree, places) of ``fold_sections``: small sections merged into their parents, and what is over ``max_tokens`` of a section's own text, also of that before the first heading, cut into
    children of its own, ``Part 1`` and on, that stand before its others. ``tree`` is (doc_id, section, parent, parent_level, level, title, heading) for ``assign_paths``, ``heading`` the ord of
    a section's heading; ``places`` is (doc_id, ord, section), the section in whose file each block stands, but for the headings that are titles."""
    merged = saved(merge_small(sections(folded), min_tokens, max_tokens))
    weighed = folded.select("doc_id", "ord", "section", "kind", tokens().alias("tokens")).join(merged.select("doc_id", "section", "into"), ["doc_id", "section"], "left")
    weighed = weighed.withColumn("node", F.coalesce("into", F.lit(0))).where(~((F.col("kind") == "heading") & (F.coalesce("into", F.lit(-1)) == F.col("ord"))))
    weighed = weighed.select("doc_id", "node", "ord", "tokens", F.sum("tokens").over(Window.partitionBy("doc_id", "node")).alias("all"))
    cut = split_parts(weighed.where(F.col("all") > max_tokens).select("doc_id", "node", "ord", "tokens"), ["doc_id", "node"], "ord", "tokens", max_tokens)
    whole = weighed.where(F.col("all") <= max_tokens).withColumn("part", F.lit(0))
    placed = saved(whole.select("doc_id", "node", "ord", "part").unionByName(cut.select("doc_id", "node", "ord", "part")))
    alive = merged.where("alive").select("doc_id", scaled("section").alias("section"), scaled("parent").alias("parent"), "parent_level", "level", "title", F.col("section").alias("heading"))
    parts = placed.where("part > 0").select("doc_id", "node", "part").distinct().join(merged.select("doc_id", F.col("section").alias("node"), F.col("level").alias("up")), ["doc_id", "node"], "left")
    made = parts.select("doc_id", (scaled("node") + F.col("part")).alias("section"), scaled("node").alias("parent"), F.col("up").alias("parent_level"), (F.coalesce("up", F.lit(0)) + 1).alias("level"), F.concat(F.lit("Part "), F.col("part").cast("string")).alias("title"), F.lit(None).cast(merged.schema["section"].dataType).alias("heading"))
    return alive.unionByName(made), placed.select("doc_id", "ord", (scaled("node") + F.col("part")).alias("section"))


def assign_paths(tree: DataFrame, ascii_titles: bool = False) -> DataFrame:
    """``sections`` with ``ordinal`` among its siblings, ``ordinal_path``, ``path``, ``breadcrumb`` and ``parent_path``: children of a section live in its folder, which a section with children
    has, ``NN-slug/index.md``; others are ``NN-slug.md``. Only sections with children hand their place down, level by level, by windows over families, in which nothing but places travels."""
    slug = (ascii_path_slug if ascii_titles else path_slug)("title")
    has = tree.where("parent > 0").select("doc_id", F.col("parent").alias("section"), F.lit(True).alias("has")).distinct()
    x = tree.join(has, ["doc_id", "section"], "left").withColumn("ordinal", F.row_number().over(Window.partitionBy("doc_id", "parent").orderBy("section")))
    x = x.withColumn("name", F.concat(F.when(F.col("ordinal") < 10, F.lit("0")).otherwise(F.lit("")), F.col("ordinal").cast("string"), F.lit("-"), slug))
    x = saved(x.select("doc_id", "section", "parent", "parent_level", "level", "title", "ordinal", "name", "has"))
    root = F.struct(F.concat("name", F.lit("/")).alias("dir"), F.array("ordinal").alias("ordinal_path"), F.array("title").alias("breadcrumb"))
    below = F.struct(F.concat("up.dir", "name", F.lit("/")).alias("dir"), F.concat("up.ordinal_path", F.array("ordinal")).alias("ordinal_path"), F.concat("up.breadcrumb", F.array("title")).alias("breadcrumb"))
    folders = x.where("has").withColumn("at", F.when(F.col("parent") == 0, root))
    for level in LEVELS:  # folders of this level hand their place down
        kid = F.coalesce(F.col("parent_level") == level, F.lit(False))
        family = Window.partitionBy("doc_id", F.when(kid, F.col("parent")).otherwise(F.col("section")))
        folders = folders.withColumn("up", F.first(F.when(~kid, F.col("at")), ignorenulls=True).over(family)).withColumn("at", F.when(kid, below).otherwise(F.col("at")))
    x = x.join(folders.select("doc_id", F.col("section").alias("parent"), F.col("at").alias("up")), ["doc_id", "parent"], "left")
    x = x.withColumn("at", F.when(F.col("parent") == 0, root).otherwise(below)).withColumn("up_dir", F.coalesce("up.dir", F.lit("")))
    file = F.concat("up_dir", "name", F.when(F.col("has"), F.lit("/index.md")).otherwise(F.lit(".md")))
    return x.select("doc_id", "section", "parent", "level", "title", "ordinal", "at.ordinal_path", "at.breadcrumb", file.alias("path"), F.concat("up_dir", F.lit("index.md")).alias("parent_path"))


def rooted(files: DataFrame, documents: DataFrame) -> DataFrame:
    """``assign_paths`` with the file of each of ``documents`` (doc_id, title) itself, ``index.md``, as section 0: it is the first in reading order and the parent of the top sections, and
    every breadcrumb begins with the document's title."""
    named = documents.select("doc_id", F.coalesce("title", F.lit("")).alias("document"))
    kind = {f.name: f.dataType for f in files.schema}
    none = lambda c: F.lit(None).cast(kind[c])
    root = named.select(
        "doc_id", F.lit(0).cast(kind["section"]).alias("section"), none("parent").alias("parent"), F.lit(0).cast(kind["level"]).alias("level"), F.col("document").alias("title"), F.lit(0).cast(kind["ordinal"]).alias("ordinal"), F.array().cast(kind["ordinal_path"]).alias("ordinal_path"),
        F.array("document").alias("breadcrumb"), F.lit("index.md").alias("path"), none("parent_path").alias("parent_path"),
    )
    below = files.join(named, "doc_id").withColumn("breadcrumb", F.concat(F.array("document"), "breadcrumb")).drop("document")
    return below.select(*files.columns).unionByName(root)


def anchors(headings: DataFrame, file: list[str], order: str, title: str = "text") -> DataFrame:
    """``headings`` with ``anchor``: the n-th of one base in a file, in order, is numbered n - 1; what others are called isn't looked at."""
    base = anchor_slug(title)
    n = F.row_number().over(Window.partitionBy(*file, "base").orderBy(order)) - 1
    return headings.withColumn("base", base).withColumn("anchor", numbered(F.col("base"), n)).drop("base")


def anchor_map(files: DataFrame, inner: DataFrame) -> DataFrame:
    """(doc_id, ord, to_path, anchor): where each heading can be linked to. A file's first anchor is that of its title, which stands for its section's heading; then come the headings that
    stand in it, in order. ``files`` is (doc_id, section, path, title, heading), ``heading`` null where no heading is behind the title; ``inner`` is (doc_id, section, ord, text)."""
    titles = files.select("doc_id", "path", F.lit(-1).cast("long").alias("at"), F.col("heading").cast("long").alias("ord"), "title")
    below = inner.join(files.select("doc_id", "section", "path"), ["doc_id", "section"]).select("doc_id", "path", F.col("ord").cast("long").alias("at"), F.col("ord").cast("long").alias("ord"), F.col("text").alias("title"))
    return anchors(titles.unionByName(below), ["doc_id", "path"], "at", "title").where("ord IS NOT NULL").select("doc_id", "ord", F.col("path").alias("to_path"), "anchor")


#: How deep blocks and inline text may nest.
BLOCK_DEPTH, INLINE_DEPTH = 128, 256


def bounded(blocks: DataFrame) -> DataFrame:
    """``blocks`` without what nests too deep: an item of ``BLOCK_DEPTH`` or more becomes a note, spans of ``INLINE_DEPTH`` or more go."""
    deep = F.coalesce(F.col("depth") >= BLOCK_DEPTH, F.lit(False))
    none = F.array().cast(blocks.schema["spans"].dataType)
    x = blocks.withColumn("spans", F.when(deep, none).otherwise(F.filter("spans", lambda s: s["depth"] < INLINE_DEPTH)))
    x = x.withColumn("text", F.when(deep, F.lit("nesting truncated at the block depth bound")).otherwise(F.col("text")))
    return x.withColumn("kind", F.when(deep, F.lit("raw")).otherwise(F.col("kind"))).withColumn("depth", F.when(deep, F.lit(None)).otherwise(F.col("depth")).cast("int"))


def relativize(source: Column | str, target: Column | str) -> Column:
    """The link from one file of a tree to another, or to an anchor in it."""
    source, target = (F.col(x) if isinstance(x, str) else x for x in (source, target))
    a, b = F.split(F.substring_index(source, "#", 1), "/"), F.split(F.regexp_extract(target, "^([^#]*)", 1), "/")
    folders = F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))
    limit = F.least(F.size(folders), F.size(b) - 1)
    same = F.aggregate(F.sequence(F.lit(0), F.greatest(limit - 1, F.lit(0))), F.struct(F.lit(0).alias("n"), (limit > 0).alias("go")), lambda acc, i: F.when(acc["go"] & (F.get(a, i) == F.get(b, i)), F.struct((acc["n"] + 1).alias("n"), F.lit(True).alias("go"))).otherwise(F.struct(acc["n"].alias("n"), F.lit(False).alias("go"))))["n"]
    rest = F.array_join(F.slice(b, same + 1, F.greatest(F.size(b) - same, F.lit(0))), "/")
    return F.concat(F.repeat(F.lit("../"), F.size(folders) - same), rest, F.regexp_extract(target, "(#.*)$", 1))


def resolve_refs(links: DataFrame, anchors_: DataFrame) -> DataFrame:
    """``links`` (doc_id, ord, path, target, text) with ``href``: relative to the anchor of the block that each names; null, so that only its text stays, where no block
    has that id. ``anchors_`` is (doc_id, target, to_path, anchor)."""
    return links.join(anchors_, ["doc_id", "target"], "left").withColumn("href", F.when(F.col("to_path").isNotNull(), relativize(F.col("path"), F.concat(F.col("to_path"), F.lit("#"), F.col("anchor"))))).drop("to_path", "anchor")


def reading_order(files: DataFrame) -> DataFrame:
    """``files`` with ``reading``, their place in reading order from 1, and ``before`` and ``after``, the paths of the files around them. The files are dealt out by ranges of that order, whatever
    document they are of; each range counts its own, and what the ranges around it hold of a document is joined."""
    dealt = saved(files.repartitionByRange("doc_id", "ordinal_path").withColumn("_range", F.spark_partition_id()))
    order = Window.partitionBy("doc_id", "_range").orderBy("ordinal_path")
    ranges = Window.partitionBy("doc_id").orderBy("_range")
    at = F.struct("ordinal_path", "path")
    edges = dealt.groupBy("doc_id", "_range").agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))
    edges = edges.select("doc_id", "_range", F.coalesce(F.sum("n").over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_less"), F.lag("last.path").over(ranges).alias("_before"), F.lead("first.path").over(ranges).alias("_after"))
    x = dealt.select("*", F.row_number().over(order).alias("_own"), F.lag("path").over(order).alias("before"), F.lead("path").over(order).alias("after")).join(edges, ["doc_id", "_range"])
    return x.select(*files.columns, (F.col("_less") + F.col("_own")).alias("reading"), F.coalesce("before", "_before").alias("before"), F.coalesce("after", "_after").alias("after"))


def _of_children(files: DataFrame, value: Column, name: str) -> DataFrame:
    """(doc_id, section, name): the values of each section's children, in order."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct("ordinal", value.alias("v")))), lambda k: k["v"])
    return files.where("parent IS NOT NULL").groupBy("doc_id", F.col("parent").alias("section")).agg(listed.alias(name))


def navigation(files: DataFrame) -> DataFrame:
    """``files`` with their place in reading order and the relative links to the file before and after, the parent's, and the children's paths from the tree's root. ``files`` is read twice."""
    x = reading_order(files).join(_of_children(files, F.col("path"), "children"), ["doc_id", "section"], "left").withColumn("children", F.coalesce("children", F.array().cast("array<string>")))
    return x.select(*files.columns, "reading", relativize("path", "before").alias("prev"), relativize("path", "after").alias("next"), relativize("path", "parent_path").alias("parent_link"), "children")


def contents(files: DataFrame) -> DataFrame:
    """(doc_id, section, toc): the list of links to the children that a file with children begins with; their titles are labels."""
    return toc(files).where("toc IS NOT NULL").select("doc_id", "section", "toc")


def toc(files: DataFrame) -> DataFrame:
    """``files`` with ``toc``, null for a file without children: each child makes its own line. ``files`` is read twice."""
    line = F.concat(F.lit("- ["), label("title"), F.lit("]("), relativize("parent_path", "path"), F.lit(")"))
    return files.join(_of_children(files, line, "toc").withColumn("toc", F.array_join("toc", "\n")), ["doc_id", "section"], "left")


def frontmatter(files: DataFrame) -> DataFrame:
    """``navigation`` with ``yaml``: the head of each file, absent values left out; with its pages if there are ``page_from`` and ``page_to``."""
    optional = lambda key, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(key + ": "), yaml_scalar(c), F.lit("\n"))).otherwise(F.lit(""))
    kids = F.when(F.size("children") > 0, F.concat(F.lit("children:\n"), F.array_join(F.transform("children", lambda c: F.concat(F.lit("  - "), yaml_scalar(c), F.lit("\n"))), ""))).otherwise(F.lit(""))
    pages = F.when(F.col("page_from").isNotNull(), F.format_string("source_pages: %d-%d\n", "page_from", "page_to")).otherwise(F.lit("")) if "page_from" in files.columns else F.lit("")
    text = F.concat(F.lit("---\n"), F.lit("title: "), yaml_scalar("title"), F.lit("\n"), F.lit("breadcrumb: "), yaml_scalar(F.array_join("breadcrumb", " > ")), F.lit("\n"), optional("parent", "parent_link"), optional("prev", "prev"), optional("next", "next"), kids, pages, F.lit("---\n"))
    return files.withColumn("yaml", text)
