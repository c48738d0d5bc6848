"""A folder of files becomes a folder of Markdown trees: read, parse, structure, write, and the page that lists them."""

from __future__ import annotations

import os
import shutil
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.inline import heading_markdown, inline_markdown
from ..functions.text import code_block, comment_note, dest_path, footnote_body, gfm_table, html_table, label, math_block, title_line
from ..sources import containers as C
from ..storage import saved
from . import batch, structure


def rendered(blocks: DataFrame) -> DataFrame:
    """``blocks`` of ``containers.block_rows`` with ``markdown``: each kind in its form; an item without its mark."""
    line = inline_markdown("spans")
    caption = F.when(F.trim("caption") != "", F.col("caption")).otherwise(F.coalesce("text", F.lit("")))
    figure = F.concat(F.lit("!["), label(caption), F.lit("](_assets/"), F.coalesce(dest_path("asset"), F.lit("missing")), F.lit(")"))
    table = F.when(F.col("has_merged"), html_table(F.col("rows"))).otherwise(gfm_table(F.get("rows", F.lit(0)), F.slice("rows", F.lit(2), F.greatest(F.size("rows") - 1, F.lit(0)))))
    body = (
        F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), heading_markdown("spans"))).when(F.col("kind") == "code", code_block("text", F.coalesce("lang", F.lit("")))).when(F.col("kind") == "math", math_block("text"))
        .when(F.col("kind") == "figure", figure).when(F.col("kind") == "table", table).when(F.col("kind") == "raw", comment_note("text")).otherwise(line)
    )
    return blocks.withColumn("markdown", F.when(F.col("note").isNotNull(), F.concat(F.lit("[^"), "note", F.lit("]: "), footnote_body(line))).otherwise(F.rtrim(body)))


def list_markdown(items: list[tuple[int | None, bool, str]]) -> str:
    """Items (depth, ordered, text) that follow each other: each under the mark of the nearest one before that is less deep, ordered ones counted within their list, further lines
    indented by their mark's width."""
    out: list[str] = []
    open_: list[list] = []  # of each depth: ordered, how many so far, width of the last mark
    for depth, ordered, text in items:
        depth = min(max(int(depth or 0), 0), len(open_))
        del open_[depth + 1 :]
        if depth == len(open_) or open_[depth][0] != ordered:
            open_[depth:] = [[ordered, 0, 0]]
        own = open_[depth]
        own[1] += 1
        mark = f"{own[1]}. " if ordered else "- "
        own[2] = len(mark)
        indent = " " * sum(x[2] for x in open_[:depth])
        first, *rest = (text or "").rstrip().split("\n")
        out += [indent + mark + first, *(indent + " " * own[2] + x if x.strip() else x for x in rest)]
    return "\n".join(out)


def body_markdown(blocks) -> str:
    """A file's blocks (ord, kind, depth, ordered, markdown), in order, a blank line between them; items that follow each other are one list."""
    out, items = [], []
    for b in [*blocks, None]:
        if b is not None and b["kind"] == "item":
            if items and not b["depth"] and bool(b["ordered"]) != items[0][1]:  # another list
                out.append(list_markdown(items))
                items = []
            items.append((b["depth"], bool(b["ordered"]), b["markdown"]))
            continue
        if items:
            out.append(list_markdown(items))
            items = []
        if b is not None:
            out.append(b["markdown"] or "")
    return "\n\n".join(out)


def _bodies(files: pd.Series) -> pd.Series:
    return files.map(lambda blocks: body_markdown([{k: None if v != v else v for k, v in b.items()} for b in blocks]))


def resolved(body: DataFrame, tree: DataFrame, files: DataFrame, headings: DataFrame) -> DataFrame:
    """Placed blocks whose links to headings, ``#n``, lead to their anchors, from file to file; a link to none keeps its text alone. ``headings`` is (doc_id, ord, n)."""
    named = structure.anchor_map(files.join(tree.select("doc_id", "section", "heading"), ["doc_id", "section"], "left"), body.where("kind = 'heading'").select("doc_id", "section", "ord", "text"))
    targets = named.join(headings, ["doc_id", "ord"]).select("doc_id", F.col("n").alias("target"), "to_path", "anchor")
    x = body.select("doc_id", "ord", "section", F.posexplode("spans").alias("i", "s")).where(F.col("s.kind") == "link").withColumn("target", F.regexp_extract("s.target", "^#([0-9]+)$", 1)).where("target <> ''")
    links = x.select("doc_id", "ord", "section", "i", F.col("target").cast("long").alias("target")).join(files.select("doc_id", "section", "path"), ["doc_id", "section"])
    hrefs = structure.resolve_refs(links, targets).where("href IS NOT NULL").groupBy("doc_id", "ord").agg(F.map_from_entries(F.collect_list(F.struct("i", "href"))).alias("hrefs"))
    ours = lambda s: (s["kind"] == "link") & s["target"].rlike("^#[0-9]+$")
    led = F.transform("spans", lambda s, i: F.struct(s["depth"].alias("depth"), s["kind"].alias("kind"), s["text"].alias("text"), F.when(ours(s), F.try_element_at("hrefs", i)).otherwise(s["target"]).alias("target")))
    return body.join(hrefs, ["doc_id", "ord"], "left").withColumn("spans", led).drop("hrefs")


def site(parsed: DataFrame, min_tokens: int = structure.MIN_TOKENS, max_tokens: int = structure.MAX_TOKENS) -> DataFrame:
    """(doc_id, path, markdown): the files of every document that was parsed. Small sections stand in their parent's file under their own headings, large texts in parts of their own; what
    comes before the first heading is in index.md, with the list of the top sections."""
    blocks = structure.bounded(C.block_rows(parsed)).withColumn("page_from", F.col("page").cast("long")).withColumn("page_to", F.col("page").cast("long"))
    blocks = blocks.withColumn("level", F.when(F.col("kind") == "heading", F.greatest(F.lit(1), F.least(F.coalesce("level", F.lit(6)), F.lit(6)))))
    folded = saved(structure.fold_sections(blocks))
    headings = folded.where("kind = 'heading'").select("doc_id", F.col("ord").cast("long").alias("ord"), (F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1).cast("long").alias("n"))
    tree, places = structure.balanced(folded, min_tokens, max_tokens)
    tree, body = saved(tree), folded.drop("section").join(places, ["doc_id", "ord"])
    files = structure.rooted(structure.assign_paths(tree.drop("heading")), parsed.where("status = 'ok'").select("doc_id", "title"))
    pages = structure.section_pages(folded).withColumn("section", structure.scaled("section"))
    files = files.withColumn("_pages_of", F.col("section") - F.pmod("section", F.lit(structure.SCALE))).join(pages.withColumnRenamed("section", "_pages_of"), ["doc_id", "_pages_of"], "left").drop("_pages_of")
    files = saved(files)
    shown = rendered(resolved(body, tree, files, headings))
    joined = shown.groupBy("doc_id", "section").agg(F.sort_array(F.collect_list(F.struct("ord", "kind", "depth", "ordered", "markdown"))).alias("blocks")).select("doc_id", "section", F.pandas_udf(_bodies, "string")("blocks").alias("body"))
    heads = structure.frontmatter(structure.navigation(structure.toc(files)))
    text = F.concat("yaml", F.lit("\n"), title_line("title", F.size("breadcrumb")), F.lit("\n\n"), F.coalesce(F.concat("toc", F.lit("\n\n")), F.lit("")), F.coalesce(F.concat("body", F.lit("\n")), F.lit("")))
    return heads.join(joined, ["doc_id", "section"], "left").select("doc_id", "path", text.alias("markdown"))


def _refuse(root: str, force: bool) -> None:
    if os.path.isdir(root) and os.listdir(root) and not force:
        raise FileExistsError(f"{root} is not empty")


def write_trees(files: DataFrame, assets: DataFrame, root: str, force: bool = False) -> None:
    """Write (dir, path, markdown) and (dir, filename, bytes) under ``root``, a folder all executors share. Everything goes to a folder beside it first, which takes its place when all
    tasks are done; a folder that isn't empty is only replaced with ``force``."""
    _refuse(root, force)
    temporary = f"{root.rstrip('/')}.{uuid.uuid4().hex}"
    os.makedirs(temporary)

    def write(rows) -> None:
        for r in rows:
            target = os.path.normpath(os.path.join(temporary, r.name))
            if not target.startswith(temporary + os.sep):
                raise ValueError(f"{r.name} leaves the tree")
            os.makedirs(os.path.dirname(target), exist_ok=True)
            part = f"{target}.{uuid.uuid4().hex}"
            with open(part, "wb") as f:
                f.write(bytes(r.data))
            os.replace(part, target)  # a repeated task leaves the same file

    texts = files.select(F.concat("dir", F.lit("/"), "path").alias("name"), F.encode("markdown", "UTF-8").alias("data"))
    media = assets.select(F.concat("dir", F.lit("/_assets/"), "filename").alias("name"), F.col("bytes").alias("data"))
    try:
        texts.unionByName(media).foreachPartition(write)
    except BaseException:
        shutil.rmtree(temporary, ignore_errors=True)
        raise
    old = f"{temporary}.old"
    if os.path.isdir(root):
        os.rename(root, old)
    os.rename(temporary, root)
    shutil.rmtree(old, ignore_errors=True)


def convert(spark: SparkSession, source: str, target: str, force: bool = False, min_tokens: int = structure.MIN_TOKENS, max_tokens: int = structure.MAX_TOKENS) -> int:
    """Convert every supported file under ``source`` into a tree under ``target`` and write the page that lists them. Gives the batch's exit code: 0 all well, 3 some, 2 all unsupported or
    protected, 1 else. Inputs that would write to one folder, or into each other's, end it before anything is read."""
    _refuse(target, force)
    inputs = C.read_files(spark, source)
    base = "file:" + os.path.abspath(source)
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + os.path.abspath(source).replace(".", r"\.") + "/?", "")
    named = inputs.withColumn("input", rel).withColumn("dir", batch.out_dir(F.col("input"))).withColumn("out_dir", F.col("dir"))
    clash = batch.equal_outputs(named.select("out_dir")).select("out_dir").unionByName(batch.nested_outputs(named.select("out_dir")).select("out_dir")).take(1)
    if clash:
        raise ValueError(f"{base}: outputs collide at {clash[0].out_dir}")
    where = named.select("doc_id", "dir", "input")
    parsed = C.documents(inputs).cache()
    try:
        files = site(parsed, min_tokens, max_tokens).join(where.select("doc_id", "dir"), "doc_id").cache()
        assets = parsed.select("doc_id", F.explode("assets").alias("a")).select("doc_id", "a.filename", "a.bytes").join(where.select("doc_id", "dir"), "doc_id")
        write_trees(files, assets, target, force)
        counts = files.groupBy("doc_id").agg(F.count("*").alias("files"))
        outcomes = parsed.join(where, "doc_id").join(counts, "doc_id", "left").select(F.lit("all").alias("library"), F.col("input").alias("ord"), "title", F.col("dir").alias("rel_dir"), F.col("source_format").alias("format"), F.coalesce("files", F.lit(0)).alias("files"), "input", "error")
        index, code = batch.library_index(outcomes).first(), batch.batch_exit_code(outcomes).first().code
        files.unpersist()
    finally:
        parsed.unpersist()
    with open(os.path.join(target, "index.md"), "w", encoding="utf-8") as f:
        f.write(index.markdown if index else "")
    return int(code)
