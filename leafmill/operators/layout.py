"""Pages as positioned text: lines, body size, headings, recognised words, zones, and titles that a page prints again."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_title, title_mask, trim_unicode


def _line_numbers(ys: pd.Series, sizes: pd.Series) -> pd.Series:
    def fold(y, size) -> list[int]:
        n, first, out = 0, None, []
        for a, b in zip(y.tolist(), size.tolist()):
            if first is None or abs(first - a) > max(0.5 * b, 2.0):
                n, first = n + 1, a
            out.append(n)
        return out

    return pd.Series([fold(y, s) for y, s in zip(ys, sizes)])


def _in_order() -> Column:
    """A group's runs from the top down, and from left to right; runs of one place by ``seq``, those that share it too by size and text, as every step has to see one order."""
    return F.sort_array(F.collect_list(F.struct((-F.col("y")).alias("down"), "x", "seq", "y", "size", "text")))


def group_lines(runs: DataFrame) -> DataFrame:
    """``runs`` (doc_id, page, seq, x, y, size, text) with ``line`` from 1: from the top down, and from left to right, a run joins the line while its y differs from that of
    the line's first run by at most half its own size, 2 at least. A page is folded in one pass over two arrays of numbers."""
    page = runs.groupBy("doc_id", "page").agg(_in_order().alias("r"))
    folded = page.withColumn("line", F.pandas_udf(_line_numbers, "array<int>")(F.col("r.y").cast("array<double>"), F.col("r.size").cast("array<double>")))
    z = folded.select("doc_id", "page", F.explode(F.arrays_zip("r", "line")).alias("z"))
    return z.select("doc_id", "page", F.col("z.line").alias("line"), F.col("z.r.seq").alias("seq"), F.col("z.r.x").alias("x"), F.col("z.r.y").alias("y"), F.col("z.r.size").alias("size"), F.col("z.r.text").alias("text"))


def lines(grouped: DataFrame) -> DataFrame:
    """(doc_id, page, line, x, y, size, text) of ``group_lines``: the leftmost x, the first run's y, the largest size, and the runs' texts in the order that grouped them, trimmed,
    with a space before each that doesn't begin with one. Lines of no text go."""
    piece = lambda r: F.concat(F.when(F.startswith(r["text"], F.lit(" ")), F.lit("")).otherwise(F.lit(" ")), trim_unicode(r["text"]))
    text = trim_unicode(F.array_join(F.transform(_in_order(), piece), ""))
    return grouped.groupBy("doc_id", "page", "line").agg(F.min("x").alias("x"), F.max("y").alias("y"), F.max("size").alias("size"), text.alias("text")).where("text <> ''")


def body_size(lines_: DataFrame, size: str = "size") -> DataFrame:
    """(doc_id, body): each document's most frequent rounded size; of equally frequent ones the smallest."""
    counted = lines_.groupBy("doc_id", F.round(size).cast("long").alias("body")).agg(F.count("*").alias("n"))
    return counted.groupBy("doc_id").agg(F.min_by("body", F.struct(-F.col("n"), "body")).alias("body"))


def heading_level(size: Column, body: Column) -> Column:
    """1 from 1.8 times the body's size, 2 from 1.4, 3 from 1.15; null below."""
    r = size / body
    return F.when(r >= 1.8, 1).when(r >= 1.4, 2).when(r >= 1.15, 3)


def page_blocks(lines_: DataFrame, body: DataFrame) -> DataFrame:
    """(doc_id, page, block, kind, level, text): large lines are headings, of the others those follow each other in a paragraph that are at most 1.5 of the larger size apart."""
    w = Window.partitionBy("doc_id", "page").orderBy("line")
    x = lines_.join(body, "doc_id").withColumn("level", heading_level(F.col("size"), F.col("body")))
    gap = F.abs(F.lag("y").over(w) - F.col("y")) > 1.5 * F.greatest("size", F.lag("size").over(w))
    new = F.col("level").isNotNull() | F.lag("level").over(w).isNotNull() | gap | F.lag("line").over(w).isNull()
    x = x.withColumn("new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("block", F.sum("new").over(w))
    return x.groupBy("doc_id", "page", "block").agg(F.when(F.max("level").isNotNull(), F.lit("heading")).otherwise(F.lit("para")).alias("kind"), F.max("level").alias("level"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda r: r["text"]), " ").alias("text"))


def zone_blocks(lines_: DataFrame, body: DataFrame) -> DataFrame:
    """The same of lines that know where a paragraph starts (``para_start``)."""
    w = Window.partitionBy("doc_id", "page").orderBy("line")
    x = lines_.join(body, "doc_id").withColumn("level", heading_level(F.col("size"), F.col("body")))
    new = F.col("level").isNotNull() | F.lag("level").over(w).isNotNull() | F.col("para_start") | F.lag("line").over(w).isNull()
    x = x.withColumn("new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("block", F.sum("new").over(w))
    return x.groupBy("doc_id", "page", "block").agg(F.when(F.max("level").isNotNull(), F.lit("heading")).otherwise(F.lit("para")).alias("kind"), F.max("level").alias("level"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda r: r["text"]), " ").alias("text"))


def page_note(has_text: Column, has_image: Column, has_heading: Column, ocr: Column, page: Column) -> Column:
    """What stands in for a page's missing text; null where it has some. ``ocr``: null if off, else text, fallback or note."""
    return (
        F.when(has_text, F.lit(None).cast("string"))
        .when(has_image & ocr.isNull(), F.lit("scanned page: no text layer; OCR not enabled"))
        .when(has_image & (ocr == "fallback"), F.lit("page image only; OCR found no confident text"))
        .when(has_image & (ocr == "note"), F.lit("no text recovered by OCR"))
        .when(~has_image & ~has_heading, F.concat(F.lit("page "), page.cast("string"), F.lit(": no extractable text")))
    )


def cumulative_bytes(pages: DataFrame) -> DataFrame:
    """``pages`` (doc_id, page, text) with ``total``: the bytes of a document's text up to each page."""
    return pages.withColumn("total", F.sum(F.octet_length(F.coalesce("text", F.lit("")))).over(Window.partitionBy("doc_id").orderBy("page")))


def recognised_lines(words: DataFrame) -> DataFrame:
    """Words of (doc_id, page, block, par, line, word, left, top, width, height, conf, text) with a confidence of 0 or more and a text that isn't blank, as lines: the box around
    them, their mean confidence, their texts in order."""
    ok = words.where("conf >= 0 AND trim(text) <> ''")
    return ok.groupBy("doc_id", "page", "block", "par", "line").agg(
        F.min("left").alias("left"), F.min("top").alias("top"), F.max(F.col("left") + F.col("width")).alias("right"), F.max(F.col("top") + F.col("height")).alias("bottom"), F.avg("conf").alias("conf"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word", "text"))), lambda r: r["text"]), " ").alias("text"),
    )


def _mean(x: Column) -> Column:
    """The mean of numbers summed as decimals, whatever the order they come in; of doubles where one is no decimal."""
    exact = x.try_cast("decimal(38,12)")
    return F.when(F.count(exact) == F.count(x), F.sum(exact).cast("double") / F.nullif(F.count(x), F.lit(0))).otherwise(F.avg(x))


def recognition_outcome(lines_: DataFrame, force_text: bool = False, min_chars: int = 8, min_conf: float = 60.0) -> DataFrame:
    """(doc_id, page, chars, conf, outcome) of recognised lines: ``text`` if they have ``min_chars`` characters and, unless it is forced, are sure enough; else ``note`` if it is forced, and
    ``fallback`` if not."""
    solid = F.trim("text") != ""
    x = lines_.groupBy("doc_id", "page").agg(F.sum(F.length(F.trim("text"))).alias("chars"), _mean(F.when(solid, F.col("conf"))).alias("conf"))
    enough = F.col("chars") >= min_chars
    if force_text:
        return x.withColumn("outcome", F.when(enough, "text").otherwise("note"))
    return x.withColumn("outcome", F.when(enough & (F.coalesce("conf", F.lit(0.0)) >= min_conf), "text").otherwise("fallback"))


def recognised_page_lines(lines_: DataFrame, upward: bool = True) -> DataFrame:
    """Recognised lines as a page's own, (doc_id, page, line, x, y, size, text): ``upward`` where a page's y grows to the top, as in PDF, so the tops are negated; else with ``para_start``,
    which recognition doesn't tell, as of zones."""
    order = Window.partitionBy("doc_id", "page").orderBy("block", "par", "line")
    x = lines_.select("doc_id", "page", F.row_number().over(order).alias("line"), F.col("left").alias("x"), (-F.col("top") if upward else F.col("top")).alias("y"), (F.col("bottom") - F.col("top")).alias("size"), "text")
    return x if upward else x.withColumn("para_start", F.lit(False))


def printed_titles(lines_: DataFrame, titles: DataFrame) -> DataFrame:
    """``lines_`` (doc_id, page, line, text) with ``printed``: each title of (doc_id, page, seq, title), in turn, claims the page's first one, two or three consecutive lines that no
    other has claimed and that together, compared as titles are, equal it; a line without letters and digits is no part of any. Where a page has one title, which is most, this is
    decided by windows and joins; the claims of several depend on each other, and their pages are folded one by one."""
    many = titles.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("seq", normalize_title("title").alias("t")))).alias("ts"))
    single = many.where("size(ts) = 1").select("doc_id", "page", F.col("ts")[0]["t"].alias("t")).where("t <> ''")
    w = Window.partitionBy("doc_id", "page").orderBy("line")
    x = lines_.withColumn("n1", F.nullif(normalize_title("text"), F.lit("")))
    x = x.withColumn("b", F.lead("n1", 1).over(w)).withColumn("c", F.lead("n1", 2).over(w))
    x = x.withColumn("n2", F.concat("n1", F.lit(" "), "b")).withColumn("n3", F.concat("n1", F.lit(" "), "b", F.lit(" "), "c")).withColumn("pos", F.row_number().over(w))
    m = x.join(single, ["doc_id", "page"]).withColumn("run", F.when(F.col("n1") == F.col("t"), 1).when(F.col("n2") == F.col("t"), 2).when(F.col("n3") == F.col("t"), 3)).where("run IS NOT NULL")
    first = m.groupBy("doc_id", "page").agg(F.min(F.struct("pos", "run")).alias("f")).select("doc_id", "page", F.col("f.pos").alias("at"), F.col("f.run").alias("run"))
    one = x.join(first, ["doc_id", "page"], "left").withColumn("printed", F.coalesce((F.col("pos") >= F.col("at")) & (F.col("pos") < F.col("at") + F.col("run")), F.lit(False)))
    several = many.where("size(ts) > 1").select("doc_id", "page", F.col("ts.t").alias("ts"))
    columns = lines_.columns
    kept = one.join(several.select("doc_id", "page"), ["doc_id", "page"], "left_anti").select(*columns, "printed")
    claimed = lines_.join(several, ["doc_id", "page"]).groupBy("doc_id", "page").applyInPandas(_claims(columns), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lines_.schema) + ", printed boolean")
    return kept.unionByName(claimed)


def _claims(columns: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line").reset_index(drop=True)
        return pdf[columns].assign(printed=title_mask(pdf["text"].tolist(), list(pdf["ts"][0])))

    return run


def without_printed(marked: DataFrame) -> DataFrame:
    """The lines of ``printed_titles`` that no title claimed; if there is a ``para_start``, one that a dropped line had goes to the next kept one."""
    if "para_start" not in marked.columns:
        return marked.where("NOT printed").drop("printed")
    w = Window.partitionBy("doc_id", "page").orderBy("line")
    group = F.coalesce(F.sum((~F.col("printed")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = marked.withColumn("g", group)
    return x.withColumn("para_start", F.max("para_start").over(Window.partitionBy("doc_id", "page", "g"))).where("NOT printed").drop("printed", "g")


def zone_lines(zones: DataFrame) -> DataFrame:
    """(doc_id, page, line, text, size, para_start) of zones (doc_id, page, node_path, kind, text, y0, y1): line zones in reading order, each with its own text or else its words'; one starts a
    paragraph if a paragraph, region or column was opened since the line before."""
    w = Window.partitionBy("doc_id", "page").orderBy("node_path")
    opens = F.col("kind").isin("page", "column", "region", "para")
    x = zones.withColumn("n", F.sum((F.col("kind") == "line").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("n", F.coalesce("n", F.lit(0)))
    x = x.withColumn("para_start", F.max(opens.cast("int")).over(Window.partitionBy("doc_id", "page", "n")) == 1)
    words = zones.where("kind IN ('word', 'char')").groupBy("doc_id", "page", F.slice("node_path", F.lit(1), F.size("node_path") - 1).alias("node_path")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node_path", "text"))), lambda r: r["text"]), " ").alias("joined"))
    lines_ = x.where("kind = 'line'").join(words, ["doc_id", "page", "node_path"], "left")
    return lines_.select("doc_id", "page", (F.col("n") + 1).alias("line"), F.coalesce(F.nullif(F.trim("text"), F.lit("")), "joined", F.lit("")).alias("text"), (F.col("y1") - F.col("y0")).alias("size"), "para_start")


def outline_levels(bookmarks: DataFrame) -> DataFrame:
    """(doc_id, page, node_path, level, title) of bookmarks (doc_id, node_path, title, url): the level is the depth, 6 at most; the page that of a ``#N`` address, 0 for any other;
    a blank title drops its whole subtree: a bookmark's ancestors are exploded and equi-joined."""
    blank = bookmarks.where("trim(title) = ''").select("doc_id", F.col("node_path").alias("above"))
    up = bookmarks.select("doc_id", "node_path", F.explode(F.transform(F.sequence(F.lit(1), F.size("node_path")), lambda k: F.slice("node_path", F.lit(1), k))).alias("above"))
    dead = up.join(blank, ["doc_id", "above"]).select("doc_id", "node_path").distinct()
    page = F.coalesce(F.expr("try_cast(regexp_extract(trim(url), '^#([0-9]+)$', 1) AS int)"), F.lit(0))
    return bookmarks.join(dead, ["doc_id", "node_path"], "left_anti").select("doc_id", page.alias("page"), "node_path", F.least(F.size("node_path"), F.lit(6)).alias("level"), F.trim("title").alias("title"))
