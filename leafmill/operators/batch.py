"""Inputs and outcomes of a batch: which files, where to, what collides, how it ended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXTENSIONS = ("epub", "pptx", "mobi", "azw3", "pdf", "djvu", "djv")


def supported(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1)).isin(*EXTENSIONS)


def out_dir(rel: Column) -> Column:
    """The relative path without its extension."""
    return F.regexp_replace(rel, r"(?<=[^/])\.[^./]*$", "")


def detected(content: Column, hint: Column) -> Column:
    """The format of a file by its first bytes, or else by the extension, as it is written: pdf, mobi, djvu, zip, ... null for none."""
    head = F.substring(content, 1, 4)
    return (
        F.when(head == F.lit(b"%PDF"), "pdf")
        .when((F.octet_length(content) > 68) & (F.substring(content, 61, 8) == F.lit(b"BOOKMOBI")), "mobi")
        .when(head == F.lit(b"AT&T"), "djvu")
        .when(head == F.lit(b"PK\x03\x04"), "zip")
        .when(hint.isin("epub", "pptx", "mobi", "azw3", "pdf", "djvu"), hint)
        .when(hint == "djv", "djvu")
    )


def equal_outputs(items: DataFrame) -> DataFrame:
    """(out_dir, n): folders that several inputs would write to."""
    return items.groupBy("out_dir").agg(F.count("*").alias("n")).where("n > 1")


def nested_outputs(items: DataFrame) -> DataFrame:
    """(out_dir, within): folders that lie in another's, with the innermost such one. A folder's ancestors are exploded and equi-joined: no sort of all folders, no range join."""
    x = items.select("out_dir").distinct().withColumn("parts", F.split("out_dir", "/"))
    up = x.select("out_dir", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("parts") - 1, F.lit(1))), lambda k: F.array_join(F.slice("parts", F.lit(1), k), "/"))).alias("within"), F.size("parts").alias("n")).where("n > 1")
    known = items.select(F.col("out_dir").alias("within")).distinct()
    return up.join(known, "within").groupBy("out_dir").agg(F.max_by("within", F.length("within")).alias("within"))


def exit_code(error: Column) -> Column:
    return F.when(error.rlike("unsupported|DRM|encrypted"), 2).otherwise(1)


def batch_exit_code(outcomes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(.., total, failed, code) of outcomes with an ``error``, null for success: 0 if all went well, 3 if some, 2 if all failed as unsupported or protected, else 1."""
    failed = F.count("error")
    code = F.when(failed == 0, 0).when(failed < F.count("*"), 3).when(F.min(F.when(F.col("error").isNotNull(), exit_code(F.col("error")))) == 2, 2).otherwise(1)
    return outcomes.groupBy(*(by or [])).agg(F.count("*").alias("total"), failed.alias("failed"), code.alias("code"))


def library_index(outcomes: DataFrame, by: str = "library") -> DataFrame:
    """(library, markdown): the page that lists the documents of (library, ord, title, rel_dir, format, files, input, error), failures last."""
    ok, bad = F.col("error").isNull(), F.col("error").isNotNull()
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), "rel_dir")
    good = F.concat(F.lit("- ["), title, F.lit("]("), F.col("rel_dir"), F.lit("/index.md) — "), F.col("format"), F.lit(", "), F.col("files").cast("string"), F.lit(" files\n"))
    ill = F.concat(F.lit("- `"), F.col("input"), F.lit("` — "), F.col("error"), F.lit("\n"))
    listed = lambda when, line: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(when, F.struct("ord", line.alias("l"))))), lambda x: x["l"]), "")
    x = outcomes.groupBy(by).agg(F.count_if(ok).cast("string").alias("n"), F.count_if(bad).cast("string").alias("f"), F.count("*").cast("string").alias("t"), listed(ok, good).alias("g"), listed(bad, ill).alias("b"))
    head = F.concat(F.lit("---\nkind: library\ndocuments: "), "n", F.lit("\nfailed: "), "f", F.lit("\n---\n\n# Converted documents\n\n"), "n", F.lit(" of "), "t", F.lit(" inputs converted.\n\n"), "g")
    return x.select(by, F.concat(head, F.when(F.col("f") != "0", F.concat(F.lit("\n## Failed\n\n"), F.col("b"))).otherwise(F.lit(""))).alias("markdown"))


def numbered_assets(assets: DataFrame) -> DataFrame:
    """``assets`` (doc_id, ord, path) with ``filename``."""
    from ..functions.guards import media_filename

    return assets.withColumn("filename", media_filename("path", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1))
