"""Small rules of the containers as column expressions: addresses, names and references inside books and decks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c

INLINE_TAGS = ("em", "i", "strong", "b", "a", "code", "br", "sub", "sup", "small", "u", "s", "span")


def package_path(container: Column | str) -> Column:
    """The package document that a container file names; empty for none."""
    return F.regexp_extract(_c(container), "full-path=(['\"])(.*?)\\1", 2)


def has_type(types: Column | str, name: str) -> Column:
    """Whether a list of types separated by white space has ``name``."""
    return F.array_contains(F.split(F.trim(_c(types)), r"\s+"), name)


def is_inline(tag: Column | str, display: Column | None = None) -> Column:
    """Whether an element stays in its paragraph; math does unless it is displayed as a block."""
    t = F.lower(_c(tag))
    return t.isin(*INLINE_TAGS) | ((t == "math") & (F.coalesce(display, F.lit("")) != "block" if display is not None else F.lit(True)))


def rels_path(part: Column | str) -> Column:
    """Where the relationships of a part of a deck are."""
    return F.regexp_replace(_c(part), "^(.*)/([^/]+)$", "$1/_rels/$2.rels")


def base32(text: Column | str) -> Column:
    """The number that base-32 digits 0-9, A-V write; null for anything else."""
    return F.when(_c(text).rlike("^[0-9A-Va-v]+$"), F.conv(F.upper(_c(text)), 32, 10).cast("long"))


def position_links(html: Column | str) -> Column:
    """The distinct position addresses in a book's text."""
    return F.array_distinct(F.regexp_extract_all(_c(html), F.lit("(kindle:pos:fid:[^\"'<> \t\n]*)"), F.lit(1)))


def position_of(link: Column | str) -> Column:
    """(fragment, offset) of a position address; null for anything else."""
    pattern = "^kindle:pos:fid:([0-9A-Va-v]+):off:([0-9A-Va-v]+)$"
    return F.when(_c(link).rlike(pattern), F.struct(base32(F.regexp_extract(_c(link), pattern, 1)).alias("fragment"), base32(F.regexp_extract(_c(link), pattern, 2)).alias("offset")))


def byte_positions(raw: Column | str) -> Column:
    """The byte offsets that an old book's links name, ascending and distinct."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(_c(raw), F.lit("filepos=[\"']?([0-9]+)"), F.lit(1)), lambda x: x.cast("long"))))


def resource_number(src: Column | str) -> Column:
    """The number of an embedded resource, from 1; null for none."""
    n = base32(F.regexp_extract(_c(src), "^kindle:embed:([A-Za-z0-9]*)", 1))
    return F.when(n > 0, n)


def unwrap_images(html: Column | str) -> Column:
    """A paragraph that holds one image and nothing else becomes the image."""
    return F.regexp_replace(_c(html), r"<p(?: [^>]*)?>(<img[^>]*/>)</p>", "$1")


def image_kind(data: Column | str) -> Column:
    """png, jpg, gif or bmp by the first bytes; null for anything else."""
    head = lambda n: F.hex(F.substring(_c(data), 1, n))
    return F.when(head(4) == "89504E47", "png").when(head(2) == "FFD8", "jpg").when(head(4) == "47494638", "gif").when(head(2) == "424D", "bmp")


def document_title(*candidates: Column | str) -> Column:
    """The first title that isn't blank; the last candidate is a path, of which the name without extension counts."""
    named = [F.nullif(F.trim(_c(c)), F.lit("")) for c in candidates[:-1]]
    stem = F.regexp_replace(F.regexp_extract(_c(candidates[-1]), "([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return F.coalesce(*named, F.nullif(stem, F.lit("")), F.lit("Untitled"))


def page_of(url: Column | str) -> Column:
    """The page of a ``#N`` address; 0 for any other."""
    return F.coalesce(F.regexp_extract(F.trim(_c(url)), "^#([0-9]{1,9})$", 1).try_cast("int"), F.lit(0))
