"""Predicates and paths for untrusted input, as column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c

TOTAL, RATIO = 512 << 20, 200


def within_expansion(decompressed: Column | str, compressed: Column | str) -> Column:
    """Whether so many bytes may come of so many: in all at most 512 MiB, and at most 200 for one."""
    d, c = _c(decompressed).cast("long"), _c(compressed).cast("long")
    return (d <= TOTAL) & ((c == 0) | (F.floor(d / F.greatest(c, F.lit(1))) <= RATIO))


def resolve_rel(base: Column | str, target: Column | str) -> Column:
    """The archive path that ``target`` names from the folder ``base``; null if it leaves the archive or is nothing. A leading slash is the archive's root."""
    parts = F.when(_c(target).startswith("/"), F.split(_c(target), "/")).otherwise(F.concat(F.split(_c(base), "/"), F.split(_c(target), "/")))
    none = F.lit(None).cast("array<string>")
    step = lambda acc, p: (
        F.when(acc.isNull(), none).when(p.isin("", "."), acc).when((p == "..") & (F.size(acc) == 0), none).when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    )
    return F.nullif(F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"), F.lit(""))


def has_scheme(x: Column | str) -> Column:
    """Whether a colon comes before the first slash, number sign or question mark."""
    return _c(x).rlike("^[^/#?]*:")


def parent_dir(x: Column | str) -> Column:
    return F.regexp_extract(_c(x), "^(.*)/[^/]*$", 1)


def media_filename(path: Column | str, n: Column) -> Column:
    """A safe name for the n-th asset: its number and the last part of its path."""
    return F.concat(F.lpad(n.cast("string"), 3, "0"), F.lit("-"), F.regexp_replace(F.regexp_extract(_c(path), "([^/]*)$", 1), "[^A-Za-z0-9._-]", "_"))


def decode_percent(text: str) -> str:
    """``%XX`` as bytes; what is no such escape stays, and all of it does if the result isn't UTF-8."""
    try:
        return re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), text.encode()).decode()
    except UnicodeDecodeError:
        return text


def _decoded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else decode_percent(t) if "%" in t else t)


def percent_decode(x: Column | str) -> Column:
    return F.pandas_udf(_decoded, "string")(_c(x))
