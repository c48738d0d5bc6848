"""Text recognition as a port: any function of an image's bytes that gives words can be run over a table of pages."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One recognised word: (block, par, line, word, left, top, width, height, confidence, text).
Word = tuple[int, int, int, int, float, float, float, float, float, str]
Recogniser = Callable[[bytes, str], list[Word]]
_WORDS = "doc_id long, page long, block long, par long, line long, word long, left double, top double, width double, height double, conf double, text string"
_NAMES = [x.split()[0] for x in _WORDS.split(", ")]


def ensure_recogniser(recogniser: Recogniser | None, language: str, known: list[str] | None = None) -> None:
    """Before any job runs: ValueError if there is no recogniser, or if the language isn't one or more known names joined by ``+``."""
    if recogniser is None:
        raise ValueError("text recognition is not available")
    names = language.split("+")
    if not all(re.fullmatch(r"[A-Za-z0-9_/-]+", x) for x in names):
        raise ValueError(f"not a language: {language!r}")
    missing = [x for x in names if known is not None and x not in known]
    if missing:
        raise ValueError(f"languages that are not installed: {', '.join(missing)}")


def recognised_words(pages: DataFrame, recogniser: Recogniser, language: str = "eng") -> DataFrame:
    """The words of (doc_id, page, image), for ``layout.recognised_lines``. An image that is null, or on which the recogniser fails, has none; it ends nothing else."""

    def run(batches):
        for pdf in batches:
            rows = []
            for doc, page, image in zip(pdf["doc_id"], pdf["page"], pdf["image"]):
                try:
                    rows += [(doc, page, *w) for w in recogniser(bytes(image), language)] if image is not None else []
                except Exception:  # noqa: BLE001  one page must not end the batch
                    continue
            yield pd.DataFrame(rows, columns=_NAMES)

    return pages.select(F.col("doc_id").cast("long"), F.col("page").cast("long"), "image").mapInPandas(run, _WORDS)


def tsv_words(text: str) -> list[Word]:
    """The words of a recogniser's table of tab-separated lines: those of level 5 with twelve fields, others are passed over."""
    out = []
    for line in text.splitlines():
        f = line.split("\t")
        if len(f) < 12 or f[0] != "5":
            continue
        try:
            out.append((int(f[2]), int(f[3]), int(f[4]), int(f[5]), *map(float, f[6:11]), f[11]))
        except ValueError:
            continue
    return out
