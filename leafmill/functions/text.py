"""Text rules as column expressions: navigation text, anchors, slugs, Markdown, HTML and YAML escapes.

Everything here runs inside the JVM except ``path_slug``, ``percent_decode`` and ``escape_text``, which Spark has no functions for (Unicode
composition, byte escapes, and escapes that depend on what stands before). A null argument gives null.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim_unicode(x: Column | str) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def fold_newlines(x: Column | str) -> Column:
    """Each run of line ends becomes one space."""
    return F.regexp_replace(_c(x), r"[\r\n]+", " ")


def normalize_newlines(x: Column | str) -> Column:
    """Each run of line ends becomes one line feed."""
    return F.regexp_replace(_c(x), r"[\r\n]+", "\n")


def collapse_ws(x: Column | str) -> Column:
    """Each run of ASCII white space becomes one space; a no-break space stays."""
    return F.regexp_replace(_c(x), r"[ \t\n\r\f]+", " ")


def trim_trailing_ws(x: Column | str) -> Column:
    """ASCII white space at the end goes, unless there is nothing else."""
    return F.when(_c(x).rlike(r"[^ \t\n\r\f]"), F.regexp_replace(_c(x), r"[ \t\n\r\f]+$", "")).otherwise(_c(x))


def normalize_title(x: Column | str) -> Column:
    """Lower-case letters and digits, anything between them one space: what two titles are compared by."""
    return F.trim(F.regexp_replace(F.lower(_c(x)), r"[^\p{IsAlphabetic}\p{N}]+", " "))


def normal_title(title: str) -> str:
    """``normalize_title`` of one string."""
    return " ".join("".join(c if c.isalnum() else " " for c in title.lower()).split())


def title_mask(lines: list[str], titles: list[str], longest: int = 3) -> list[bool]:
    """Which lines of a page print its titles again: each title, in turn, claims the first run of up to ``longest`` lines that no other has claimed, that none of is without letters and
    digits, and that together are the title."""
    claimed, norm = [False] * len(lines), [normal_title(x) for x in lines]
    for want in filter(None, map(normal_title, titles)):
        for start in range(len(lines)):
            joined = ""
            for i in range(start, min(start + longest, len(lines))):
                if claimed[i] or not norm[i]:
                    break
                joined = f"{joined} {norm[i]}" if joined else norm[i]
                if joined == want:
                    break
            if joined == want:
                claimed[start : i + 1] = [True] * (i + 1 - start)
                break
    return claimed


def _lower(x: Column) -> Column:
    return F.lower(F.translate(x, "Σ", "σ"))  # letter by letter: no final sigma


def anchor_slug(x: Column | str) -> Column:
    """The anchor that a heading gets where Markdown is shown: lower case, words, hyphens and spaces only, spaces as hyphens; ``section`` for none."""
    kept = F.regexp_replace(_lower(trim_unicode(fold_newlines(x))), r"(?U)[^\w\- ]", "")
    return F.coalesce(F.nullif(F.replace(kept, F.lit(" "), F.lit("-")), F.lit("")), F.when(_c(x).isNotNull(), F.lit("section")))


def anchor_of(title: str) -> str:
    """``anchor_slug`` of one title."""
    folded = re.sub(r"[\r\n]+", " ", title).strip()
    lower = "".join("σ" if c == "Σ" else c.lower() for c in folded)
    return "".join("-" if c == " " else c for c in lower if c in "- " or _is_word(c)) or "section"


def anchors_of(titles: list[str]) -> list[str]:
    """The anchors of a file's headings, in order."""
    seen: dict[str, int] = {}
    out = []
    for base in map(anchor_of, titles):
        n = seen.get(base, 0)
        seen[base] = n + 1
        out.append(f"{base}-{n}" if n else base)
    return out


def _is_word(c: str) -> bool:
    k = unicodedata.category(c)
    return c.isalpha() or k[0] == "M" or k in ("Nd", "Nl", "Pc") or k == "So" and "Ⓐ" <= c <= "ⓩ"


def slug_of(title: str, most: int = 64) -> str:
    """A file name for a title: composed, lower case, words joined by single hyphens, at most ``most`` bytes, never empty."""
    out, gap = [], False
    for c in unicodedata.normalize("NFC", title):
        c = c.lower()
        word = "".join(y for y in c if _is_word(y))
        if word:
            if gap and out:
                out.append("-")
            gap = False
            out.append(word)
        elif c not in "‌‍":
            gap = True
    data = "".join(out).encode()[:most].decode("utf-8", "ignore") if len("".join(out).encode()) > most else "".join(out)
    if len(data.encode()) < len("".join(out).encode()):
        full = "".join(out)
        if len(data) < len(full) and unicodedata.category(full[len(data)])[0] == "M":  # a cut before a mark takes its letter along
            data = re.sub(r".$", "", data)
    return data.rstrip("-") or "section"


def _slugs(titles: pd.Series) -> pd.Series:
    return titles.map(lambda t: None if t is None else slug_of(t))


def path_slug(x: Column | str) -> Column:
    """``slug_of`` each title."""
    return F.pandas_udf(_slugs, "string")(_c(x))


def ascii_path_slug(x: Column | str) -> Column:
    """``path_slug`` for titles of ASCII alone, inside the JVM."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(_c(x)), r"[^a-z0-9_]+", "-"), "^-|-$", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(slug, 1, 64), "-+$", ""), F.lit("")), F.when(_c(x).isNotNull(), F.lit("section")))


def numbered(anchor: Column, n: Column) -> Column:
    """The n-th heading (from 0) of one anchor in a file: ``a``, ``a-1``, ``a-2``."""
    return F.when(n == 0, anchor).otherwise(F.concat(anchor, F.lit("-"), n.cast("string")))


# ---------------------------------------------------------------- Markdown


def html_text(x: Column | str) -> Column:
    out = _c(x)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(out, r"[\r\n]+", "<br>")


def yaml_scalar(x: Column | str) -> Column:
    """A double-quoted YAML scalar; control characters become spaces."""
    return F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(_c(x), r'([\\"])', r"\\$1"), r"[\x00-\x1F\x7F]", " "), F.lit('"'))


def longest_run(x: Column | str, char: str = "`") -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(_c(x), F.lit(f"({re.escape(char)}+)"), F.lit(1)), lambda r: F.length(r))), F.when(_c(x).isNotNull(), F.lit(0)))


def fence_length(x: Column | str) -> Column:
    """How many backticks fence a block of code: one more than its longest run of them, three at least."""
    return F.greatest(F.lit(3), longest_run(x) + 1)


def info_string(x: Column | str) -> Column:
    """The language of a fence: the first token, without backticks."""
    return F.replace(F.regexp_extract(_c(x), r"^\s*(\S*)", 1), F.lit("`"), F.lit(""))


def code_block(x: Column | str, lang: Column | None = None) -> Column:
    fence = F.repeat(F.lit("`"), fence_length(x))
    return F.concat(fence, F.coalesce(info_string(lang), F.lit("")) if lang is not None else F.lit(""), F.lit("\n"), F.regexp_replace(_c(x), r"\n+$", ""), F.lit("\n"), fence, F.lit("\n"))


def math_block(x: Column | str) -> Column:
    """Display math, or a fence where ``$`` or a blank line would end it."""
    return F.when(F.contains(_c(x), F.lit("$")) | _c(x).rlike(r"(?:^|\n)[ \t]*\n"), code_block(x)).otherwise(F.concat(F.lit("$$\n"), _c(x), F.lit("\n$$\n")))


def code_span(x: Column | str) -> Column:
    """Code in a line: the fence is one longer than the longest run inside, with spaces where the content needs them."""
    body = F.when(_c(x) == "", F.lit(" ")).otherwise(fold_newlines(x))
    fence = F.repeat(F.lit("`"), longest_run(body) + 1)
    pad = F.when(body.rlike("^ *$"), F.lit("")).when(F.contains(body, F.lit("`")) | body.rlike("^ | $"), F.lit(" ")).otherwise(F.lit(""))
    return F.concat(fence, pad, body, pad, fence)


def math_span(x: Column | str) -> Column:
    """Math in a line, or code where ``$`` or a line end would break it."""
    return F.when(_c(x).rlike(r"[$\r\n]"), code_span(x)).otherwise(F.concat(F.lit("$"), _c(x), F.lit("$")))


def comment_note(x: Column | str) -> Column:
    """A note as an HTML comment that nothing in it can close."""
    body = F.regexp_replace(F.regexp_replace(_c(x), "-(?=-)", "- "), "-$", "- ")
    return F.concat(F.lit("<!-- "), body, F.lit(" -->"))


def atx_closing(x: Column | str) -> Column:
    """A heading's text whose last ``#`` run would be taken for its end, disarmed."""
    return F.regexp_replace(_c(x), r"(^|[ \t])(#+[ \t]*)$", r"$1\\$2")


def footnote_body(x: Column | str) -> Column:
    """Lines after the first that aren't blank stand four spaces in."""
    return F.regexp_replace(_c(x), r"\n(?=[^\n]*\S)", "\n    ")


def _percent(x: Column, chars: str) -> Column:
    out = F.replace(x, F.lit("%"), F.lit("%25")) if "%" in chars else x
    for c in [*chars.replace("%", ""), *map(chr, range(32)), "\x7f"]:
        out = F.replace(out, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return out


def dest_path(x: Column | str) -> Column:
    """A path of the tree as a link's destination."""
    return _percent(_c(x), '%#? ()<>\\"')


def dest_url(x: Column | str) -> Column:
    """A URL of the source as a link's destination: what is escaped there stays so."""
    return _percent(_c(x), ' ()<>\\"')


def escape_flow(x: Column | str) -> Column:
    """Text at the start of a paragraph, so that it stays text."""
    out = F.regexp_replace(_c(x), r"([\\`*_\[\]<~$])", r"\\$1")
    out = F.regexp_replace(out, r"&(?=#\d+;|#[xX][0-9a-fA-F]+;|[A-Za-z0-9]+;)", "\\\\&")
    out = F.regexp_replace(out, r"(?m)^([#\-+>=|])", r"\\$1")
    out = F.regexp_replace(out, r"(?m)^(\d{1,9})([.)])", r"$1\\$2")
    out = F.regexp_replace(out, "^ ", "&#32;")
    return F.regexp_replace(out, "^\t", "&#9;")


def escape_mid(x: Column | str) -> Column:
    """Text that stands within a line, so that it stays text."""
    return F.regexp_replace(F.regexp_replace(_c(x), r"([\\`*_\[\]<~$])", r"\\$1"), r"&(?=#\d+;|#[xX][0-9a-fA-F]+;|[A-Za-z0-9]+;)", "\\\\&")


def label(x: Column | str) -> Column:
    """A link's label or an image's text, on one line."""
    return fold_newlines(escape_mid(x))


def title_line(x: Column | str, level: Column) -> Column:
    """A file's title as its first heading, of a level from 1 to 6."""
    return F.concat(F.repeat(F.lit("#"), F.least(F.greatest(level, F.lit(1)), F.lit(6))), F.lit(" "), atx_closing(escape_mid(fold_newlines(x))))


def html_table(rows: Column) -> Column:
    """A table with merged cells: HTML, whose first row is the header."""
    line = lambda tag: lambda cells: F.concat(F.lit("<tr>"), F.array_join(F.transform(cells, lambda c: F.concat(F.lit(f"<{tag}>"), html_text(c), F.lit(f"</{tag}>"))), ""), F.lit("</tr>\n"))
    return F.concat(F.lit("<table>\n"), line("th")(F.get(rows, F.lit(0))), F.array_join(F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), line("td")), ""), F.lit("</table>\n"))


def escape_cell(x: Column | str) -> Column:
    """Text of a table's cell."""
    out = F.regexp_replace(_c(x), r"([\\`*_\[\]<~$|])", r"\\$1")
    out = F.regexp_replace(out, r"&(?=#\d+;|#[xX][0-9a-fA-F]+;|[A-Za-z0-9]+;)", "\\\\&")
    out = F.regexp_replace(out, r"[\r\n]+", "<br>")
    return F.regexp_replace(F.regexp_replace(out, " $", "&#32;"), "\t$", "&#9;")


def sanitize_math(x: Column | str) -> Column:
    """Text inside math: its delimiters disarmed, line ends as spaces."""
    out = F.replace(_c(x), F.lit("\\"), F.lit("\u0000"))
    out = F.regexp_replace(out, r"([${}])", r"\\$1")
    return F.regexp_replace(F.replace(out, F.lit("\u0000"), F.lit("\\backslash ")), r"[\r\n]+", " ")


def gfm_table(header: Column, rows: Column) -> Column:
    """A table of an array of cells and an array of rows."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, escape_cell), " | "), F.lit(" |\n"))
    return F.concat(line(header), F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(header)), F.lit("\n")), F.array_join(F.transform(rows, line), ""))
