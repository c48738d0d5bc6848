"""Inline text as spans, and spans as Markdown.

A run of inline text is an array of (depth, kind, text, target) in reading order; a span's parent is the nearest one before it that is less deep. Kinds: text, emph, strong, code, math,
link, note. Neighbours that print the same delimiter are one run; a delimiter that could not open and close where it would stand is not printed; white space at the edges moves outside.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<depth:int,kind:string,text:string,target:string>>"
DEPTH = 64


class Node:
    __slots__ = ("children", "kind", "target", "text")

    def __init__(self, kind: str, text: str = "", target: str | None = None):
        self.kind, self.text, self.target, self.children = kind, text, target, []


def tree(spans) -> list[Node]:
    return _tree((s["depth"], s["kind"], s["text"], s["target"]) for s in spans)


def _tree(spans) -> list[Node]:
    root, stack = [], []
    for depth, kind, text, target in spans:
        node = Node(kind, text or "", target)
        while stack and stack[-1][0] >= depth:
            stack.pop()
        (stack[-1][1].children if stack else root).append(node)
        stack.append((depth, node))
    return root


def plain(nodes, notes: bool = False) -> str:
    """The text alone; with ``notes``, references as they are shown."""
    return "".join((f"[^{n.target}]" if notes else "") if n.kind == "note" else n.text + plain(n.children, notes) for n in nodes)


_MARKS = re.compile(r"([\\`*_\[\]<~$])")
_ENTITY = re.compile(r"&(?=#\d+;|#[xX][0-9a-fA-F]+;|[A-Za-z0-9]+;)")
_HEADS = {s: (re.compile(h + r"([#\-+>=|])"), re.compile(h + r"(\d{1,9})([.)])")) for s, h in ((True, r"(?m)^"), (False, r"(?m)(?<=\n)"))}
#: What nothing is to be done about without.
_SPECIAL = re.compile(r"[\\`*_\[\]<~$&\n]").search


def escape_text(text: str, start: bool) -> str:
    """``functions.text.escape_flow`` for a run that may stand in the middle of a line."""
    if not _SPECIAL(text) and (not start or not text or text[0] not in "#-+>=| \t" and not text[0].isdigit()):
        return text
    out = _ENTITY.sub(r"\\&", _MARKS.sub(r"\\\1", text))
    mark, number = _HEADS[bool(start)]
    out = number.sub(r"\1\\\2", mark.sub(r"\\\1", out))
    if start and out and out[0] in " \t":
        out = ("&#32;" if out[0] == " " else "&#9;") + out[1:]
    return out


_ENDS, _TICKS = re.compile(r"[\r\n]+"), re.compile("`+")


def code(text: str) -> str:
    text = _ENDS.sub(" ", text) or " "
    fence = "`" * (max(map(len, _TICKS.findall(text)), default=0) + 1)
    pad = " " if text.strip(" ") and ("`" in text or text[0] == " " or text[-1] == " ") else ""
    return fence + pad + text + pad + fence


@lru_cache(4096)
def _class(c: str) -> str:
    if not c or c.isspace():
        return "space"
    return "mark" if unicodedata.category(c)[0] in "PS" else "word"


def _opens(before: str, first: str) -> bool:
    return _class(first) == "word" or _class(first) == "mark" and _class(before) != "word"


def _delimiter(n: Node) -> str:
    kind = n.kind
    if kind == "text":
        return ""
    if kind in ("emph", "strong"):
        return "*"
    return "`" if kind == "code" or kind == "math" and re.search(r"[$\r\n]", n.text) else ""


def _flat(nodes: list[Node]) -> list[Node]:
    """Without links that lead nowhere: their children stand in their place."""
    for n in nodes:
        if n.kind == "link" and not n.target:
            return [y for n in nodes for y in (_flat(n.children) if n.kind == "link" and not n.target else [n])]
    return nodes


_UNSAFE = re.compile(r'[\x00-\x20\x7f()<>\\"]')


def render(nodes: list[Node], before: str = "", after: str = "", depth: int = 0) -> str:
    """Markdown of a sequence between the characters ``before`` and ``after``."""
    nodes, out, i = _flat(nodes), "", 0
    most = len(nodes)
    while i < most:
        n = nodes[i]
        if n.kind == "text":
            out += escape_text(n.text, not out and not before or out[-1:] == "\n")
            i += 1
            continue
        mark = _delimiter(n)
        j = i + 1
        while mark and j < most and (nodes[j].kind == "text" and not nodes[j].text and not plain(nodes[j].children) or _delimiter(nodes[j]) == mark):
            j += 1
        prior = out[-1:] or before
        if mark == "`":
            out += code(plain(nodes[i:j]))
        elif mark == "*":
            out += _emphasis(nodes[i:j], prior, (nodes[j].text[:1] if j < most and nodes[j].kind == "text" and nodes[j].text else plain(nodes[j : j + 1], True)[:1]) or after, depth)
        elif n.kind == "math":
            out += f"${n.text}$"
        elif n.kind == "note":
            out += f"[^{n.target}]"
        elif n.kind == "link":
            target = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", n.target)
            out += f"[{_ENDS.sub(' ', render(n.children, '[', ']', depth + 1) or escape_text(n.text, False))}]({target})"
        else:
            out += escape_text(n.text, not out and not before or out[-1:] == "\n")
        i = j if mark else i + 1
    return out


def _emphasis(group: list[Node], before: str, after: str, depth: int) -> str:
    kind = group[0].kind
    inner = [y for g in group for y in ([Node("text", g.text)] if g.text else []) + [c for x in g.children for c in (x.children if x.kind == kind else [x])]]
    alone = inner[0] if len(inner) == 1 and inner[0].kind == "text" and not inner[0].children else None  # as it mostly is
    body = alone.text if alone else plain(inner, True)
    core = body.strip()
    if not core or depth > DEPTH:
        return escape_text(body, not before)
    lead, tail = body[: len(body) - len(body.lstrip())], body[len(body.rstrip()) :]
    mark = "**" if kind == "strong" else "*"
    text = (escape_text(body, False) if alone else render(inner, "*", "*", depth + 1)).strip()
    if not text or not _opens(lead[-1:] or before, core[0]) or not _opens(tail[:1] or after, core[-1]):
        return render(inner, before, after, depth + 1)
    return lead + mark + text + mark + tail


#: Rows of a batch whose spans are Python objects at a time.
ROWS = 256


def _markdown(spans: pa.Array, before: str) -> pa.Array:
    """Each row's Markdown. The fields of a slice's spans come as four lists, without an object for each span."""
    out = []
    for at in range(0, len(spans), ROWS):
        part = spans.slice(at, ROWS)
        flat = part.flatten()
        fields = [flat.field(k).to_numpy(zero_copy_only=False).tolist() for k in ("depth", "kind", "text", "target")] if len(flat) else [[]] * 4
        rows = zip(*fields)
        for n in pc.list_value_length(part).to_pylist():
            out.append(None if n is None else render(_tree(islice(rows, n)), before))
    return pa.array(out, pa.string())


def _rendered(spans: pa.Array) -> pa.Array:
    return _markdown(spans, "")


def inline_markdown(spans: Column | str) -> Column:
    """Markdown of an array of spans, as one Arrow round trip a batch."""
    return F.arrow_udf(_rendered, "string")(F.col(spans) if isinstance(spans, str) else spans)


def _rendered_mid(spans: pa.Array) -> pa.Array:
    return _markdown(spans, " ")


def heading_markdown(spans: Column | str) -> Column:
    """The same of spans that follow a heading's marks, on one line."""
    c = F.arrow_udf(_rendered_mid, "string")(F.col(spans) if isinstance(spans, str) else spans)
    return F.regexp_replace(F.regexp_replace(c, r"[\r\n]+", " "), r"(^|[ \t])(#+[ \t]*)$", r"$1\\$2")


def inline_text(spans: Column | str, notes: bool = False) -> Column:
    """The text of an array of spans, inside the JVM; with ``notes``, references as they are shown."""
    c = F.col(spans) if isinstance(spans, str) else spans
    piece = lambda s: F.when(s["kind"] == "note", F.concat(F.lit("[^"), s["target"], F.lit("]")) if notes else F.lit("")).otherwise(F.coalesce(s["text"], F.lit("")))
    return F.array_join(F.transform(c, piece), "")
