"""HTML, of any care, as blocks.

Python's tokenizer never fails, so a stack of open elements is all the recovery there is: a block closes the paragraph before it, a list item the item before it, whatever is left open ends
with the text. Blocks come out flat and in order; inline text as spans.
"""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

from .math import mathml_latex

BLOCK = "ord int, kind string, level int, text string, spans array<struct<depth:int,kind:string,text:string,target:string>>, lang string, ordered boolean, depth int, rows array<array<string>>, has_merged boolean, asset string, caption string, note string, ids array<string>, page int"
NAMES = [x.split()[0] for x in BLOCK.split(", ")]
INLINE = {"em", "i", "strong", "b", "a", "code", "br", "sub", "sup", "small", "u", "s", "span", "img", "math"}
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
_KIND = {"em": "emph", "i": "emph", "strong": "strong", "b": "strong", "code": "code"}
_WS = re.compile(r"[ \t\n\r\f]+")
DEPTH = 64


def block(kind: str, **more) -> dict:
    return dict.fromkeys(NAMES) | {"kind": kind, "text": "", "spans": [], "ids": []} | more


class Blocks(HTMLParser):
    def __init__(self, skip: tuple[str, ...] = ("script", "style", "head"), xml: bool = False):
        super().__init__(convert_charrefs=not xml)
        self.out: list[dict] = []
        self.skip, self.skipping = skip, 0
        self.spans: list[dict] = []
        self.open: list[str] = []
        self.current: dict | None = None
        self.lists: list[bool] = []
        self.table: dict | None = None
        self.row: list[str] | None = None
        self.pre: str | None = None
        self.note: str | None = None
        self.figure: dict | None = None
        self.caption = False
        self.ids: list[str] = []
        self.math: list[str] | None = None
        self.title = ""

    # ---- text of the current block

    def _text(self) -> str:
        return "".join(s["text"] for s in self.spans if s["kind"] != "note")

    def close_block(self) -> None:
        spans, now = self.spans, self.current or block("para")
        text = self._text()
        self.spans, self.current = [], None
        if not text.strip() and not any(s["kind"] in ("note", "math") for s in spans):
            return
        while spans and spans[-1]["kind"] == "text" and not spans[-1]["text"].rstrip(" \t\n\r\f"):
            spans.pop()
        if spans and spans[-1]["kind"] == "text":
            spans[-1]["text"] = spans[-1]["text"].rstrip(" \t\n\r\f")
        now |= {"text": text.strip(), "spans": spans, "ids": self.ids, "note": self.note}
        if self.figure is not None and self.caption:
            self.figure["caption"] = text.strip()
            return
        self.ids = []
        self.out.append(now)

    def handle_starttag(self, tag: str, attrs) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag in self.skip:
            self.skipping += 1
            return
        if self.skipping:
            return
        if self.math is not None:
            self.math.append("<" + tag + "".join(f' {k}="{v}"' for k, v in a.items()) + ">")
            return
        if a.get("id"):
            self.ids.append(a["id"])
        if self.pre is not None:
            if tag == "code" and (m := re.search(r"language-(\S+)", a.get("class", ""))):
                self.lang = m[1]
            return
        if tag == "math":
            self.math = ["<math>"]
            self.display = a.get("display") == "block"
            return
        if self.row is not None and tag not in ("td", "th", "tr", "table"):
            if tag == "br":
                self.handle_data(" ")
            return
        if tag in INLINE:
            if tag == "br":
                self.handle_data(" ")
            elif tag == "img":
                self._image(a)
            elif tag == "a" and "noteref" in a.get("epub:type", "").split():
                self.spans.append({"depth": len(self.open), "kind": "note", "text": "", "target": a.get("href", "").partition("#")[2]})
                self.open.append("noteref")
            elif tag in _KIND or tag == "a" and "href" in a:
                kind = _KIND.get(tag, "link")
                self.spans.append({"depth": min(len(self.open), DEPTH), "kind": kind, "text": "", "target": a.get("href") if kind == "link" else None})
                self.open.append(kind)
            return
        self.open = []
        if tag == "pre":
            self.close_block()
            self.pre, self.lang = "", None
        elif re.fullmatch("h[1-6]", tag):
            self.close_block()
            self.current = block("heading", level=int(tag[1]))
        elif tag in ("ul", "ol"):
            self.close_block()
            self.lists.append(tag == "ol")
        elif tag == "li":
            self.close_block()
            self.current = block("item", ordered=bool(self.lists and self.lists[-1]), depth=max(0, len(self.lists) - 1))
        elif tag == "table":
            self.close_block()
            self.table = block("table", rows=[], has_merged=False)
        elif tag == "tr" and self.table is not None:
            self.row = []
            self.table["rows"].append(self.row)
        elif tag in ("td", "th") and self.table is not None:
            if self.row is None:
                self.row = []
                self.table["rows"].append(self.row)
            self.row.append("")
            self.table["has_merged"] |= any(a.get(k, "1") != "1" for k in ("colspan", "rowspan"))
        elif tag == "figure":
            self.close_block()
            self.figure = block("figure")
        elif tag == "figcaption":
            self.close_block()
            self.caption = True
        elif tag == "aside" and "footnote" in a.get("epub:type", "").split():
            self.close_block()
            self.note = a.get("id", "")
        else:
            self.close_block()
            if tag == "p" and self.lists and self.out and self.current is None:
                self.current = block("item", ordered=self.lists[-1], depth=len(self.lists) - 1)

    def _image(self, a: dict) -> None:
        if self.figure is not None:
            self.figure |= {"asset": a.get("src"), "text": a.get("alt", "")}
        elif self.spans or self.open:
            self.handle_data(a.get("alt", ""))
        elif a.get("src"):
            self.out.append(block("figure", asset=a["src"], text=a.get("alt", ""), caption=a.get("alt", "")))

    def handle_endtag(self, tag: str) -> None:
        if tag in self.skip:
            self.skipping = max(0, self.skipping - 1)
            return
        if self.skipping:
            return
        if self.math is not None:
            self.math.append(f"</{tag}>")
            if tag == "math":
                latex, complete = mathml_latex("".join(self.math))
                self.math = None
                if self.display:
                    self.close_block()
                if not complete:  # the note stands before the block with what was left of the equation
                    self.out.append(block("raw", text="equation partially converted"))
                if self.display:
                    self.out.append(block("math", text=latex))
                else:
                    self.spans.append({"depth": len(self.open), "kind": "math", "text": latex, "target": None})
            return
        if self.pre is not None:
            if tag == "pre":
                self.out.append(block("code", text=self.pre.strip("\n"), lang=self.lang))
                self.pre = None
            return
        if tag in ("table",) and self.table is not None:
            rows = [[_WS.sub(" ", c).strip() for c in r] for r in self.table["rows"]]
            width = max(map(len, rows), default=0)
            self.table["rows"] = [r + [""] * (width - len(r)) for r in rows]
            self.table["text"] = " ".join(c for r in rows for c in r)
            if width:
                self.out.append(self.table)
            self.table = self.row = None
        elif tag == "tr":
            self.row = None
        elif self.row is not None:
            return
        elif tag in _KIND or tag == "a":
            if self.open:
                self.open.pop()
        elif tag in ("ul", "ol"):
            self.close_block()
            if self.lists:
                self.lists.pop()
        elif tag == "figcaption":
            self.close_block()
            self.caption = False
        elif tag == "figure" and self.figure is not None:
            f, self.figure = self.figure, None
            f["caption"] = f["caption"] or f["text"]
            self.out.append(f if f["asset"] else block("raw", text=f"image unavailable: {f['text']}"))
        elif tag == "aside":
            self.close_block()
            self.note = None
        elif tag not in INLINE:
            self.open = []
            self.close_block()

    def handle_entityref(self, name: str) -> None:
        self.handle_data(_NAMED.get(name, f"&{name};"))

    def handle_charref(self, name: str) -> None:
        self.handle_data(unescape(f"&#{name};"))

    def handle_data(self, data: str) -> None:
        if self.skipping:
            return
        if self.math is not None:
            self.math.append(data.replace("&", "&amp;").replace("<", "&lt;"))
        elif self.pre is not None:
            self.pre += data
        elif self.row is not None and self.row:
            self.row[-1] += data
        elif "noteref" not in self.open:
            text = _WS.sub(" ", data)
            if not self.spans or self.spans[-1]["kind"] == "text" and self.spans[-1]["text"].endswith(" "):
                text = text.lstrip(" ")
            if not text:
                return
            last = self.spans[-1] if self.spans else None
            if last and last["kind"] == "text" and last["depth"] == len(self.open):
                last["text"] += text
            else:
                self.spans.append({"depth": min(len(self.open), DEPTH), "kind": "text", "text": text, "target": None})


def blocks(html: str, xml: bool = False) -> list[dict]:
    """The blocks of a page, numbered from 1; in ``xml``, named characters other than its five stay as they are written. Never raises."""
    p = Blocks(xml=xml)
    p.feed(html)
    p.close()
    p.row = None
    p.pre is not None and p.handle_endtag("pre")
    p.table is not None and p.handle_endtag("table")
    p.close_block()
    for k, b in enumerate(p.out, 1):
        b["ord"] = k
    return p.out
