"""MathML and Office math as LaTeX. What has no counterpart becomes a placeholder, and the result is marked as partial."""

from __future__ import annotations

import xml.etree.ElementTree as ET

MOST_BYTES, MOST_DEPTH = 256 << 10, 128
_SYMBOLS = dict(zip("αβγδθλμπσφω≤≥≠≈×÷±⋅∈∞→∂∑∏∫∮⋃⋂√", r"\alpha \beta \gamma \delta \theta \lambda \mu \pi \sigma \phi \omega \leq \geq \neq \approx \times \div \pm \cdot \in \infty \to \partial \sum \prod \int \oint \bigcup \bigcap \surd".split()))
_ACCENTS = {"^": "hat", "ˆ": "hat", "̂": "hat", "¯": "bar", "‾": "bar", "̅": "bar", "→": "vec", "⃗": "vec", "~": "tilde", "̃": "tilde", "˙": "dot", "̇": "dot"}
_FENCES = {"⟨": r"\langle", "⟩": r"\rangle", "{": r"\{", "}": r"\}", "": "."}
_NARY = "∑∏∫∮⋃⋂"


class _State:
    complete = True


def _name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2].rpartition(":")[2] if isinstance(e.tag, str) else ""


def _attr(e: ET.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2].rpartition(":")[2] == name), None)


def _chars(text: str, s: _State) -> str:
    out = []
    for c in text.strip():
        if c in _SYMBOLS:
            out.append(_SYMBOLS[c] + " ")
        elif c in "${}":
            out.append("\\" + c)
        elif c == "\\":
            out.append(r"\backslash ")
        elif c.isspace():
            out.append(" ")
        elif ord(c) < 128:
            out.append(c)
        else:
            s.complete = False
            out.append(r"\mathord{?}")
    return "".join(out).strip()


def _wrong(s: _State) -> str:
    s.complete = False
    return r"\mathord{?}"


def _row(parts) -> str:
    return " ".join(p for p in parts if p)


def _mathml(e: ET.Element, s: _State, depth: int = 0) -> str:
    if depth > 64:
        return _wrong(s)
    kids, go = list(e), lambda x: _mathml(x, s, depth + 1)
    match _name(e), len(kids):
        case ("mi" | "mn" | "mo" | "ms", _):
            return _chars("".join(e.itertext()), s)
        case ("mtext", _):
            return "\\text{" + _chars("".join(e.itertext()), s) + "}"
        case ("mspace" | "annotation" | "annotation-xml" | "none" | "mprescripts", _):
            return ""
        case ("math" | "mrow" | "mstyle" | "mpadded" | "mphantom" | "semantics" | "merror" | "mtd", _):
            return _row(map(go, kids)) or _chars(e.text or "", s)
        case ("mfrac", 2):
            return f"\\frac{{{go(kids[0])}}}{{{go(kids[1])}}}"
        case ("msup", 2):
            return f"{{{go(kids[0])}}}^{{{go(kids[1])}}}"
        case ("msub" | "munder", 2):
            return f"{{{go(kids[0])}}}_{{{go(kids[1])}}}"
        case ("mover", 2):
            mark = _ACCENTS.get("".join(kids[1].itertext()).strip())
            return f"\\{mark}{{{go(kids[0])}}}" if mark else f"{{{go(kids[0])}}}^{{{go(kids[1])}}}"
        case ("msubsup" | "munderover", 3):
            return f"{{{go(kids[0])}}}_{{{go(kids[1])}}}^{{{go(kids[2])}}}"
        case ("msqrt", _):
            return f"\\sqrt{{{_row(map(go, kids))}}}"
        case ("mroot", 2):
            return f"\\sqrt[{go(kids[1])}]{{{go(kids[0])}}}"
        case ("mfenced", _):
            left, right = (_FENCES.get(x, x) for x in (e.get("open", "("), e.get("close", ")")))
            return f"\\left{left} {(e.get('separators', ',')[:1] + ' ').join(map(go, kids))} \\right{right}"
        case ("mtable", _):
            return "\\begin{pmatrix}" + r" \\ ".join(" & ".join(map(go, r)) for r in kids) + "\\end{pmatrix}"
        case _:
            return _wrong(s)


def _omml(e: ET.Element, s: _State, depth: int = 0) -> str:
    if depth > 64:
        return _wrong(s)
    name, kids = _name(e), [k for k in e if not _name(k).endswith("Pr")]
    part = lambda n: _row(_omml(k, s, depth + 1) for x in kids if _name(x) == n for k in x)
    prop = lambda n: next((_attr(k, "val") for x in e if _name(x).endswith("Pr") for k in x if _name(k) == n), None)
    match name:
        case "r":
            return _chars("".join(t.text or "" for t in e.iter() if _name(t) == "t"), s)
        case "t":
            return _chars(e.text or "", s)
        case "f":
            return f"\\frac{{{part('num')}}}{{{part('den')}}}"
        case "sSup":
            return f"{{{part('e')}}}^{{{part('sup')}}}"
        case "sSub":
            return f"{{{part('e')}}}_{{{part('sub')}}}"
        case "sSubSup":
            return f"{{{part('e')}}}_{{{part('sub')}}}^{{{part('sup')}}}"
        case "rad":
            return f"\\sqrt[{part('deg')}]{{{part('e')}}}" if part("deg") else f"\\sqrt{{{part('e')}}}"
        case "d":
            left, right, by = (x if x is not None else y for x, y in ((prop("begChr"), "("), (prop("endChr"), ")"), (prop("sepChr"), ",")))
            inner = f"{by} ".join(_row(_omml(k, s, depth + 1) for k in x) for x in kids if _name(x) == "e")
            return f"\\left{_FENCES.get(left, left)} {inner} \\right{_FENCES.get(right, right)}"
        case "nary":
            return f"{_chars(prop('chr') or '∫', s)}_{{{part('sub')}}}^{{{part('sup')}}} {part('e')}"
        case "m":
            return "\\begin{pmatrix}" + r" \\ ".join(" & ".join(_row(_omml(k, s, depth + 1) for k in c) for c in r) for r in kids) + "\\end{pmatrix}"
        case "acc":
            return f"\\{_ACCENTS.get(prop('chr') or '^', 'hat')}{{{part('e')}}}"
        case "oMath" | "oMathPara" | "e" | "num" | "den" | "sup" | "sub" | "deg" | "box" | "mr" | "math":
            return _row(_omml(k, s, depth + 1) for k in kids)
        case _:
            return _wrong(s)


def _converted(xml: str, f) -> tuple[str, bool]:
    if len(xml.encode()) > MOST_BYTES:
        return "equation too large to convert", False
    try:
        root = ET.fromstring(xml.replace("&nbsp;", " "))
    except ET.ParseError:
        return "malformed equation markup", False
    s = _State()
    return f(root, s), s.complete


def mathml_latex(xml: str) -> tuple[str, bool]:
    return _converted(xml, _mathml)


def omml_latex(xml: str) -> tuple[str, bool]:
    return _converted(xml, _omml)
