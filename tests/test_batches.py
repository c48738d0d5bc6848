"""Batches of Arrow, which have up to ten thousand rows, are worked on in slices."""

import pandas as pd
import pyarrow as pa

from leafmill.functions import inline
from leafmill.sources import containers as C

SPANS = pa.list_(pa.struct([("depth", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("target", pa.string())]))


def test_files_are_sent_on_in_slices():
    parts = list(C.sliced([pd.DataFrame({"x": range(150)}), pd.DataFrame({"x": []}), pd.DataFrame({"x": [7]})]))
    assert [len(p) for p in parts] == [64, 64, 22, 1] and [x for p in parts for x in p["x"]] == [*range(150), 7]


def test_spans_are_rendered_in_slices():
    kinds = ("text", "emph", "code", "link", "note", "math", "strong")
    rows = [None, []] + [[{"depth": j % 2, "kind": "text" if j % 2 else kinds[(k + j) % 7], "text": f" {k}*" if j % 2 else "", "target": "http://x y" if k % 3 else None} for j in range(k % 9)] for k in range(900)]
    want = [None if r is None else inline.render(inline.tree(r)) for r in rows]
    spans = pa.array(rows, SPANS)
    assert inline._rendered(spans).to_pylist() == want
    assert inline._rendered(spans.slice(300, 500)).to_pylist() == want[300:800]
    assert inline._rendered(spans.slice(0, 0)).to_pylist() == []
