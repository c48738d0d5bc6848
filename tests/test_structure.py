"""Documents that span many tasks: what is folded in spans and dealt out by ranges is as if it were one."""

import random

from leafmill.operators import structure as S

BLOCKS = "doc_id long, ord long, kind string, level int, text string"


def tree(doc, n, seed):
    """Blocks of one document, with each one's section and parent told by a stack."""
    rand, rows, want, stack, section = random.Random(seed), [], {}, [], 0
    for o in range(1, n + 1):
        if rand.random() < 0.6:
            level = rand.randint(1, 6)
            while stack and stack[-1][0] >= level:
                stack.pop()
            parent = max((x[1] for x in stack), default=0)
            stack.append((level, o))
            section = o
            rows.append((doc, o, "heading", level, f"T{o % 7}"))
            want[doc, o] = (o, parent)
        else:
            rows.append((doc, o, "para", None, "text"))
            want[doc, o] = (section, None)
    return rows, want


def folded(spark, monkeypatch):
    monkeypatch.setattr(S, "SPAN", 5)
    parts = [tree(d, 60, d) for d in (1, 2)] + [tree(3, 1, 3)]
    rows, want = sum((x[0] for x in parts), []), {k: v for x in parts for k, v in x[1].items()}
    return S.fold_sections(spark.createDataFrame(rows, BLOCKS)), want


def test_a_document_is_folded_in_spans(spark, monkeypatch):
    got, want = folded(spark, monkeypatch)
    assert {(r.doc_id, r.ord): (r.section, r.parent) for r in got.collect()} == want


def test_reading_order_goes_on_from_range_to_range(spark, monkeypatch):
    files = S.assign_paths(S.sections(folded(spark, monkeypatch)[0]))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = S.navigation(files).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for doc in (1, 2, 3):
        own = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.ordinal_path)
        assert [r.reading for r in own] == list(range(1, len(own) + 1)) and [r.section for r in own] == sorted(r.section for r in own)
        assert [r.prev is None for r in own] == [k == 0 for k in range(len(own))] and [r.next is None for r in own] == [k == len(own) - 1 for k in range(len(own))]
        for r in own:
            assert r.children == [k.path for k in own if k.parent == r.section]
            assert all(k.path.startswith(r.path.removesuffix("index.md")) and k.ordinal_path[:-1] == r.ordinal_path for k in own if k.parent == r.section)


def test_no_window_holds_the_children_of_a_section_in_every_row(spark, monkeypatch):
    files = S.toc(S.assign_paths(S.sections(folded(spark, monkeypatch)[0])))
    for df in (files, S.navigation(files)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert not [x for x in plan.split("\n") if "collect_list" in x and "windowspec" in x]
