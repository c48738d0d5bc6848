"""Pages as positioned text, of runs that share a place and a number."""

from functools import reduce
from itertools import permutations
from operator import add

import pytest

from leafmill.operators import layout as L
from leafmill.plans.layout_queries import rounded

RUNS = "doc_id long, page long, seq long, x double, y double, size double, text string"
#: Of two runs with one place and one number, only the large one reaches the line above; by size it comes second, by text first.
ABOVE, SMALL, LARGE = (1, 5.0, 700.0, 12.0, "p"), (2, 6.0, 692.0, 10.0, "z"), (2, 6.0, 692.0, 24.0, "a")
CONFS = (73.333333, 70.0, 68.5, 28.166667)


def pages(spark):
    return spark.createDataFrame([(1, k, *r) for k, runs in enumerate(permutations([ABOVE, SMALL, LARGE])) for r in runs], RUNS)


def test_lines_join_runs_in_the_order_that_grouped_them(spark):
    got = L.lines(L.group_lines(pages(spark))).orderBy("page", "line").collect()
    for page in range(6):
        rows = [(r.x, r.y, r.size, r.text) for r in got if r.page == page]
        assert rows in ([(5.0, 700.0, 12.0, "p"), (6.0, 692.0, 24.0, "z a")], [(5.0, 700.0, 24.0, "p a"), (6.0, 692.0, 10.0, "z")])


def test_blocks_hold_lines_that_some_order_of_the_runs_gives(spark):
    body = spark.createDataFrame([(1, 12)], "doc_id long, body long")
    got = L.page_blocks(L.lines(L.group_lines(pages(spark))), body).orderBy("page", "block").collect()
    for page in range(6):
        rows = [(r.kind, r.level, r.text) for r in got if r.page == page]
        assert rows in ([("para", None, "p"), ("heading", 1, "z a")], [("heading", 1, "p a"), ("para", None, "z")])


def test_outcomes_do_not_depend_on_the_order_of_the_lines(spark):
    """Summed as doubles, these confidences of a mean of 60 are below it in some orders."""
    orders = list(permutations(CONFS))
    assert len({reduce(add, x) / 4 >= 60 for x in orders}) == 2
    lines = spark.createDataFrame([(1, k, c, "words") for k, x in enumerate(orders) for c in x], "doc_id long, page long, conf double, text string").coalesce(1)
    got = L.recognition_outcome(lines).collect()
    assert len(got) == 24 and {(r.chars, r.conf, r.outcome) for r in got} == {(20, 60.0, "text")}
    odd = spark.createDataFrame([(1, 1, float("nan"), "words"), (1, 2, 70.0, " "), (1, 3, None, "words")], lines.schema)
    assert {r.page: str(r.conf) for r in L.recognition_outcome(odd).collect()} == {1: "nan", 2: "None", 3: "None"}


def test_rounded_as_sql_rounds(spark):
    duckdb = pytest.importorskip("duckdb")
    means = [(round(a / 7, 6) + round(b / 3, 6)) / 2 for a in range(200) for b in range(200)]
    want = [r[0] for r in duckdb.connect().execute("SELECT round(x, 5) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [means]).fetchall()]
    got = [r.x for r in spark.createDataFrame([(k, x) for k, x in enumerate(means)], "k long, x double").select("k", rounded("x", 5).alias("x")).orderBy("k").collect()]
    assert got == want
