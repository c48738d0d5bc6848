"""Every registered query with SQL gives DuckDB's rows on the smallest tables; those without give some."""

from collections import Counter
from pathlib import Path

import pytest

from leafmill import catalog

DIR = Path("/root/testdata/sf0.001")
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in DIR.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if x is None or x != x:
        return None
    return round(float(x), 8) if isinstance(x, float) else x


@pytest.mark.skipif(not DIR.exists(), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    out = QUERIES[name](spark, str(DIR))
    names = sorted(out.columns)
    got = Counter(tuple(plain(r[c]) for c in names) for r in out.collect()) if name in SQL else out.count()
    if name not in SQL:
        assert got > 0
        return
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == names
    want = Counter(tuple(plain(r[rel.columns.index(c)]) for c in names) for r in rel.fetchall())
    assert got == want


@pytest.mark.skipif(not DIR.exists(), reason="the tables are not here")
def test_every_file_is_linked(spark):
    """The customers' files, which grow with the data, are linked too."""
    paths = {(r.doc_id, r.path) for r in QUERIES["core_assign_paths"](spark, str(DIR)).collect()}
    rows = QUERIES["core_relativize"](spark, str(DIR)).collect()
    assert {(r.doc_id, r.source) for r in rows} == {(r.doc_id, r.target) for r in rows} == paths and len(paths) > 30
