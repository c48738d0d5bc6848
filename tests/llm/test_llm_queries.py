"""The registered queries against their SQL on the smallest tables, and the pipeline on tables of every kind."""

from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline

from leafmill.llm import jaccard, packing, quality, queries, repeats

DIR = Path("/root/testdata/sf0.001")
SQL = queries.oracle_sql()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
there = pytest.mark.skipif(not DIR.exists(), reason="the tables are not here")


def plain(x):
    return None if x is None or x != x else round(float(x), 8) if isinstance(x, float) else x


@there
@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in DIR.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    out = queries.queries()[name](spark, str(DIR))
    names = sorted(out.columns)
    got = Counter(tuple(plain(r[c]) for c in names) for r in out.collect())
    rel = con.sql(SQL[name])
    assert sorted(rel.columns) == names
    assert got == Counter(tuple(plain(r[rel.columns.index(c)]) for c in names) for r in rel.fetchall())


def test_one_query_of_each_number():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries()) == list(range(1, 11))


def tables(spark, folder, docs, labels, schema=DOCS):
    spark.createDataFrame(docs, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def words(rng, n):
    return " ".join(f"w{rng.randrange(500)}" for _ in range(n))


def test_pipeline_against_its_stages_by_hand(spark, tmp_path):
    """Bad text goes, one of each class stays, later occurrences are cut, every word that is left is packed once."""
    import random

    rng = random.Random(4)
    good = [words(rng, 80) for _ in range(40)]
    passage = words(rng, 70)
    docs = [(i, t) for i, t in enumerate(good)] + [(100 + i, "BUY!! $$$ CLICK>>> FREE!!! " * 20 + str(i)) for i in range(40)]
    docs += [(200, good[3]), (201, good[3] + " tail"), (202, words(rng, 30) + " " + passage), (203, words(rng, 40) + " " + passage + " " + words(rng, 20)), (204, None), (205, ""), (206, " \n "), (None, words(rng, 60)), (5, good[5])]
    folder = tables(spark, tmp_path, [(i, t, "en", "s", len(t) if t else None) for i, t in docs], [(i, 1, 0) for i in range(30)] + [(100 + i, 0, 0) for i in range(30)])
    table = spark.read.parquet(f"{folder}/documents.parquet")
    out = table
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, out, folder)
        assert k == 3 or after.columns == table.columns
        rows = after.collect()
        ids = Counter(r.doc_id for r in rows)
        if k == 0:
            assert not {100 + i for i in range(40)} & set(ids) and all(ids[i] for i in [*range(40), 200, 201, 202, 203, 204, 205, 206, None])
        if k == 1:
            assert not {200, 201} & set(ids) and ids[3] == 1 and ids[5] == 2 and all(ids[i] for i in (202, 203, 204, 205, 206, None))
        if k == 2:
            texts = {r.doc_id: r.text for r in rows}
            assert passage in texts[202] and passage not in texts[203] and len(texts[203].split()) == 60 and {r.n_chars for r in rows if r.doc_id == 203} == {len(texts[203])}
            left = Counter()
            for r in rows:
                if r.doc_id is not None and r.text:
                    left[r.doc_id] += len(r.text.split())
        out = after
    packed, fill = Counter(), Counter()
    for r in rows:
        packed[r.doc_id] += r.n_words
        fill[r.bin_id] += r.n_words
    assert packed == +left and max(fill.values()) <= packing.CAPACITY
    whole = corpus_pipeline.run(spark, folder).collect()
    assert Counter(map(tuple, whole)) == Counter(map(tuple, rows))


@pytest.mark.parametrize("docs", [[], [(1, None)], [(1, ""), (1, "")], [(None, "x y z")], [(1, "a"), (1, "b"), (2, "a")], [(1, "x" * 300_000), (2, "w " * 50_000)]])
def test_pipeline_on_odd_tables(spark, tmp_path, docs):
    folder = tables(spark, tmp_path, [(i, t, None, None, None) for i, t in docs], [])
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in rows} <= {i for i, t in docs if i is not None and t and t.strip()}
    assert (not docs or docs[0][1] in (None, "") or docs[0][0] is None) == (not rows)


def test_stages_keep_columns_of_clashing_names(spark):
    names = ["doc_id", "text", "n_chars", "fp", "id", "sig", "grp", "first", "known", "stays", "low", "high", "part", "links"]
    docs = spark.createDataFrame([(i, f"some text of {i} " * 30, i, *(["clash"] * (len(names) - 3))) for i in range(5)] + [(9, "some text of 3 " * 30, 1, *(["clash"] * (len(names) - 3)))], ", ".join(f"{c} {'long' if c in ('doc_id', 'n_chars') else 'string'}" for c in names))
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    for out in (quality.kept(docs, labels), jaccard.one_of_each(docs), repeats.without_repeats(docs)):
        assert out.columns == names and out.count() > 0
    assert jaccard.near_classes(docs).count() == 6 and packing.packed(docs).count() == 6
