"""Documents and keys that are larger than those of the smallest tables."""

from leafmill import catalog
from leafmill.operators import structure as S


def test_sections_beyond_an_int(spark):
    """Parsed blocks are numbered by an int; a section's number is that times ``SCALE``."""
    rows = [(1, k, "heading", 1 + k % 2, f"H{k}") for k in (1, 2046, 2047, 2048, 5000)] + [(1, 5001, "para", None, "text " * 30)]
    folded = S.fold_sections(spark.createDataFrame(rows, "doc_id long, ord int, kind string, level int, text string"))
    tree, places = S.balanced(folded, 0, 20)
    assert {(r.title, r.section // S.SCALE, r.section % S.SCALE, r.parent // S.SCALE) for r in tree.collect()} == {("H1", 1, 0, 0), ("H2046", 2046, 0, 0), ("H2047", 2047, 0, 2046), ("H2048", 2048, 0, 0), ("H5000", 5000, 0, 0), ("Part 1", 5000, 1, 5000)}
    assert [(r.ord, r.section) for r in places.collect()] == [(5001, 5000 * S.SCALE + 1)]


def test_positions_of_five_digits(spark, tmp_path):
    keys = [0, 31, 32**4 - 1, 32**4, 7 * 32**5 + 3]
    spark.createDataFrame([(k, k % 50) for k in keys], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = catalog.queries()["mob_positions"](spark, str(tmp_path)).collect()
    assert {r.p_partkey: r.out for r in got} == {k: f"{k}:{k % 50}" for k in keys}
