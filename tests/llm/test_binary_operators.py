"""Archives, transport streams, URL rules and vectors against brute force and round trips, with the cases that data brings."""

import base64
import gzip
import hashlib
import random
import re
from pathlib import Path

import numpy as np
import pytest

from leafmill.llm import arc, metricjoin, mpegts, urlrules

# ---------------------------------------------------------------- vectors


def vectors(seed=3, n=220, dim=8):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(20, dim))
    rows = [(i, (base[i % 20] + rng.normal(size=dim) * (0.05 if i % 3 else 0.6)).astype(np.float32).tolist(), 0) for i in range(n)]
    same = rows[4][1]
    return rows + [(500, same, 0), (501, same, 0), (4, same, 9), (502, [0.0] * dim, 0), (503, [-0.0] * dim, 0), (510, None, 0), (511, [], 0), (512, [float("nan")] * dim, 0), (513, [1.0, None] * (dim // 2), 0), (None, same, 0), (520, [1.0, 2.0], 0), (521, [1.0, 2.1], 0)]


def usable(rows):
    """The different (id, vector) of rows."""
    return sorted({(i, tuple(np.array(v, np.float32).astype(float) + 0.0)) for i, v, _ in rows if i is not None and v and all(x is not None and x == x for x in v)})


def distance(a, b):
    return float(np.sqrt(((np.array(a) - np.array(b)) ** 2).sum())) if len(a) == len(b) else float("inf")


def brute_classes(items, radius):
    """Of each item, (id, lowest id of its class, links)."""
    near = [[k for k, y in enumerate(items) if k != i and distance(x[1], y[1]) <= radius] for i, x in enumerate(items)]
    out, seen = [], {}
    for i in range(len(items)):
        if i not in seen:
            open_, found = [i], {i}
            while open_:
                for k in near[open_.pop()]:
                    if k not in found:
                        found.add(k)
                        open_.append(k)
            seen |= dict.fromkeys(found, min(items[k][0] for k in found))
        out.append((items[i][0], seen[i], len(near[i])))
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("radius,cell,part", [(0.3, 16, 16_384), (0.3, 4096, 16_384), (1.5, 32, 5), (0.0, 16, 16_384), (0.3, 40, 7)])
def test_near_classes(spark, monkeypatch, radius, cell, part):
    monkeypatch.setattr(metricjoin, "PART", part)
    rows = vectors() + [(600 + k, vectors()[7][1], 0) for k in range(5)] + [(30, [9.0] * 8, 0), (31, [9.0] * 7 + [9.01], 0), (30, [9.0] * 7 + [9.02], 0)]
    items = usable(rows)
    got = sorted(tuple(r) for r in metricjoin.near_classes(spark.createDataFrame(rows, VECTORS), radius=radius, cell=cell).select("vec_id", "class_id", "n_links").collect())
    assert got == brute_classes(items, radius)
    pairs = sorted((r.vec_a, r.vec_b, round(r.distance, 6)) for r in metricjoin.near_vectors(spark.createDataFrame(rows, VECTORS), radius=radius, cell=cell).collect())
    first = {}
    for i, v in items:
        first.setdefault(v, i)
    reps = sorted((i, v) for v, i in first.items())
    assert pairs == sorted((a[0], b[0], round(distance(a[1], b[1]), 6)) for k, a in enumerate(reps) for b in reps[k + 1 :] if distance(a[1], b[1]) <= radius)


def test_planted_vectors_at_production_parameters(spark):
    """Near vectors across cells, and a hot class, among vectors without structure: 64 dimensions, the radius and the cells of the registered query."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(9000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    step = rng.normal(size=(3000, 64))
    step *= rng.uniform(0.05, 0.295, 3000)[:, None] / np.linalg.norm(step, axis=1)[:, None]
    hot = x[0] + rng.normal(size=(1500, 64)) * 0.012
    x = np.concatenate([x, x[:3000] + step, hot]).astype(np.float32)
    rows = metricjoin.near_classes(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).toPandas().sort_values("vec_id")
    y = x.astype(float)
    near = ((y * y).sum(1)[:, None] + (y * y).sum(1) - 2 * y @ y.T) <= 0.09
    assert (rows.n_links.to_numpy() == near.sum(1) - 1).all() and rows.n_links.sum() > 2 * 3000
    assert all(rows.class_id.to_numpy()[9000:12000] <= np.arange(3000)) and set(rows.class_id[12_000:]) == {0}


def test_sql_of_classes(spark):
    """The registered SQL at a radius at which the smallest tables have links, against the operator."""
    duckdb = pytest.importorskip("duckdb")
    path = Path("/root/testdata/sf0.001/embeddings.parquet")
    if not path.exists():
        pytest.skip("the tables are not here")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}'")
    sql = (Path(metricjoin.__file__).parent / "sql" / "op7_near_vectors.sql").read_text()
    assert "<= 0.3" in sql
    want = sorted(con.sql(sql.replace("<= 0.3", "<= 1.08")).fetchall())
    got = metricjoin.near_classes(spark.read.parquet(str(path)), radius=1.08, cell=64)
    assert sorted(tuple(r) for r in got.select("vec_id", "class_id", "n_links").collect()) == want and sum(n for *_, n in want) > 20


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, cell string, first string")
    assert metricjoin.near_vectors(none).count() == metricjoin.near_classes(none).count() == 0


# ---------------------------------------------------------------- URL rules


def test_rules_find_what_all_expressions_find(spark):
    rng = random.Random(4)
    urls = [f"http{rng.choice(('', 's'))}://{rng.choice(('a', 'www', 'm'))}.{rng.choice(('ads', 'shop', 'news'))}.example.{rng.choice(('com', 'org'))}/{rng.choice(('en', 'de', 'x-y', ''))}/{rng.randrange(99)}{rng.choice(('', '?ref=x', '?id=1&ref=x', '#top', '.html'))}" for _ in range(300)]
    rows = [(i, u) for i, u in enumerate(urls)] + [(900, None), (901, ""), (None, urls[0]), (3, urls[3]), (902, "HTTP://ADS.EXAMPLE.COM/" + "a" * 50_000), (903, "no url at all"), (904, "http://ads.example.com")]
    rules = ["||ads.example.com^", "|https://www.", "&ref=x|", "/en/*.html|", "||example.org^", "@@||news.example.org^", "x-y", "*ref*", "/\\/\\d{2}$/", "||ads.example.com^", "sho", "/\\/(en|de)\\/\\d+(?:[?#.]|$)/", "/(?:shop|news)\\.example\\.(com|org)/"]
    made = [urlrules.compiled(r, k) for k, r in enumerate(rules)]
    out = urlrules.filtered(spark.createDataFrame([(i, u, "t", "l", 1) for i, u in rows], "page_id long, url string, token string, low string, rule_id int"), rules).collect()
    assert len(out) == len(rows)
    for r in out:
        hits = [m for m in made if r.url and re.search(m.pattern, r.url.lower())]
        assert list(r.rules) == [m.rule_id for m in hits]
        assert r.blocked == (any(not m.allow for m in hits) and not any(m.allow for m in hits))
    assert made[0].tokens == [["ads", "com", "example"]] and made[6].tokens == [[]] and made[10].tokens == [[]]
    with pytest.raises(ValueError):
        urlrules.compiled("||*^", 0)


def test_tokens_of_expressions():
    found = urlrules.expression_tokens
    assert found(r"/(?:en|de)/\d{1,2}(?:[?#]|$)") == [["en"], ["en"], ["de"], ["de"]]
    assert found(r"^https://www\.[a-z]+\.example\.com/en/\d+$") == [["com", "en", "example", "https", "www"]]
    assert found(r"/ab?c/") == [[]] and found(r"x-(one|two)y-") == [["oney"], ["twoy"]] and found(r"/one(/two)?/three/") == [["three"]] and found(r"a.b") == [[]] and found("(") == [[]]
    assert found("/" + "(a|b)" * 9 + "/") == [[]]
    assert all(all(r.tokens) for r in (urlrules.compiled(x, k) for k, x in enumerate(urlrules.RULES)))  # no rule runs on every URL


def test_no_urls_no_rules(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    some = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert urlrules.filtered(none).count() == 0
    assert [tuple(r) for r in urlrules.filtered(some, []).collect()] == [(1, "http://a.b/c", False, [])]


# ---------------------------------------------------------------- archives


def test_both_versions_give_equal_records():
    rows = [("http://a.org/x y", "1.2.3.4", "20010203040506", "text/html", b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nbody\n\nmore"), ("dns:a.org", "0.0.0.0", "20010203", "text/dns", b"a.org 1"), ("http://a.org/raw", "-", "20011303040506", "text/plain", b""), ("ftp://a.org/z", "1.2.3.4", "20010203040506", "no-type", b"x" * 10_000)]
    one, two = (list(arc.records(arc.archive_bytes("n.arc", v, "20010101000000", rows))) for v in (1, 2))
    assert [r[1:] for r in one] == [r[1:] for r in two] and len(one) == 5
    assert [r.warc_type for r in one] == ["warcinfo", "response", "resource", "resource", "resource"]
    assert one[1].warc_date == "2001-02-03T04:05:06Z" and one[2].warc_date == "2001-02-03T00:00:00Z" and one[3].warc_date is None
    assert one[1].payload_digest == "sha1:" + base64.b32encode(hashlib.sha1(b"body\n\nmore").digest()).decode() and one[2].ip_address is None and one[3].content_length == 0
    assert [r.block for r in one[1:]] == [b for *_, b in rows]
    assert len({r.record_id for r in one}) == 5
    again = arc.archive_bytes("n.arc", 1, "20010101000000", [rows[0], rows[0]])
    assert len({r.record_id for name in ("a", "b") for r in arc.records(again, name)}) == 6


def test_damaged_and_compressed_archives():
    whole = arc.archive_bytes("n.arc", 1, "20010101000000", [(f"http://a.org/{i}", "1.2.3.4", "20010203040506", "text/html", b"HTTP/1.0 200 OK\n\nx" * 9) for i in range(5)])
    cut = list(arc.records(whole[:-40]))
    assert len(cut) == 6 and cut[-1].truncated and not any(r.truncated for r in cut[:-1])
    assert [r[1:] for r in arc.records(gzip.compress(whole[:300]) + gzip.compress(whole[300:]))] == [r[1:] for r in arc.records(whole)]
    assert list(arc.records(b"")) == [] and list(arc.records(b"nonsense\nline 2\n")) == []
    assert [r[1:] for r in arc.records(whole.replace(b"\nhttp://a.org/2 ", b"\njunk between\nhttp://a.org/2 "))] == [r[1:] for r in arc.records(whole)]
    data = arc.warc_bytes(cut[1])
    head, block = data.split(b"\r\n\r\n", 1)
    assert head.startswith(b"WARC/1.0\r\nWARC-Type: response") and b"Content-Length: %d" % cut[1].content_length in head and block[: cut[1].content_length] == cut[1].block
    assert gzip.decompress(arc.warc_bytes(cut[1], compressed=True)) == data


def test_archive_tables(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.org/", "<p>é</p>", "x"), (2, "http://b.org/", None, "x"), (3, None, "x", "x"), (None, "http://c.org", "x", "x"), (1, "http://a.org/", "<p>é</p>", "x"), (70, "http://d.org/", "z" * 300_000, "x")], "page_id long, url string, html string, content string")
    made = arc.page_archives(pages)
    rows = arc.converted(made, with_record=True).collect()
    assert sum(r.warc_type == "response" for r in rows) == 4 and sum(r.warc_type == "warcinfo" for r in rows) == 2
    assert all(len(r.record) > r.content_length for r in rows)
    odd = spark.createDataFrame([("a", None, 1), ("b", bytearray(), 1), (None, bytearray(b"x"), 1)], "archive string, content binary, offset int")
    assert arc.converted(odd).count() == 0 and arc.converted(odd.where("false")).count() == 0 and arc.page_archives(pages.where("false")).count() == 0
    for r in made.collect():
        (tmp_path / r.archive).write_bytes(r.content)
    assert arc.converted(arc.read_archives(spark, str(tmp_path))).count() == len(rows)


# ---------------------------------------------------------------- transport streams


def stream(units=None, **more):
    units = units or [b"first", b"x" * 2000, b"", b"y" * 183, bytes(range(256)) * 3]
    return units, mpegts.mux(units, [90_000 * k + (1 << 32) for k in range(len(units))], [k % 2 == 0 for k in range(len(units))], **more)


def view(data):
    return np.frombuffer(data, np.uint8)


def test_round_trip_of_units():
    rng = random.Random(1)
    for n in range(60):
        units, data = stream([rng.randbytes(rng.choice((0, 1, 100, 153, 154, 155, 156, 157, 168, 169, 170, 183, 184, 185, 400, 5000))) for _ in range(rng.randint(1, 6))])
        s = mpegts.demux(view(data))
        assert [u.data for u in s.units] == units and len(data) % 188 == 0
        assert [u.pts for u in s.units] == [90_000 * k + (1 << 32) for k in range(len(units))] and [u.random_access for u in s.units] == [k % 2 == 0 for k in range(len(units))]
        assert s[:5] == (len(data) // 188, 0, 0, 0, 0) and not any(u.broken for u in s.units)


def test_losses_repeats_and_noise():
    units, data = stream()
    packets = [data[i : i + 188] for i in range(0, len(data), 188)]
    lost = mpegts.demux(view(b"".join(packets[:5] + packets[6:])))
    assert lost.discontinuities == 1 and [u.broken for u in lost.units] == [False, True, False, False, False]
    twice = mpegts.demux(view(b"".join(packets[:5] + [packets[4]] + packets[5:])))
    assert twice.duplicates == 1 and twice.discontinuities == 0 and [u.data for u in twice.units] == units
    noisy = mpegts.demux(view(b"\x47junk" + b"".join(packets[:4]) + b"noise" * 7 + b"".join(packets[4:]) + b"tail"))
    assert [u.data for u in noisy.units] == units and noisy.skipped_bytes == 5 + 35 + 4
    bad = bytearray(data)
    bad[20] ^= 1
    assert mpegts.demux(view(bytes(bad))).bad_sections == 1 and mpegts.demux(view(bytes(bad))).units == []
    told = bytearray(b"".join(packets[:5] + packets[6:]))
    told[5 * 188 + 3] = told[5 * 188 + 3] & 0x0F | 0x30  # a field that says the counter jumps
    told[5 * 188 + 4], told[5 * 188 + 5] = 1, 0x80
    assert mpegts.demux(view(bytes(told))).discontinuities == 0
    for junk in (b"", b"G", b"x" * 1000, b"G" * 188 * 5, bytes(188)):
        assert mpegts.demux(view(junk)).units == []


def test_media_columns(spark):
    units, data = stream()
    df = spark.createDataFrame([(1, bytearray(data), "x"), (2, None, "x"), (3, bytearray(), "x"), (4, bytearray(b"junk" * 100), "x"), (None, bytearray(data), "x"), (1, bytearray(data), "x")], "doc_id long, media binary, unit string")
    rows = mpegts.elementary_units(df, with_data=True).collect()
    assert len(rows) == 15 and {r.doc_id for r in rows} == {1, None} and sorted({bytes(r.data) for r in rows}) == sorted(set(units))
    assert all(r.digest == hashlib.md5(r.data).hexdigest() and r.n_bytes == len(r.data) for r in rows)
    summary = {r.doc_id: r for r in mpegts.stream_summary(df).collect()}
    assert summary[2].packets is None and summary[3].packets == 0 and summary[4].skipped_bytes == 400 and summary[1].units == 5 and summary[1].random_access_points == 3
    assert mpegts.elementary_units(df.where("false")).count() == mpegts.stream_summary(df.where("false")).count() == 0
    texts = spark.createDataFrame([(1, "a\nbb\n"), (2, None), (3, ""), (4, "long " * 60_000)], "doc_id long, text string")
    got = {}
    for r in mpegts.elementary_units(mpegts.text_streams(texts), with_data=True).orderBy("doc_id", "unit").collect():
        got.setdefault(r.doc_id, []).append(bytes(r.data).decode())
    assert {k: "\n".join(v) for k, v in got.items()} == {1: "a\nbb\n", 3: "", 4: "long " * 60_000}
