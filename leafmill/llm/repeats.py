"""Exact repeated passages by suffix arrays over shards.

A passage is a run of at least ``length`` words that occurs more than once in the corpus. Every run of ``length`` words has an
owner: its smallest ``gram``-word hash (the leftmost of equals), those aside that very many places have: only a run of nothing else has one of them. Equal runs have equal owners, so the corpus is cut into
*contexts* - the words of all runs that one owner position has - and sharded by the owner's hash; any two equal runs meet in one
shard. Contexts whose owner occurs nowhere else cannot hold a repeat and go no further; equal contexts are held once and
remember their copies. Each shard's distinct contexts are then concatenated, their suffix array is induced (``sais``), and the
permuted longest common prefixes cut it where neighbours share fewer than ``length`` words: what stays together is one run, and
its first occurrence is the one with the lowest (doc_id, position).

No text is shuffled before it is known to share an owner, no document is compared with another, and a passage that thousands
share costs one row for each. However many share one, between whatever words: what surrounds it has other owners, its own contexts are equal, and of
equal contexts a task sends one to their owner; the others are joined to what became of that one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import swept
from .common import BROADCAST_BYTES, Grams, buckets_for, byte_views, checked_join, documents, lean, saved, signed, told_apart, trim, words
from .sais import permuted_lcp, suffix_array

LENGTH, GRAM = 50, 16
#: A gram is hot from so many places on, of those that a task told of as it had it ``TOLD`` times; the most frequent ``HOTTEST`` are kept. Whichever are, the result is the same.
HOT, TOLD, HOTTEST = 2000, 8, 1 << 18
_FLUSH = 1_000_000
_ANCHOR = np.dtype([("owner", "i8"), ("context", "i8"), ("doc_id", "i8"), ("at", "i4"), ("runs", "i4"), ("n", "i4")])
_GROUPED = "shared boolean, is_copy boolean, owner long, context long, doc_id long, at int, runs int, first_doc long, first_at int"
_CONTEXT = "shard int, doc_id long, at int, runs int, words binary"
_PIECE = "doc_id long, at int, offset int, runs int, first_doc long, first_start int"


def owners(hashes: np.ndarray, length: int, gram: int, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner hash, context hash, first run, number of runs) of each owner position of a text; empty if it has no run of ``length`` words."""
    n, width = len(hashes), length - gram + 1
    if n < length:
        z = np.zeros(0, np.int64)
        return z.view(np.uint64), z.view(np.uint64), z, z
    grams = Grams(hashes)
    g = grams.every(gram)
    rank = g >> np.uint64(1)
    if hot is not None and len(hot):  # sorted; what is hot comes after all else
        rank |= (hot[np.minimum(np.searchsorted(hot, g), len(hot) - 1)] == g).astype(np.uint64) << np.uint64(63)
    best, span = np.arange(len(g)), 1
    while span < width:  # leftmost smallest of `span` grams from each position on, doubling
        step = min(span, width - span)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(rank[b] < rank[a], b, a)
        span += step
    first = np.flatnonzero(np.r_[True, best[1:] != best[:-1]])
    runs = np.diff(np.r_[first, len(best)])
    place = best[first]
    context = grams.of(first, first + runs + length - 1) + (place - first).astype(np.uint64)
    return g[place], context, first, runs


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, start_word, n_words, first_doc_id, first_start_word): each maximal passage whose runs of ``length`` words occur
    earlier in the corpus, in one place, by (doc_id, position); words are counted from 0.

    Rows without id or text, and texts of fewer than ``length`` words, have no passage. Repeated rows are one document; other texts that share a doc_id are documents of their own, of
    which that of the lowest hash stands in the id's place and the others come after all. A text may repeat itself: the earlier position is the first. An empty table gives an empty
    result. Other columns are ignored, whatever their names.
    """
    docs, names = told_apart(documents(df, id_col, text_col))
    found = _passages(docs, length, gram, hot)
    if names is None:
        return found
    for c in ("doc_id", "first_doc_id"):
        found = checked_join(found, names.select(F.col("id").alias(c), F.col("doc_id").alias("name")), c, "left").withColumn(c, F.coalesce("name", c)).drop("name")
    return found.select("doc_id", "start_word", "n_words", "first_doc_id", "first_start_word")


def _hot_grams(docs: DataFrame, length: int, gram: int, hot: int) -> np.ndarray:
    """The grams that occur in ``hot`` places or more, in order."""

    def count(batches):
        held, size = [], 0
        for b in batches:
            for data in byte_views(b.column(1)):
                h, _, _ = words(data)
                if len(h) >= length:
                    held.append(Grams(h).every(gram))
                    size += len(held[-1])
                if size >= 4 * _FLUSH:
                    yield _told(held, min(TOLD, hot))
                    held, size = [], 0
        if held:
            yield _told(held, min(TOLD, hot))

    counted = docs.mapInArrow(lean(count), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= hot)
    return np.sort(counted.orderBy(F.desc("n"), "gram").limit(HOTTEST).select("gram").toArrow().column(0).to_numpy().view(np.uint64))


def _told(held: list[np.ndarray], least: int) -> pa.RecordBatch:
    g = np.concatenate(held)
    g.sort()
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    n = np.diff(np.r_[first, len(g)])
    often = n >= least
    return pa.RecordBatch.from_arrays([pa.array(signed(g[first[often]])), pa.array(n[often].astype(np.int64))], names=["gram", "n"])


def _passages(docs: DataFrame, length: int, gram: int, hot: int = HOT) -> DataFrame:
    n_buckets = buckets_for(docs, 4 << 20)
    known = docs.sparkSession.sparkContext.broadcast(_hot_grams(docs, length, gram, hot))  # at most HOTTEST * 8 bytes

    def anchors(batches):
        held, size = [], 0
        for b in batches:
            for doc, data in zip(b.column(0).to_numpy(zero_copy_only=False), byte_views(b.column(1))):
                h, _, _ = words(data)
                owner, context, first, runs = owners(h, length, gram, known.value)
                if len(first):
                    rows = np.empty(len(first), _ANCHOR)
                    rows["owner"], rows["context"], rows["doc_id"], rows["at"], rows["runs"] = signed(owner), signed(context), doc, first, runs
                    held.append(rows)
                    size += len(rows)
                if size >= _FLUSH:
                    yield _packed(np.concatenate(held), n_buckets)
                    held, size = [], 0
        if held:
            yield _packed(np.concatenate(held), n_buckets)

    def unpack(batches):
        for b in batches:
            for x in b.column(0):
                rows = np.frombuffer(x.as_buffer(), _ANCHOR)
                names = ("owner", "context", "doc_id", "at", "runs")
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[k])) for k in names], names=names)

    def group(key, table):
        rows = np.concatenate([np.frombuffer(x.as_buffer(), _ANCHOR) for c in table.column("rows").chunks for x in c])
        out = pa.Table.from_batches([_grouped(rows)])
        trim()
        return out

    packed = saved(docs.mapInArrow(lean(anchors), "bucket int, rows binary"))
    grouped = saved(packed.where("bucket >= 0").groupBy("bucket").applyInArrow(group, _GROUPED))
    swept(docs.sparkSession)  # the anchors that were shuffled
    firsts = grouped.where("NOT is_copy").select("owner", "context", "shared", F.col("doc_id").alias("first_doc"), F.col("at").alias("first_at"))
    again = packed.where("bucket < 0").select("rows").mapInArrow(unpack, "owner long, context long, doc_id long, at int, runs int")
    again = checked_join(again, firsts, ["owner", "context"]).where("doc_id <> first_doc OR at <> first_at")
    columns = ["shared", "doc_id", "at", "runs", "first_doc", "first_at"]
    copies = saved(grouped.where("is_copy").select(*columns).unionByName(again.select(*columns)).distinct())

    wanted = grouped.where("shared AND NOT is_copy").select("doc_id", F.struct("owner", "at", "runs").alias("c")).groupBy("doc_id").agg(F.collect_list("c").alias("contexts"))
    ids = saved(grouped.where("shared AND NOT is_copy").select("doc_id").distinct())
    texts = checked_join(docs, ids, "doc_id", row_bytes=24).join(wanted.hint("merge"), "doc_id")

    def cut(batches):
        for b in batches:
            out = {k: [] for k in ("shard", "doc_id", "at", "runs", "words")}
            for doc, data, row in zip(b.column(0).to_pylist(), byte_views(b.column(1)), b.column(2)):
                h, _, _ = words(data)
                c = row.values
                owner = c.field("owner").to_numpy(zero_copy_only=False).view(np.uint64)
                for o, at, runs in zip(((owner >> np.uint64(11)) % np.uint64(n_buckets)).tolist(), c.field("at").to_pylist(), c.field("runs").to_pylist()):
                    if at + runs + length - 1 <= len(h):
                        for k, v in zip(out, (o, doc, at, runs, h[at : at + runs + length - 1].tobytes())):
                            out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["shard"], pa.int32()), pa.array(out["doc_id"], pa.int64()), pa.array(out["at"], pa.int32()), pa.array(out["runs"], pa.int32()), pa.array(out["words"], pa.binary())], names=list(out))

    def shard(key, table):
        out = pa.Table.from_batches([_pieces(table, length)])
        trim()
        return out

    pieces = saved(texts.select("doc_id", "text", "contexts").mapInArrow(lean(cut), _CONTEXT).groupBy("shard").applyInArrow(shard, _PIECE))

    # a first context keeps what is new in it; a copy of it has all from elsewhere: from where the first context has it, or from that context
    own = pieces.where("first_doc <> doc_id OR first_start <> at + offset").select("doc_id", (F.col("at") + F.col("offset")).alias("start"), "runs", "first_doc", "first_start")
    plain = copies.where("NOT shared").select("doc_id", F.col("at").alias("start"), "runs", "first_doc", F.col("first_at").alias("first_start"))
    p = pieces.select(F.col("doc_id").alias("first_doc"), F.col("at").alias("first_at"), "offset", F.col("runs").alias("piece_runs"), F.col("first_doc").alias("src_doc"), F.col("first_start").alias("src_start"))
    through = copies.where("shared").select("doc_id", "at", "first_doc", "first_at").join(p, ["first_doc", "first_at"]).select("doc_id", (F.col("at") + F.col("offset")).alias("start"), F.col("piece_runs").alias("runs"), F.col("src_doc").alias("first_doc"), F.col("src_start").alias("first_start"))
    found = own.unionByName(plain).unionByName(through).where("first_doc <> doc_id OR first_start <> start")

    line = Window.partitionBy("doc_id", "first_doc", "shift").orderBy("start")
    islands = found.withColumn("shift", F.col("start") - F.col("first_start")).withColumn("new", F.coalesce((F.col("start") > F.lag(F.col("start") + F.col("runs")).over(line)).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(line))
    return islands.groupBy("doc_id", "first_doc", "shift", "island").agg(F.min("start").alias("start_word"), F.max(F.col("start") + F.col("runs")).alias("stop")).select(
        "doc_id", F.col("start_word").cast("long"), (F.col("stop") - F.col("start_word") + length - 1).cast("long").alias("n_words"), F.col("first_doc").alias("first_doc_id"), (F.col("start_word") - F.col("shift")).cast("long").alias("first_start_word")
    )


def _packed(rows: np.ndarray, n: int) -> pa.RecordBatch:
    """The first of each context to its owner's bucket, with how many there are; the others to none."""
    rows = rows[np.lexsort((rows["at"], rows["doc_id"], rows["context"], rows["owner"]))]
    first = np.flatnonzero(np.r_[True, (rows["owner"][1:] != rows["owner"][:-1]) | (rows["context"][1:] != rows["context"][:-1])])
    others = np.ones(len(rows), bool)
    others[first] = False
    others, times = rows[others], np.diff(np.r_[first, len(rows)])
    rows = rows[first]
    rows["n"] = times
    bucket = ((rows["owner"].view(np.uint64) >> np.uint64(11)) % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    ends = np.flatnonzero(np.r_[bucket[1:] != bucket[:-1], True]) + 1
    starts = np.r_[0, ends[:-1]]
    parts = range(0, len(others), 65_536)
    blobs = [rows[a:b].tobytes() for a, b in zip(starts, ends)] + [others[k : k + 65_536].tobytes() for k in parts]
    return pa.RecordBatch.from_arrays([pa.array(np.r_[bucket[starts], np.full(len(parts), -1)], pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "rows"])


def _grouped(rows: np.ndarray) -> pa.RecordBatch:
    """Of one bucket's anchors, those whose owner occurs more than once; copies point to the first of their context."""
    rows = rows[np.lexsort((rows["at"], rows["doc_id"], rows["context"], rows["owner"]))]
    o, c = rows["owner"], rows["context"]
    new_owner = np.r_[True, o[1:] != o[:-1]][: len(rows)]
    new = new_owner | np.r_[True, c[1:] != c[:-1]][: len(rows)]
    own, which = np.cumsum(new_owner) - 1, np.cumsum(new) - 1
    first = np.flatnonzero(new)[which] if len(rows) else which
    shared = np.bincount(own, weights=new)[own] > 1 if len(rows) else np.zeros(0, bool)
    several = np.bincount(which, weights=rows["n"])[which] > 1 if len(rows) else np.zeros(0, bool)
    itself = (rows["doc_id"] == rows["doc_id"][first]) & (rows["at"] == rows["at"][first]) & ~new  # a repeated row
    keep = ~itself & (shared | several)
    rows, first, shared, new = rows[keep], rows[first[keep]], shared[keep], new[keep]
    return pa.RecordBatch.from_arrays(
        [pa.array(shared), pa.array(~new), *(pa.array(np.ascontiguousarray(rows[k])) for k in ("owner", "context", "doc_id", "at", "runs")), pa.array(np.ascontiguousarray(first["doc_id"])), pa.array(np.ascontiguousarray(first["at"]))],
        names=["shared", "is_copy", "owner", "context", "doc_id", "at", "runs", "first_doc", "first_at"],
    )


def _pieces(table: pa.Table, length: int) -> pa.RecordBatch:
    """One shard: the suffix array of its contexts, and of each context the pieces that have one first occurrence."""
    doc, at, runs = (table.column(k).to_numpy() for k in ("doc_id", "at", "runs"))
    order = np.lexsort((at, doc))
    order = order[np.r_[True, (doc[order][1:] != doc[order][:-1]) | (at[order][1:] != at[order][:-1])]]
    doc, at, runs = doc[order].astype(np.int64), at[order].astype(np.int64), runs[order].astype(np.int64)
    blobs = [x.as_buffer() for c in table.column("words").chunks for x in c]
    size = runs + length  # the words and one separator
    begin = np.cumsum(size) - size
    hashes = np.concatenate([np.frombuffer(blobs[i], np.uint64) for i in order])
    separator = begin + size - 1
    inside = np.ones(int(size.sum()), bool)
    inside[separator] = False
    text = np.empty(len(inside), np.int64)
    text[inside] = np.unique(hashes, return_inverse=True)[1] + len(doc)
    text[separator] = np.arange(len(doc))  # unlike all else, so nothing matches across contexts
    sa = suffix_array(text)
    shared = permuted_lcp(text, sa)[sa]
    group = np.cumsum(shared < length) - 1
    owner = np.repeat(np.arange(len(doc)), size)
    offset = np.arange(len(text)) - begin[owner]
    position = at[owner] + offset
    valid = offset < runs[owner]
    # contexts stand in the order of (doc_id, position), so the lowest place in the text is the first occurrence
    lowest = np.full(int(group[-1]) + 1, len(text), np.int64)
    usable = valid[sa]
    np.minimum.at(lowest, group[usable], sa[usable])
    source = np.empty(len(text), np.int64)
    source[sa] = lowest[group]
    i = np.flatnonzero(valid)
    j = source[i]
    src_doc, src_at = doc[owner[j]], position[j]
    cut = np.r_[True, (owner[i][1:] != owner[i][:-1]) | (src_doc[1:] != src_doc[:-1]) | (src_at[1:] != src_at[:-1] + 1)]
    s = np.flatnonzero(cut)
    count = np.diff(np.r_[s, len(i)])
    who = owner[i[s]]
    return pa.RecordBatch.from_arrays(
        [pa.array(doc[who]), pa.array(at[who].astype(np.int32)), pa.array(offset[i[s]].astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(src_doc[s]), pa.array(src_at[s].astype(np.int32))],
        names=["doc_id", "at", "offset", "runs", "first_doc", "first_start"],
    )


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_chars", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``df`` with the words of ``repeated_passages`` cut out of its texts, each passage's first occurrence left in place; ``count_col``, if there is one, is the new text's length in characters. A text of which nothing is left goes with its row;
    texts that repeat nothing, and rows without id or text, stay as they are, blank ones too; repeated rows are cut alike, and of texts that share an id each by its own passages. An
    empty table stays empty. The columns are those of ``df``, whatever their names."""
    docs, names = told_apart(documents(df, id_col, text_col))
    spans = saved(_passages(docs, length, gram).groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "n_words")).alias("spans")))

    @F.pandas_udf("string")
    def cut(texts, spans):
        import pandas as pd

        return pd.Series([t if s is None or t is None else _cut(t, s) for t, s in zip(texts, spans)], dtype=object)

    key, own = F.col(id_col).cast("long"), df
    if names is not None:
        others = names.select(F.col("id").alias("__leafmill_name"), F.col("doc_id").alias("__leafmill_doc"), F.col("fp").alias("__leafmill_fp"))
        others = F.broadcast(others) if names.count() * 48 <= BROADCAST_BYTES else others.hint("merge")
        own = df.join(others, (key == F.col("__leafmill_doc")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("__leafmill_fp")), "left")
        key = F.coalesce("__leafmill_name", key)
    side = spans.select(F.col("doc_id").alias("__leafmill_id"), F.col("spans").alias("__leafmill_spans"))
    joined = own.join(F.broadcast(side) if spans.count() * 96 <= 4 << 20 else side.hint("merge"), key == F.col("__leafmill_id"), "left")
    hit = joined.where("__leafmill_id IS NOT NULL").withColumn(text_col, cut(F.col(text_col), F.col("__leafmill_spans"))).where(F.length(text_col) > 0)
    if count_col in df.columns:
        hit = hit.withColumn(count_col, F.length(text_col).cast(df.schema[count_col].dataType))
    return joined.where("__leafmill_id IS NULL").select(*df.columns).unionByName(hit.select(*df.columns))


def _cut(text: str, spans) -> str:
    data = text.encode()
    _, start, end = words(np.frombuffer(data, np.uint8))
    drop = np.zeros(len(start) + 1, np.int64)
    for x in spans:
        drop[x["start_word"]] += 1
        drop[min(x["start_word"] + x["n_words"], len(start))] -= 1
    gone = np.cumsum(drop)[:-1] > 0
    if gone.all():
        return ""
    edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
    out, at = [], 0
    for a, b in zip(edge[::2], edge[1::2]):
        out.append(data[at : start[a]])
        at = start[b] if b < len(start) else len(data)
    return b"".join([*out, data[at:]]).decode()
