"""Exact Jaccard self-join of word n-gram sets through a token-group matrix.

Documents are partitioned into groups by the smallest hash of their grams, those aside that very many documents have, so near copies mostly share a group. The matrix holds,
for each group, the union of the grams that its members' prefixes (half of each, in one global order, rarest first); it is sharded by gram. A query's overlap with a member is at most
its prefix grams found in that union plus what lies beyond the prefixes; only groups whose bound reaches the overlap the threshold asks
for are opened, the smaller group travels to the larger, and there all pairs are counted exactly, in parts of at most about ``PART`` documents against as many. Every document is
a query. Documents with equal sets are held as one. What leaves a part are a row for each linked set - how many links, and one set that it is joined to - not the pairs.

The order of the grams is a heuristic - any order is exact - so the list of common grams that it rests on is bounded.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import swept
from .common import BROADCAST_BYTES, LINKS, Links, buckets_for, byte_views, checked_join, classes, documents, gram_set, lean, mix, saved, signed, trim

N, THRESHOLD = 3, 0.6
#: The share of a document's grams that is its prefix, at least 1 - THRESHOLD: the more, the fewer groups are opened and the more grams are shipped.
PREFIX = 0.5
#: The common grams kept for the order, and how often one has to occur among a task's documents to be told.
COMMON, TOLD = 1 << 18, 4
_FLUSH = 800_000
#: The bytes of a gram's hash that are shipped.
_SHORT = 6
#: The sets that a task remembers so as not to ship copies.
_TOLD_SETS = 200_000
_EXPAND = 500_000
#: In an opened group, grams that so many have or fewer are counted pair by pair.
RARE = 16
_SEED = np.uint64(0x5851F42D4C957F2D)

#: Documents of a part of an opened group.
PART = 4096

#: A gram that so many documents have is hot; how many of a document's grams tell whether most of it is.
HOT, SAMPLE = 512, 8

_SEEN = "kind byte, a long, fp long, sig long, sig2 long, low array<long>, size int"
_HEAD = np.dtype([("sig", "i8"), ("grp", "u4"), ("size", "u4"), ("count", "u2")])
_SETS = "grp long, low int, high int, left boolean, id long, n long, grams binary"


def _summary(grams: np.ndarray) -> tuple[int, int, np.ndarray]:
    """(signature of the set, in two halves, a sample): sums of mixed hashes, and the grams that come first in an order of their own."""
    m = mix(grams ^ _SEED)
    low = np.argpartition(m, SAMPLE)[:SAMPLE] if len(m) > SAMPLE else np.arange(len(m))
    return int(signed(m.sum(keepdims=True))[0]), int(signed(mix(grams + _SEED).sum(keepdims=True))[0]), grams[low[np.argsort(m[low])]]


def _groups(samples: np.ndarray, length: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The group of each sample: its first gram that isn't hot, so that a passage that many share doesn't make them a group; or, where most are hot, its first hot one, as of a document
    that is itself one of many near copies. ``samples`` stand one after another, ``hot`` is sorted."""
    is_hot = hot[np.minimum(np.searchsorted(hot, samples), len(hot) - 1)] == samples if len(hot) else np.zeros(len(samples), bool)
    who = np.repeat(np.arange(len(length)), length)
    most = 2 * np.bincount(who, is_hot, len(length)) > length
    fits = np.flatnonzero(is_hot == most[who])
    out = np.zeros(len(length), np.int64)
    out[who[fits][::-1]] = fits[::-1]  # the first of each
    return (mix(samples[out] ^ _SEED) >> np.uint64(32)).astype(np.int64)


def _least(threshold: float, size):
    return np.ceil(threshold * size - 1e-9).astype(np.int64)


def prefix_length(size: int) -> int:
    return size - math.floor((1 - PREFIX) * size)


def near_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_links): each document with the number of others whose n-gram sets are at or above ``threshold``, equal sets too, and its class, named by the lowest id in it:
    documents are of one class if links join them, directly or not. A document without links is a class of its own.

    Words are runs of anything but ASCII white space; a text of fewer than ``n`` words has one gram, of all of them. Null and blank texts link to nothing. Rows without id are left out,
    and repeated rows are one. An id with several texts has a row for each; they are documents like any others. An empty table gives an empty result. Other columns
    are ignored, whatever their names. Sets are equal if 128 bits of their grams' hashes are."""
    sets, items, blank, known = _sets(df, id_col, text_col, n)
    found = saved(classes(saved(_verified(df, sets, known, id_col, text_col, n, threshold, False)), sets.select("id", "first")))
    known = saved(checked_join(sets, found, "id", "left").select("sig", "sig2", "first", "n", F.coalesce("class_id", "first").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    alone = known.where("n = 1").select("first.doc_id", "class_id.doc_id", "n_links").toDF("doc_id", "class_id", "n_links")
    several = checked_join(items, known.where("n > 1").select("sig", "sig2", F.col("class_id.doc_id").alias("class_id"), "n_links"), ["sig", "sig2"])
    return alone.unionByName(several.select("doc_id", "class_id", "n_links")).unionByName(blank.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def near_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_a, doc_b, jaccard): every pair of different n-gram sets at or above ``threshold``, each set under its lowest id; doc_a <= doc_b, equal only where one id has both sets. As
    many rows as there are pairs; rows are treated as by ``near_classes``."""
    sets, _, _, known = _sets(df, id_col, text_col, n)
    pairs = _verified(df, sets, known, id_col, text_col, n, threshold, True)
    named = sets.select("id", "first.doc_id")
    both = pairs.join(named.toDF("a", "x"), "a").join(named.toDF("b", "y"), "b")
    return both.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "jaccard")


def _documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return documents(df, id_col, text_col).withColumn("fp", F.xxhash64("text"))


def _sets(df: DataFrame, id_col: str, text_col: str, n: int) -> tuple[DataFrame, DataFrame, DataFrame, Broadcast]:
    """The different gram sets (id, sig, sig2, grp, size, n, first): a number of its own, signature, group, grams, documents, and the lowest (doc_id, fp) that has it; the
    documents (doc_id, fp, sig, sig2), fp being the hash of the text; the ids of blank texts; the
    common grams in order, how often they occur, and the hot ones."""

    def look(batches):
        rows, held, size = [], [], 0
        for b in batches:
            for doc, fp, data in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), byte_views(b.column(1))):
                g = gram_set(data, n)
                if len(g):
                    rows.append((doc, fp, *_summary(g), len(g)))
                    held.append(g)
                    size += len(g)
                if size >= 4 * _FLUSH:
                    yield _seen(rows, held)
                    rows, held, size = [], [], 0
        if rows:
            yield _seen(rows, held)

    seen = saved(_documents(df, id_col, text_col).mapInArrow(lean(look), _SEEN))
    common = saved(seen.where("kind = 1").groupBy("a").agg(F.sum("size").alias("n")).orderBy(F.desc("n"), "a").limit(COMMON)).toArrow()
    grams, times = common.column("a").to_numpy().view(np.uint64), common.column("n").to_numpy()
    order = np.argsort(grams)
    known = df.sparkSession.sparkContext.broadcast((grams[order], times[order], np.sort(grams[times >= HOT])))  # at most COMMON * 24 bytes

    def place(batches):
        for b in batches:
            low = b.column(5)
            group = _groups(low.flatten().to_numpy().view(np.uint64), np.diff(low.offsets.to_numpy()), known.value[2]) if len(b) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(5)), pa.array(group)], names=["doc_id", "fp", "sig", "sig2", "size", "grp"])

    rows = seen.where("kind = 0").select(F.col("a").alias("doc_id"), "fp", "sig", "sig2", "size", "low")
    items = saved(rows.mapInArrow(place, "doc_id long, fp long, sig long, sig2 long, size int, grp long").distinct())
    every = items.groupBy("sig", "sig2", "grp", "size").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "fp")).alias("first"))
    sets = saved(every.select(F.monotonically_increasing_id().alias("id"), "sig", "sig2", "grp", "size", "n", "first"))
    blank = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(r"doc_id IS NOT NULL AND (text IS NULL OR NOT text RLIKE '[^ \\t\\n\\x0B\\f\\r]')").select("doc_id").distinct()
    return sets, items, blank, known


def _verified(df: DataFrame, sets: DataFrame, known: Broadcast, id_col: str, text_col: str, n: int, threshold: float, pairs: bool) -> DataFrame:
    """The links between sets that pass, or their pairs (a, b, jaccard), by the sets' numbers."""
    docs = _documents(df, id_col, text_col)
    n_buckets = buckets_for(docs, 4 << 20)

    def prefixes(batches):
        hot, times, hottest = known.value
        heads, held, size, told = [], [], 0, set()
        for b in batches:
            for data in byte_views(b.column(1)):
                g = gram_set(data, n)
                if not len(g):
                    continue
                sig, sig2, low = _summary(g)
                if (sig, sig2) in told:  # a set that this task has just shipped
                    continue
                group = int(_groups(low, np.array([len(low)]), hottest)[0])
                told.add((sig, sig2))
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, g), len(hot) - 1)
                    known_ = hot[at] == g
                    if known_.any():
                        h = g[known_]
                        g = np.concatenate([g[~known_], h[np.argsort(times[at[known_]], kind="stable")]])
                heads.append((sig, group, len(g)))
                held.append(g[: prefix_length(len(g))])
                size += len(held[-1])
                if size >= _FLUSH:
                    yield _packed(heads, held, n_buckets)
                    heads, held, size = [], [], 0
                if len(told) > _TOLD_SETS:
                    told.clear()
        if heads:
            yield _packed(heads, held, n_buckets)

    def overlaps(key, table):
        out = _overlaps(table, threshold)
        trim()
        return out

    bound = docs.mapInArrow(lean(prefixes), "bucket int, rows binary").groupBy("bucket").applyInArrow(overlaps, "sig long, grp long, size int, found int")
    # Of two documents, up to where the shorter-reaching prefix ends all shared grams are found; beyond it lie at most (1 - PREFIX) of the larger
    # one's grams. So a pair at the threshold has found at least this many, counted against the union of the group:
    enough = F.greatest(F.lit(1), F.ceil(threshold * F.col("size") - 1e-9) - F.floor((1 - PREFIX) * F.col("size")))
    visits = saved(bound.groupBy("sig", "grp").agg(F.sum("found").alias("found"), F.max("size").alias("size")).where(F.col("found") >= enough).select("sig", "grp"))
    swept(df.sparkSession)  # the prefixes that were shuffled

    members = sets.select("id", "sig", "n", "first", "grp")
    sizes = saved(members.groupBy("grp").agg(F.count("*").alias("members")))
    # whichever group is the smaller one travels; of two equal ones that of the lower number. So two groups meet in one place
    own = members.select("sig", F.col("grp").alias("own")).distinct()
    met = visits.join(own, "sig").where("grp <> own").join(sizes, "grp").join(sizes.select(F.col("grp").alias("own"), F.col("members").alias("own_members")), "own")
    met = saved(met.withColumn("there", F.struct("members", "grp") > F.struct("own_members", "own")))
    guests = met.where("there").select("sig", "grp").distinct().join(members.drop("grp"), "sig")
    hosts = met.where("NOT there").select("grp", F.col("own").alias("host")).distinct().join(members, "grp").select("sig", F.col("host").alias("grp"), "id", "n", "first")
    visiting = guests.select("id", "n", "first", "grp").unionByName(hosts.select("id", "n", "first", "grp")).distinct()
    opened = sizes.where("members > 1").select("grp").unionByName(visiting.select("grp")).distinct()
    needed = saved(members.select("id", "n", "first", "grp").join(opened, "grp", "left_semi").withColumn("member", F.lit(True)).unionByName(visiting.withColumn("member", F.lit(False))))
    # the members of a group meet each other and its visitors in one task; those of a large one in parts, each with each other part and each part of the visitors
    parts = needed.groupBy("grp").agg(F.greatest(F.lit(1), F.ceil(F.count_if("member") / PART)).cast("int").alias("g"), F.ceil(F.count_if(~F.col("member")) / PART).cast("int").alias("h")).where("g > 1 OR h > 0")
    dealt = needed.join(parts, "grp", "left").withColumns({"g": F.coalesce("g", F.lit(1)), "h": F.coalesce("h", F.lit(0))})
    dealt = dealt.withColumn("part", F.when(F.col("member"), F.pmod(F.xxhash64("id"), F.col("g"))).otherwise(F.col("g") + F.pmod(F.xxhash64("id"), F.greatest("h", F.lit(1)))).cast("int"))
    whole = F.col("g") == 1
    others = F.when(~F.col("member"), F.sequence(F.lit(0), F.col("g") - 1)).when(whole, F.sequence(F.least("h", F.lit(1)), "h")).otherwise(F.sequence(F.lit(0), F.col("g") + F.col("h") - 1))
    dealt = dealt.withColumn("other", F.explode(others))
    place = F.struct("grp", F.when(whole, F.lit(-1)).otherwise(F.least("part", "other")).alias("low"), F.greatest("part", "other").alias("high"), F.when(whole, F.col("member")).otherwise(F.col("part") <= F.col("other")).alias("left"))
    places = saved(dealt.groupBy("id", "n", "first").agg(F.collect_list(place).alias("places")).select("first.doc_id", "first.fp", "id", "n", "places"))

    def sets_of(batches):
        for b in batches:
            for k, data in enumerate(byte_views(b.column(0))):
                grams = gram_set(data, n).tobytes()
                to = b.column(3).slice(k, 1).flatten()
                m = len(to)
                yield pa.RecordBatch.from_arrays([*(to.field(x) for x in ("grp", "low", "high", "left")), pa.repeat(b.column(1)[k], m), pa.repeat(b.column(2)[k], m), pa.array([grams] * m, pa.binary())], names=["grp", "low", "high", "left", "id", "n", "grams"])

    def verify(key, table):
        low, high = key[1].as_py(), key[2].as_py()
        out = _verify(table, threshold, pairs, low == high or low < 0 and high < 2)
        trim()
        return out

    texts = checked_join(docs, places, ["doc_id", "fp"], row_bytes=96).dropDuplicates(["id"]).select("text", "id", "n", "places")
    return texts.mapInArrow(lean(sets_of), _SETS).groupBy("grp", "low", "high").applyInArrow(verify, "a long, b long, jaccard double" if pairs else LINKS)


def _seen(rows, held) -> pa.RecordBatch:
    *numbers, low, size = zip(*rows)
    a, fp, sig, sig2 = (np.array(x, np.int64) for x in numbers)
    grams = np.concatenate(held)
    held.clear()
    grams.sort()
    first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
    times = np.diff(np.r_[first, len(grams)])
    told = times >= TOLD
    hot, times = signed(grams[first[told]]), times[told]
    k, z = len(a), np.zeros(len(hot), np.int64)
    kind = np.r_[np.zeros(k, np.int8), np.ones(len(hot), np.int8)]
    ends = np.cumsum([0, *map(len, low)])
    lows = pa.ListArray.from_arrays(pa.array(np.r_[ends, np.full(len(hot), ends[-1])].astype(np.int32)), pa.array(signed(np.concatenate(low))))
    wide = (np.r_[a, hot], np.r_[fp, z], np.r_[sig, z], np.r_[sig2, z])
    return pa.RecordBatch.from_arrays([pa.array(kind), *map(pa.array, wide), lows, pa.array(np.r_[np.array(size), times].astype(np.int32))], names=["kind", "a", "fp", "sig", "sig2", "low", "size"])


def _packed(heads, held, n: int) -> pa.RecordBatch:
    """A row for each bucket: how many documents, their heads, and their prefix grams that belong there."""
    sig, group, size = (np.array(x, np.int64) for x in zip(*heads))
    grams = np.concatenate(held)
    who = np.repeat(np.arange(len(held), dtype=np.int32), [len(x) for x in held])
    bucket = ((grams >> np.uint64(17)) % np.uint64(n)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket, grams, who = bucket[order], grams[order], who[order]
    new = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (who[1:] != who[:-1])])
    if np.diff(np.r_[new, len(grams)]).max() > 65_535:  # more than a head counts: one set has several
        new = np.union1d(new, np.concatenate([np.arange(a, b, 65_535) for a, b in zip(new, np.r_[new[1:], len(grams)])]))
    head = np.empty(len(new), _HEAD)
    w = who[new]
    head["sig"], head["grp"], head["size"], head["count"] = sig[w], group[w], size[w], np.diff(np.r_[new, len(grams)])
    b = bucket[new]
    ends = np.flatnonzero(np.r_[b[1:] != b[:-1], True]) + 1
    starts = np.r_[0, ends[:-1]]
    edge = np.r_[new, len(grams)]
    short = np.ascontiguousarray(grams.view(np.uint8).reshape(-1, 8)[:, :_SHORT])  # grams taken for equal only let a group be opened in vain
    blobs = [np.int64(e - s).tobytes() + head[s:e].tobytes() + short[edge[s] : edge[e]].tobytes() for s, e in zip(starts, ends)]
    return pa.RecordBatch.from_arrays([pa.array(b[starts], pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "rows"])


def _overlaps(table: pa.Table, threshold: float) -> pa.Table:
    """One shard of the matrix: for each query and each group with a member that may be its smaller partner, how many of the query's prefix grams the group's union holds."""
    heads, grams = [], []
    for chunk in table.column("rows").chunks:
        for x in chunk:
            data = x.as_buffer()
            k = int(np.frombuffer(data, np.int64, 1)[0])
            heads.append(np.frombuffer(data, _HEAD, k, 8))
            short = np.frombuffer(data, np.uint8, -1, 8 + k * _HEAD.itemsize).reshape(-1, _SHORT)
            wide = np.zeros((len(short), 8), np.uint8)
            wide[:, :_SHORT] = short
            grams.append(wide.view(np.uint64).ravel())
    head, grams = np.concatenate(heads), np.concatenate(grams)
    who = np.repeat(np.arange(len(head), dtype=np.int32), head["count"])
    order = np.argsort(grams, kind="stable")
    g = grams[order]
    twice = np.zeros(len(g), bool)  # only grams of two documents or more
    twice[1:] = g[1:] == g[:-1]
    twice[:-1] |= twice[1:].copy()
    g, who = g[twice], who[order[twice]]
    size, doc, group = head["size"][who].astype(np.int64), head["sig"][who], head["grp"][who].astype(np.int64)
    run = np.cumsum(np.r_[True, g[1:] != g[:-1]][: len(g)]) - 1
    order = np.lexsort((doc, group, run))
    run, size, doc, group = (x[order] for x in (run, size, doc, group))
    if len(run):  # equal sets count once
        fresh = np.r_[True, (run[1:] != run[:-1]) | (doc[1:] != doc[:-1])]
        run, size, doc, group = (x[fresh] for x in (run, size, doc, group))
    # the matrix's entries: a gram, a group that has it, and the sizes of its members that have it
    entry = np.flatnonzero(np.r_[True, (run[1:] != run[:-1]) | (group[1:] != group[:-1])][: len(run)])
    e_run, e_group = run[entry], group[entry]
    e_low, e_high = (np.minimum.reduceat(size, entry), np.maximum.reduceat(size, entry)) if len(entry) else (size, size)
    first = np.searchsorted(e_run, np.arange(int(run[-1]) + 2)) if len(run) else np.zeros(1, np.int64)
    partners = first[run + 1] - first[run] if len(run) else run
    least = _least(threshold, size)
    out, total, at = [], np.cumsum(partners), 0
    while at < len(run):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _EXPAND, side="right")))
        p = partners[at:stop]
        i = np.repeat(np.arange(at, stop), p)
        j = np.arange(len(i)) - np.repeat(np.cumsum(p) - p, p) + first[run[i]]
        ok = (e_low[j] <= size[i]) & (e_high[j] >= least[i]) & (e_group[j] != group[i])
        i, j = i[ok], j[ok]
        at = stop
        if len(i):
            order = np.lexsort((e_group[j], doc[i]))
            i, j = i[order], j[order]
            d, G = doc[i], e_group[j]
            new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (G[1:] != G[:-1])])
            out.append((d[new], G[new], size[i[new]], np.diff(np.r_[new, len(i)])))
    d, G, s, c = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 4
    return pa.table({"sig": d, "grp": G, "size": s.astype(np.int32), "found": c.astype(np.int32)})


def _verify(table: pa.Table, threshold: float, pairs: bool, within: bool) -> pa.Table:
    """Exact counts, as products of incidence matrices, of the pairs of a row of the first part with one of the second, and, if asked for, of those of the first part."""
    ids, left = table.column("id").to_numpy(), table.column("left").to_numpy(zero_copy_only=False)
    order = np.lexsort((ids, ~left))
    ids, left, links = ids[order], left[order], Links(table.column("n").to_numpy()[order])
    blobs = [x.as_buffer() for c in table.column("grams").chunks for x in c]
    sets = [np.frombuffer(blobs[i], np.uint64) for i in order]
    size = np.array([len(x) for x in sets], np.int64)
    who = np.repeat(np.arange(len(sets)), size)
    grams = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    by = np.argsort(grams, kind="stable")
    g, who = grams[by], who[by]
    twice = np.zeros(len(g), bool)
    twice[1:] = g[1:] == g[:-1]
    twice[:-1] |= twice[1:].copy()
    g, who = g[twice], who[twice]
    run = np.cumsum(np.r_[True, g[1:] != g[:-1]][: len(g)]) - 1
    often = np.bincount(run)[run] > RARE if len(run) else np.zeros(0, bool)
    rare = _pair_counts(run[~often], who[~often])  # of grams that few have, their pairs; of the others, columns of a matrix
    who, column = who[often], np.unique(run[often], return_inverse=True)[1]
    m, step, wide = int(left.sum()), 1024, 4096
    a_, b_, c_ = [], [], []
    cuts = np.searchsorted(column, np.arange(0, (int(column[-1]) + 1 if len(column) else 0) + wide, wide))
    for x in range(0 if within else m // step * step, len(ids), step):
        lo_, hi_ = np.searchsorted(rare[0], [x, x + step])
        ri, rj, rc = (v[lo_:hi_] for v in rare)
        for y in range(0, min(m, x + step), step):  # the first part's rows come first; a pair is counted with its later row
            acc = np.zeros((min(step, len(ids) - x), min(step, m - y)), np.float32)
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                w, col = who[lo:hi], column[lo:hi] - (column[lo] if hi > lo else 0)
                left, right = (w >= x) & (w < x + acc.shape[0]), (w >= y) & (w < y + acc.shape[1])
                if left.any() and right.any():
                    u = int(col.max()) + 1
                    A, B = np.zeros((acc.shape[0], u), np.float32), np.zeros((acc.shape[1], u), np.float32)
                    A[w[left] - x, col[left]] = 1
                    B[w[right] - y, col[right]] = 1
                    acc += A @ B.T
            here = (rj >= y) & (rj < y + acc.shape[1])
            acc[ri[here] - x, rj[here] - y] += rc[here]
            i, j = np.nonzero(acc)
            c = acc[i, j].astype(np.int64)
            i, j = i + x, j + y
            ok = (i > j) & (within | (i >= m)) & (c >= threshold * (size[i] + size[j] - c) - 1e-9)
            i, j, c = i[ok], j[ok], c[ok]
            if pairs:
                a_.append(ids[i])
                b_.append(ids[j])
                c_.append(c / (size[i] + size[j] - c))
            elif len(i):
                links.add(i, j)
    if not pairs:
        return links.table(ids)
    a, b, c = (np.concatenate(x) if x else np.zeros(0) for x in (a_, b_, c_))
    return pa.table({"a": a.astype(np.int64), "b": b.astype(np.int64), "jaccard": c.astype(np.float64)})


def _pair_counts(run: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, n): how many runs each pair i > j shares, by i then j; within a run, ``who`` ascends."""
    n = np.int64(int(who.max()) + 1 if len(who) else 1)
    first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]][: len(run)])
    place = np.arange(len(run)) - np.repeat(first, np.diff(np.r_[first, len(run)]))
    keys, counts, total, at = np.zeros(0, np.int64), np.zeros(0, np.int64), np.cumsum(place), 0
    while at < len(run):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _EXPAND, side="right")))
        p = place[at:stop]
        i = np.repeat(np.arange(at, stop), p)
        j = i - 1 - (np.arange(len(i)) - np.repeat(np.cumsum(p) - p, p))
        k, c = np.unique(who[i] * n + who[j], return_counts=True)
        keys, back = np.unique(np.concatenate([keys, k]), return_inverse=True)
        counts = np.bincount(back, np.concatenate([counts, c]), minlength=len(keys)).astype(np.int64)
        at = stop
    return keys // n, keys % n, counts


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with one document, the lowest id, of each class of ``near_classes``; of several texts of that id in one class, one stays. Documents without near copies, and rows
    without id or with a null or blank text, stay. Repeated rows stay or go together. An empty table stays empty. The columns are those of ``df``, whatever their names."""
    sets, items, _, known = _sets(df, id_col, text_col, n)
    found = saved(classes(saved(_verified(df, sets, known, id_col, text_col, n, threshold, False)), sets.select("id", "first")))
    # of a class one document stays; a set that has no links keeps its lowest one
    known = saved(checked_join(sets, found, "id", "left").where("n > 1 OR class_id <> first").select("sig", "sig2", F.coalesce("class_id", "first").alias("stays")))
    gone = checked_join(items, known, ["sig", "sig2"]).where(F.struct("doc_id", "fp") != F.col("stays"))
    gone = saved(gone.select(F.col("doc_id").alias("__leafmill_id"), F.col("fp").alias("__leafmill_fp")))
    side = F.broadcast(gone) if gone.count() * 32 <= BROADCAST_BYTES else gone.hint("merge")
    return df.join(side, (F.col(id_col).cast("long") == F.col("__leafmill_id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("__leafmill_fp")), "left_anti")
