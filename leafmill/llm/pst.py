"""Language-model scores from a probabilistic suffix tree.

The symbols are 128 classes of bytes: case, the digits among each other and most lead bytes of a script aren't told apart, so a likelihood is that of a text's classes, and texts that
differ only within classes score alike. Contexts end at ``DEPTH`` symbols. The corpus is counted whole: how often each symbol follows each context of up to ``DEPTH`` symbols. A
context is retained if its next-symbol distribution diverges from that of its suffix one symbol shorter: if the log-likelihood gained in the corpus
by telling them apart, N(s) * KL(s || suffix), is significant. That doesn't depend on what else the corpus holds, so the tree grows with it, and the automaton lies in files
that the workers map. Each retained distribution is smoothed with its suffix's. Closed under prefixes, the contexts are the states of an automaton: a text is scored by following
its longest suffix states, many texts in step.
"""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
from collections.abc import Iterable
from typing import NamedTuple
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_dir
from .common import buckets_for, byte_views, documents, lean, saved, trim

DEPTH, BITS = 5, 7
#: Nats that a retained context gains at least.
SIGNIFICANT = 8.0
#: The weight, in observations, of the suffix's distribution in a smoothed one.
PRIOR = 8.0
EDGE = 61
ROW = 1024
_ONE = 1 << BITS


def _classes() -> np.ndarray:
    """Byte -> class: letters without case, one class of digits, space, line feed, each mark, two classes of lead bytes, each continuation byte."""
    c = np.full(256, EDGE, np.uint8)
    for i in range(26):
        c[65 + i] = c[97 + i] = i
    c[48:58] = 26
    c[[9, 11, 12, 13, 32]] = 27
    c[10] = 28
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    c[marks] = 29 + np.arange(len(marks))
    c[128:192] = 64 + np.arange(64)
    c[192:224], c[224:] = 62, 63
    return c


CLASSES = _classes()


def symbols(data: np.ndarray) -> np.ndarray:
    """DEPTH edges, then the classes of the bytes."""
    return np.concatenate([np.full(DEPTH, EDGE, np.uint8), CLASSES[data]])


class Model(NamedTuple):
    """An automaton: state * 128 + symbol -> log probability of the symbol, next state. State 0 is the empty context."""

    logp: np.ndarray
    step: np.ndarray
    lengths: np.ndarray
    keys: np.ndarray


def _keys(texts: list[np.ndarray]) -> np.ndarray:
    """The packed DEPTH + 1 symbols that end at each byte of the texts."""
    s = np.concatenate([symbols(t) for t in texts])
    k = np.zeros(len(s) - DEPTH, np.uint64)
    for d in range(DEPTH + 1):
        k = (k << np.uint64(BITS)) | s[d : len(s) - DEPTH + d]
    sizes = np.array([len(t) for t in texts])
    end = np.cumsum(sizes + DEPTH)
    inside = np.ones(len(s), bool)
    for d in range(DEPTH):
        inside[end - sizes - 1 - d] = False
    return k[inside[DEPTH:]]


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    k, n = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(k, kind="stable")
    k = k[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]][: len(k)])
    return k[first], np.add.reduceat(n[order], first) if len(k) else n


def counts(docs: DataFrame) -> DataFrame:
    """(key, n) of a (doc_id, text) table: how often the corpus has each run of DEPTH + 1 symbols. Tasks count what they read; one row a bucket carries their counts to be added up."""
    n_buckets = buckets_for(docs)

    def count(batches):
        held, total, texts, size = [], 0, [], 0

        def take():
            k = np.sort(_keys(texts))
            first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]][: len(k)])
            return k[first], np.diff(np.r_[first, len(k)])

        for b in batches:
            for data in byte_views(b.column(1)):
                texts.append(data)
                size += len(data)
                if size >= 4 << 20:
                    held.append(take())
                    texts, size, total = [], 0, total + len(held[-1][0])
                    if total > 4_000_000:
                        held = [_merged(held)]
                        total = 0
        if texts:
            held.append(take())
        if held:
            k, n = _merged(held)
            bucket = ((k * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(n_buckets)
            order = np.argsort(bucket.astype(np.int32), kind="stable")
            k, n, bucket = k[order], n[order], bucket[order]
            ends = np.flatnonzero(np.r_[bucket[1:] != bucket[:-1], True]) + 1 if len(k) else []
            starts = np.r_[0, ends[:-1]].astype(np.int64) if len(k) else []
            yield pa.RecordBatch.from_arrays([pa.array([int(bucket[a]) for a in starts], pa.int32()), pa.array([k[a:b].tobytes() + n[a:b].astype(np.int64).tobytes() for a, b in zip(starts, ends)], pa.binary())], names=["bucket", "rows"])

    def add(key, table):
        held = []
        for c in table.column("rows").chunks:
            for x in c:
                data = x.as_buffer()
                m = data.size // 16
                held.append((np.frombuffer(data, np.uint64, m), np.frombuffer(data, np.int64, m, 8 * m)))
        k, n = _merged(held)
        return pa.table({"key": k.view(np.int64), "n": n})

    return docs.mapInArrow(lean(count), "bucket int, rows binary").groupBy("bucket").applyInArrow(add, "key long, n long")


def retained(table: DataFrame, significant: float = SIGNIFICANT) -> DataFrame:
    """(length, key, n): the counts of the root and of every context that passes the divergence test, or is a suffix of one that does; key packs the context and the next symbol."""
    levels = [saved(table)]
    for d in range(DEPTH - 1, -1, -1):
        levels.append(saved(levels[-1].groupBy(F.col("key").bitwiseAND((1 << BITS * (d + 1)) - 1).alias("key")).agg(F.sum("n").alias("n"))))
    levels.reverse()  # by length of the context
    passed = None
    for d in range(1, DEPTH + 1):
        own = levels[d].withColumn("context", F.shiftright("key", BITS)).withColumn("parent", F.col("key").bitwiseAND((1 << BITS * d) - 1))
        up = levels[d - 1].select(F.col("key").alias("parent"), F.col("n").alias("pn"), F.shiftright("key", BITS).alias("pc"))
        upn = levels[d - 1].groupBy(F.shiftright("key", BITS).alias("pc")).agg(F.sum("n").alias("pt"))
        both = own.join(up.join(upn, "pc"), "parent")
        kl = both.groupBy("context").agg(F.sum("n").alias("t"), F.sum(F.col("n") * (F.log("n") - F.log("pn") + F.log("pt"))).alias("x")).where(F.col("x") - F.col("t") * F.log("t") >= significant)
        this = kl.select(F.lit(d).alias("length"), "context")
        passed = this if passed is None else passed.unionByName(this)
    passed = saved(passed)
    suffixes = passed.select(F.explode(F.sequence(F.lit(1), F.col("length"))).alias("length"), "context").select("length", F.col("context").bitwiseAND(F.expr(f"shiftleft(1L, {BITS} * length) - 1")).alias("context")).distinct()
    rows = levels[0].select(F.lit(0).alias("length"), "key", "n")
    for d in range(1, DEPTH + 1):
        rows = rows.unionByName(levels[d].withColumn("context", F.shiftright("key", BITS)).join(suffixes.where(f"length = {d}").select("context"), "context", "left_semi").select(F.lit(d).alias("length"), "key", "n"))
    return rows


def automaton(sets: dict[int, np.ndarray], counts: Iterable[tuple[int, np.ndarray, np.ndarray]], folder: str, prior: float = PRIOR) -> Model:
    """The model of a set of contexts closed under suffixes: ``sets`` has the contexts of each length in order, ``counts`` gives some (length, keys, n) at a time, in any order. Its
    tables are mapped files of ``folder``; besides the contexts, what is held in memory doesn't grow with them."""
    sets = {d: sets.get(d, np.zeros(0, np.int64)) for d in range(DEPTH + 1)}
    for d in range(DEPTH, 1, -1):  # a context's prefixes are states too
        sets[d - 1] = np.union1d(sets[d - 1], sets[d] >> BITS)
    sets[0] = np.zeros(1, np.int64)
    base = np.cumsum([0] + [len(sets[d]) for d in range(DEPTH + 1)])
    size = int(base[-1])
    logp, step = (np.lib.format.open_memmap(os.path.join(folder, name), "w+", kind, (size, _ONE)) for name, kind in zip(_files(folder), (np.float32, np.int32)))
    for d, keys, n in counts:
        logp[base[d] + np.searchsorted(sets[d], keys >> BITS), keys & (_ONE - 1)] = n
    root = logp[0].astype(np.float64)
    logp[0] = np.log((root + 1) / (root.sum() + _ONE))
    for d in range(DEPTH + 1):
        for a in range(0, len(sets[d]), 1024):
            states = sets[d][a : a + 1024]
            rows = slice(base[d] + a, base[d] + a + len(states))
            if d:
                up = _longest(sets, base, states, d - 1)
                table = logp[rows].astype(np.float64)
                logp[rows] = np.log((table + prior * np.exp(logp[up].astype(np.float64))) / (table.sum(1, keepdims=True) + prior))
            after = ((states[:, None] << BITS) | np.arange(_ONE)).ravel()
            step[rows] = _longest(sets, base, after, min(DEPTH, d + 1)).reshape(-1, _ONE)
    all_keys = np.concatenate([sets[d] for d in range(DEPTH + 1)])
    logp.flush()
    step.flush()
    return Model(np.asarray(logp).ravel(), np.asarray(step).ravel(), np.repeat(np.arange(DEPTH + 1), np.diff(base)), all_keys)


def _longest(sets: dict[int, np.ndarray], base: np.ndarray, keys: np.ndarray, most: int) -> np.ndarray:
    """The state of the longest suffix, of at most ``most`` symbols, of each key."""
    out = np.zeros(len(keys), np.int32)
    open_ = np.arange(len(keys))
    for d in range(most, 0, -1):
        if not len(sets[d]) or not len(open_):
            continue
        k = keys[open_] & ((1 << BITS * d) - 1)
        at = np.minimum(np.searchsorted(sets[d], k), len(sets[d]) - 1)
        hit = sets[d][at] == k
        out[open_[hit]] = base[d] + at[hit]
        open_ = open_[~hit]
    return out


def log_likelihoods(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """The natural logarithm of each text's probability. Long texts are cut into rows that each start DEPTH symbols early: no context is longer."""
    sizes = np.array([len(t) for t in texts], np.int64)
    rows = -(-sizes // ROW)
    total = np.zeros(len(texts))
    if not rows.sum():
        return total
    who = np.repeat(np.arange(len(texts)), rows)
    part = np.arange(len(who)) - np.repeat(np.cumsum(rows) - rows, rows)
    length = np.minimum(ROW, sizes[who] - part * ROW)
    order = np.argsort(-length, kind="stable")
    who, part, length = who[order], part[order], length[order]
    s = np.concatenate([symbols(t) for t in texts] + [np.zeros(ROW, np.uint8)])
    begin = np.cumsum(sizes + DEPTH) - (sizes + DEPTH)
    at = begin[who] + part * ROW
    state, score = np.zeros(len(who), np.int64), np.zeros(len(who))
    active = np.searchsorted(-length, -np.arange(ROW), side="left")
    for t in range(DEPTH + int(length[0])):
        m = len(who) if t < DEPTH else int(active[t - DEPTH])
        i = state[:m] * _ONE + s[at[:m] + t]
        if t >= DEPTH:
            score[:m] += model.logp[i]
        state[:m] = model.step[i]
    return np.bincount(who, score, minlength=len(texts))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> Model:
    """The model of a table's texts; the rows that ``documents`` leaves out don't count, an empty table gives the model without contexts. The driver gets 8 bytes a context,
    and the counts a few thousand at a time."""
    rows = saved(retained(counts(documents(df, id_col, text_col))))

    def pack(batches):
        for b in batches:
            length, key, n = (b.column(k).to_numpy() for k in range(3))
            for d in np.unique(length).tolist():
                own = length == d
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([key[own].tobytes() + n[own].tobytes()], pa.binary())], names=["length", "rows"])

    def unpacked():
        for r in rows.select("length", "key", "n").mapInArrow(pack, "length int, rows binary").toLocalIterator():
            data = np.frombuffer(r.rows, np.int64)
            yield r.length, data[: len(data) // 2], data[len(data) // 2 :]

    contexts = rows.where("length > 0").select("length", F.shiftright("key", BITS).alias("context")).distinct().toArrow()
    length, context = (contexts.column(k).to_numpy() for k in range(2))
    model = automaton({d: np.sort(context[length == d]) for d in range(1, DEPTH + 1)}, unpacked(), folder or _folder(df.sparkSession))
    del contexts, length, context
    trim()
    return model


def _folder(spark: SparkSession) -> str:
    """A folder for a model: in the shared one if that is of the file system, else the driver's own."""
    root = urlparse(shared_dir(spark))
    if root.scheme == "file":
        os.makedirs(root.path, exist_ok=True)
    path = tempfile.mkdtemp(prefix="leafmill-pst-", dir=root.path if root.scheme == "file" else None)
    os.chmod(path, 0o755)
    atexit.register(shutil.rmtree, path, True)
    return path


def _files(folder: str) -> tuple[str, str]:
    """The names of its tables, unlike those of any other model."""
    return f"{os.path.basename(folder)}.logp.npy", f"{os.path.basename(folder)}.step.npy"


@functools.lru_cache(maxsize=2)
def _mapped(paths: tuple[str, str]) -> Model:
    logp, step = (np.asarray(np.load(p if os.path.isabs(p) else SparkFiles.get(p), mmap_mode="r")).ravel() for p in paths)
    return Model(logp, step, np.zeros(0, np.int64), np.zeros(0, np.int64))  # scoring needs no more


def scored(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, log_likelihood, bits_per_byte): each row's text under the model of all texts.

    Null ids and texts don't enter the model; a null text's scores are null, an empty one's likelihood is 1 and its bits per byte null. Repeated rows
    count as often as they occur. An empty table gives an empty result. Other columns are ignored."""
    spark = df.sparkSession
    folder = _folder(spark)
    fit(df, id_col, text_col, folder)
    names = _files(folder)
    paths = tuple(os.path.join(folder, name) for name in names)
    if urlparse(shared_dir(spark)).scheme != "file":
        for p in paths:
            spark.sparkContext.addFile(p)  # the driver serves it; each executor fetches it once and its workers map it
        paths = names

    def score(batches):
        model = _mapped(paths)
        for b in batches:
            for a in range(0, len(b), 1024):
                part = b.slice(a, 1024)
                views = list(byte_views(part.column(1)))
                x = log_likelihoods(model, [v if v is not None else np.zeros(0, np.uint8) for v in views])
                n = [None if v is None else len(v) for v in views]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array([None if k is None else float(y) for k, y in zip(n, x)], pa.float64()), pa.array([float(-y / k / np.log(2)) if k else None for k, y in zip(n, x)], pa.float64())],
                    names=["doc_id", "n_bytes", "log_likelihood", "bits_per_byte"],
                )

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(score), "doc_id long, n_bytes long, log_likelihood double, bits_per_byte double")
