"""What the operators of this subpackage share: tables that outlive executors, joins whose broadcast is checked, and words as numbers.

A *word* is a maximal run of bytes other than ASCII white space (tab, line feed, vertical tab, form feed, carriage return,
space). Words are compared through 64-bit hashes, so everything that follows stays in numpy.
"""

from __future__ import annotations

import ctypes
import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import saved

#: A side of a join is broadcast up to this estimate; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20

_LIBC = ctypes.CDLL(None) if sys.platform == "linux" and hasattr(ctypes.CDLL(None), "malloc_trim") else None

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WORD_BASE = np.uint64(0xD6E8FEB86659FD93)
_WORD_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUE = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xA24BAED4963EE407)


# ---------------------------------------------------------------- tables


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the plan's size; for a scan, that of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def buckets_for(df: DataFrame, bytes_each: int = 16 << 20) -> int:
    """How many buckets a hash-partitioned intermediate of a (doc_id, text) table gets: they grow with the input, what one holds doesn't. Where Catalyst knows no size, as of
    rows that come from the driver, the texts' bytes are summed."""
    size = estimated_bytes(df)
    if size >= 1 << 55:
        size = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(8, math.ceil(size / bytes_each))


def checked_join(big: DataFrame, side: DataFrame, on: str | list[str], how: str = "inner", row_bytes: int = 48) -> DataFrame:
    """Join that broadcasts ``side`` only if its counted rows fit BROADCAST_BYTES, and shuffles both sides otherwise. ``side`` should be a saved table: it is counted."""
    return big.join(F.broadcast(side) if side.count() * row_bytes <= BROADCAST_BYTES else side.hint("merge"), on, how)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, first): the lowest id that each id is joined to through ``edges``, directly or not, for all but that lowest one. Large-star and small-star steps alternate until no edge
    changes; each keeps one row an edge, and their number grows with the logarithm of the longest chain. Least neighbours are aggregated before they are joined back, so an id with
    many edges is split among tasks."""
    edges = saved(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = saved(both.where("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        after = saved(low.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        if after.count() == edges.count() and after.exceptAll(edges).isEmpty():
            return after.select(F.col("u").alias("id"), F.col("v").alias("first"))
        edges = after


class Links:
    """The links among the rows of one task: how many each row has, weighted by what its partner stands for, and which rows they join, directly or not. Pairs come in blocks and
    aren't kept."""

    def __init__(self, weight: np.ndarray):
        self.weight, self.count = weight.astype(np.int64), np.zeros(len(weight), np.int64)
        self.root = np.arange(len(weight))

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """Each of these pairs is a link; no pair may come twice."""
        for x, y in ((i, j), (j, i)):
            self.count += np.bincount(x, self.weight[y], len(self.count)).astype(np.int64)
        a, b = self.root[i], self.root[j]
        apart = a != b
        if not apart.any():
            return
        n = np.int64(len(self.root))
        pairs = np.unique(np.maximum(a, b)[apart] * n + np.minimum(a, b)[apart])
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        for x, y in zip((pairs // n).tolist(), (pairs % n).tolist()):
            x, y = top(x), top(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        to = np.arange(n)
        moved = np.fromiter(up, np.int64, len(up))
        to[moved] = np.fromiter(map(top, up), np.int64, len(up))
        self.root = to[self.root]

    def table(self, ids: np.ndarray) -> pa.Table:
        """(id, links, root) of the rows that have links."""
        some = np.flatnonzero(self.count)
        return pa.table({"id": ids[some], "links": self.count[some], "root": ids[self.root[some]]})


LINKS = "id long, links long, root long"


def classes(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, class_id, links) of the ids that have links: of what the tasks' ``Links`` say, how many each id has in all, and the lowest ``first`` of ``nodes`` (id, first) in its class."""
    links = saved(links)
    joined = components(links.select("id", "root"), "id", "root")
    total = links.groupBy("id").agg(F.sum("links").alias("links")).join(joined, "id", "left").select("id", "links", F.coalesce("first", "id").alias("root"))
    named = saved(total.join(nodes.select("id", F.col("first").alias("name")), "id"))
    return named.join(named.groupBy("root").agg(F.min("name").alias("class_id")), "root").select("id", "class_id", "links")


def small_batches(spark: SparkSession) -> None:
    """Rows of texts go to Python 2000 at a time instead of Spark's 10,000, unless the session says otherwise: buffers on both sides stay at a few MB."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "2000")


def trim() -> None:
    """Give what a Python worker has freed back to the machine: workers live on between tasks, beside their executor's heap."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def lean(f):
    """A function over batches that trims its worker when it has ended."""

    def run(batches):
        yield from f(batches)
        trim()

    return run


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id bigint, text string) alone, so that no other column can clash; rows without id or text are left out."""
    small_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")


def told_apart(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """A (doc_id, text) table in which texts that share a doc_id have ids of their own, and the table (id, doc_id, fp) of those ids, the doc_ids they stand for and the hashes of the
    texts; None if there are none. Of an id's texts that of the lowest hash keeps the id; the others' ids come after all."""
    hashed = docs.withColumn("fp", F.xxhash64("text"))
    several = saved(hashed.groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high").drop("high"))
    if several.isEmpty():
        return docs, None
    last = docs.agg(F.max("doc_id")).first()[0]
    others = checked_join(hashed.select("doc_id", "fp"), several, "doc_id").where("fp <> low").select("doc_id", "fp").distinct()
    names = saved(others.select((F.monotonically_increasing_id() + F.lit(last + 1)).alias("id"), "doc_id", "fp"))
    return checked_join(hashed, names, ["doc_id", "fp"], "left").select(F.coalesce("id", "doc_id").alias("doc_id"), "text"), names


# ---------------------------------------------------------------- words


def byte_views(column: pa.Array) -> Iterator[np.ndarray | None]:
    """The bytes of each value of a string or binary column, without a copy; None for null."""
    if isinstance(column, pa.ChunkedArray):
        for chunk in column.chunks:
            yield from byte_views(chunk)
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    bytes_ = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield bytes_[at[i] : at[i + 1]] if valid[i] else None


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, as far as they were asked for."""

    def __init__(self, base: np.uint64, inverse: np.uint64):
        self.base, self.inverse, self.up, self.down = base, inverse, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            m = max(n + 1, 2 * len(self.up), 4096)
            for name, x in (("up", self.base), ("down", self.inverse)):
                steps = np.full(m, x, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


_BYTES, _WORDS = _Powers(_BASE, _INVERSE), _Powers(_WORD_BASE, _WORD_INVERSE)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: every bit of the result depends on all of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random number for each byte at each place of a word, the places counted modulo 64; beyond, another factor for each 64 places.
_RANDOM = np.random.default_rng(0x1EAF).integers(0, 1 << 64, (64, 256), np.uint64)


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, byte after the last) of each word of a text given as bytes. The hash is a sum of random numbers, one for each byte and its place: tabulation, which no
    pattern of bytes cancels out."""
    n = len(data)
    solid = np.zeros(n + 2, dtype=np.int8)
    solid[1:-1] = ~_SPACE[data]
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), start, end
    place = np.arange(n, dtype=np.int32)
    size = end - start
    place -= np.repeat(start.astype(np.int32), np.diff(np.r_[0, start[1:], n]))  # what stands before the first word isn't summed
    value = _RANDOM.ravel()[(place & 63) << 8 | data]
    if size.max() > 64:
        far = np.flatnonzero(place > 63)
        value[far] *= mix((place[far] >> 6).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)) | np.uint64(1)
    value[~solid[1:-1].view(bool)] = 0
    return mix(np.add.reduceat(value, start)), start, end


class Grams:
    """Hashes of any run of words of one text in constant time."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        up, self.down = _WORDS.to(n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * up[:n], out=self.sums[1:])

    def every(self, k: int) -> np.ndarray:
        """The hash of the k words from each position on."""
        m = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:m]) * self.down[:m]) if m > 0 else np.zeros(0, np.uint64)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def gram_set(data: np.ndarray, n: int) -> np.ndarray:
    """The sorted distinct hashes of a text's word n-grams; a text of fewer words has one gram, of all its words; a blank text has none."""
    h, _, _ = words(data)
    if len(h) == 0:
        return h
    return np.unique(Grams(h).every(min(n, len(h))))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def column(values, kind: pa.DataType) -> pa.Array:
    return pa.array(values, type=kind)


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
