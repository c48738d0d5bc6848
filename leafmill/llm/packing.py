"""Packing documents into sequences of a fixed number of words by a grouping genetic algorithm on islands.

A document longer than a sequence fills whole ones; what is left of it, and every other document, is an item. Items are dealt into
blocks by a hash. Each block is bred on several islands, each a row of its own: crossover injects whole well-filled bins of one
parent into another, removes the bins that hold their items already, and best-fits the displaced ones, longest first. After each epoch an
island's elite moves to the next island; at last the best packing of a block wins. Nothing depends on how the rows are partitioned.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, small_batches

CAPACITY = 2048
#: Items of a block, islands of a block, epochs, generations in an epoch, individuals of an island, of which so many move on.
BLOCK, ISLANDS, EPOCHS, GENERATIONS, POPULATION, ELITE = 1024, 3, 3, 4, 5, 2

#: Rows of one id and length that are laid out at once.
_RUN = 65_536
#: Rows of a block and an island that a task has at most, once there are more than four a core.
TASK = 64

_STATE = "block long, island int, ids array<long>, sizes array<int>, population array<binary>, guests array<binary>, fitness double"


def best_fit(sizes: np.ndarray, items: np.ndarray, bins: np.ndarray, room: list[int], capacity: int) -> None:
    """Put ``items`` (in that order) each into the bin that it fills best, or a new one; changes ``bins`` (item -> bin) and ``room`` (bin -> what is free)."""
    free = sorted((r, b) for b, r in enumerate(room) if r > 0)
    for i in items.tolist():
        s = int(sizes[i])
        k = bisect_left(free, (s, -1))
        if k < len(free):
            r, b = free.pop(k)
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        bins[i] = b
        room[b] = r - s
        if r > s:
            insort(free, (r - s, b))


def fitness(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> float:
    """The mean square of how full the bins are: few full bins and some empty room beat many half-full ones."""
    return float(((np.bincount(bins, weights=sizes) / capacity) ** 2).mean()) if len(bins) else 1.0


def crossover(sizes: np.ndarray, a: np.ndarray, b: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """``a`` with some of the well-filled bins of ``b``."""
    fill = np.bincount(b, weights=sizes)
    order = np.argsort(-fill, kind="stable")
    best = order[: max(1, len(order) // 2)]
    chosen = np.zeros(len(fill), bool)
    chosen[best[rng.random(len(best)) < 0.5]] = True
    injected = chosen[b]
    struck = np.zeros(int(a.max()) + 1, bool)
    struck[a[injected]] = True
    stays = ~struck[a] & ~injected
    whole = np.full(len(a), -1, np.int64)
    _, whole[injected] = np.unique(b[injected], return_inverse=True)
    n = int(whole.max()) + 1
    if stays.any():
        whole[stays] = np.unique(a[stays], return_inverse=True)[1] + n
        n = int(whole.max()) + 1
    room = (capacity - np.bincount(whole[whole >= 0], weights=sizes[whole >= 0], minlength=n)).astype(np.int64).tolist()
    displaced = np.flatnonzero(whole < 0)
    best_fit(sizes, displaced[np.argsort(-sizes[displaced], kind="stable")], whole, room, capacity)
    return whole


def mutated(sizes: np.ndarray, a: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """``a`` with its emptiest bins, and as many others, dissolved and best-fitted."""
    fill = np.bincount(a, weights=sizes)
    k = max(1, len(fill) // 20)
    gone = np.zeros(len(fill), bool)
    gone[np.argsort(fill, kind="stable")[:k]] = True
    gone[rng.integers(0, len(fill), k)] = True
    loose = gone[a]
    whole = np.full(len(a), -1, np.int64)
    if (~loose).any():
        whole[~loose] = np.unique(a[~loose], return_inverse=True)[1]
    n = int(whole.max()) + 1
    room = (capacity - np.bincount(whole[~loose], weights=sizes[~loose], minlength=n)).astype(np.int64).tolist() if n else []
    items = np.flatnonzero(loose)
    best_fit(sizes, items[np.argsort(-sizes[items] * (1 + 0.2 * rng.random(len(items))), kind="stable")], whole, room, capacity)
    return whole


def evolve(sizes: np.ndarray, population: list[np.ndarray], capacity: int, rng: np.random.Generator, generations: int, keep: int) -> list[np.ndarray]:
    """The best ``keep`` packings after some generations, best first; as soon as one has no more bins than the items fill, the search ends. An empty population starts from best fit of the items by falling size, exactly and with noise."""
    if not population:
        for noise in np.linspace(0, 0.3, keep):
            bins, room = np.full(len(sizes), -1, np.int64), []
            best_fit(sizes, np.argsort(-sizes * (1 + noise * rng.random(len(sizes))), kind="stable"), bins, room, capacity)
            population.append(bins)
    ranked = sorted(((fitness(sizes, p, capacity), k) for k, p in enumerate(population)), reverse=True)
    pool = [(f, population[k]) for f, k in ranked]
    least = -(-int(sizes.sum()) // capacity)
    for _ in range(generations):
        if int(pool[0][1].max()) + 1 == least:  # no packing has fewer bins
            break
        young = []
        for _ in range(max(1, keep // 2)):
            x, y = rng.choice(len(pool), 2, replace=len(pool) < 2)
            young.append(crossover(sizes, pool[min(x, y)][1], pool[max(x, y)][1], capacity, rng))
        young.append(mutated(sizes, pool[int(rng.integers(0, len(pool)))][1], capacity, rng))
        pool = sorted(pool + [(fitness(sizes, c, capacity), c) for c in young], key=lambda p: -p[0])[:keep]
    return [p for _, p in pool[:keep]]


def packed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(bin_id, position, doc_id, start_word, n_words): sequence ``bin_id`` holds, at its word ``position``, so many words of the document from
    ``start_word`` on. Every word of every document is in one sequence and no sequence holds more than ``capacity``.

    Words are runs of anything but ASCII white space. Each row is packed, repeated rows too. Null and blank texts have no word and rows without
    id no name: they are left out. An empty table gives an empty result. Other columns are ignored."""
    lengths = df.select(F.col(id_col).cast("long").alias("doc_id"), F.regexp_count(F.col(text_col), F.lit(r"[^ \t\n\x0B\f\r]+")).alias("n")).where("doc_id IS NOT NULL AND n > 0")
    small_batches(df.sparkSession)
    # rows of one id and length are counted, then dealt by their place among them: an id of very many rows is in many blocks
    counted = saved(lengths.groupBy("doc_id", "n").agg(F.count("*").alias("rows")))
    n_blocks = max(1, round((counted.agg(F.sum("rows")).first()[0] or 0) / BLOCK))
    several = counted.withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("rows") - 1) / _RUN)))).withColumn("place", F.explode(F.sequence(F.col("run") * _RUN, F.least((F.col("run") + 1) * _RUN, "rows") - 1)))
    blocks = several.groupBy(F.pmod(F.xxhash64("doc_id", "n", "place"), F.lit(n_blocks)).alias("block")).agg(F.sort_array(F.collect_list(F.struct("n", "doc_id")), asc=False).alias("items"))
    none = F.array().cast("array<binary>")
    state = blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.col("items.doc_id").alias("ids"), F.col("items.n").alias("sizes"), none.alias("population"), none.alias("guests"), F.lit(0.0).alias("fitness"))

    def epoch(number: int):
        def step(batches):
            for b in batches:
                populations, best = [], []
                for block, island, sizes, own, guests in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3), b.column(4).to_pylist(), b.column(5).to_pylist()):
                    s = sizes.values.to_numpy().astype(np.int64) % capacity
                    s = s[s > 0]
                    pool = [np.frombuffer(x, np.int32).astype(np.int64) for x in [*own, *guests]]
                    pool = evolve(s, pool, capacity, np.random.default_rng([block, island, number]), GENERATIONS, POPULATION) if len(s) else [s]
                    populations.append([p.astype(np.int32).tobytes() for p in pool])
                    best.append(fitness(s, pool[0], capacity))
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(populations, pa.list_(pa.binary())), pa.array([[]] * len(best), pa.list_(pa.binary())), pa.array(best, pa.float64())], names=["block", "island", "ids", "sizes", "population", "guests", "fitness"])

        return step

    partitions = max(1, min(n_blocks * ISLANDS, max(4 * df.sparkSession.sparkContext.defaultParallelism, math.ceil(n_blocks * ISLANDS / TASK))))
    state = state.repartition(partitions, "block", "island")
    for number in range(EPOCHS):
        state = saved(state.mapInArrow(epoch(number), _STATE))
        if number + 1 < EPOCHS:
            moved = state.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.slice("population", 1, ELITE).alias("guests"))
            state = state.drop("guests").join(moved.hint("shuffle_hash"), ["block", "island"]).select("block", "island", "ids", "sizes", "population", "guests", "fitness").repartition(partitions, "block", "island")
    won = state.groupBy("block").agg(F.max_by(F.struct("ids", "sizes", F.col("population")[0].alias("bins")), F.struct("fitness", -F.col("island"))).alias("w")).select("block", "w.ids", "w.sizes", "w.bins")

    def lay(batches):
        for b in batches:
            for block, ids, sizes, bins in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3).to_pylist()):
                yield _laid(block, ids.values.to_numpy(), sizes.values.to_numpy().astype(np.int64), np.frombuffer(bins, np.int32).astype(np.int64), capacity)

    return won.mapInArrow(lay, "bin_id long, position int, doc_id long, start_word int, n_words int")


def _laid(block: int, ids: np.ndarray, sizes: np.ndarray, bins: np.ndarray, capacity: int) -> pa.RecordBatch:
    rest, whole = sizes % capacity, sizes // capacity
    item = np.flatnonzero(rest)
    order = np.argsort(bins, kind="stable")
    item, b = item[order], bins[order]
    n = rest[item]
    total = np.cumsum(n) - n
    first = np.r_[True, b[1:] != b[:-1]][: len(b)]
    position = total - total[np.flatnonzero(first)][np.cumsum(first) - 1] if len(b) else total
    used = int(b.max()) + 1 if len(b) else 0
    who = np.repeat(np.arange(len(ids)), whole)
    part = np.arange(len(who)) - np.repeat(np.cumsum(whole) - whole, whole)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(block * (1 << 32) + np.r_[b, used + np.arange(len(who))]),
            pa.array(np.r_[position, np.zeros(len(who), np.int64)].astype(np.int32)),
            pa.array(np.r_[ids[item], ids[who]]),
            pa.array(np.r_[whole[item] * capacity, part * capacity].astype(np.int32)),
            pa.array(np.r_[n, np.full(len(who), capacity)].astype(np.int32)),
        ],
        names=["bin_id", "position", "doc_id", "start_word", "n_words"],
    )
