"""Exact range self-join of vectors under Euclidean distance.

Pivots are vectors of the data, about one for every ``CELL`` of them. A vector belongs to the cell of its nearest pivot and is replicated to every other
cell that could hold a partner: if y lies in the cell of pivot j and within r of x, then d(x, j) <= d(x, own) + 2r and d(x, j) <= radius(j) + r by the triangle
inequality, and x is no further than r from the plane between its own pivot and j. Of two cells only one sends its vectors to the other, so a pair meets once.
Cells are then joined independently, those of many vectors in parts: a part's vectors are split again and again at the median of the distance to one of several
vectors, whole blocks are ruled out by those distances, once more by the triangle inequality, and products of matrices in single precision decide the rest, but for
pairs at the very bound, which are decided in double precision.

Vectors equal in every component are held as one. What leaves a cell are a row for each linked vector - how many links, and one vector that it is joined to - not the pairs.
Vectors without structure can't be ruled out by any bound: of n such, each goes to up to n / CELL / 2 cells.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, LINKS, Links, checked_join, classes, saved, trim

RADIUS, CELL = 0.3, 4096
#: Vectors of a part of a cell, of a block that is compared at once, and how many of a part's vectors split it.
PART, _BLOCK, _GUIDES = 16_384, 512, 8
#: Rounding must not lose a pair at a bound; in units of the vectors' lengths.
_SLACK = 1e-6


def _matrix(column: pa.ListArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0))


def near_classes(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", radius: float = RADIUS, cell: int = CELL) -> DataFrame:
    """(vec_id, class_id, n_links): each vector with the number of others at most ``radius`` away, equal ones too, and its class, named by the lowest id in it: vectors are of one class if
    links join them, directly or not. A vector without links is a class of its own. Distances are those in double precision.

    Rows whose id or vector is null, or whose vector is empty or has a null, NaN or infinite component, are left out; vectors of different lengths are in no
    distance of each other. Repeated rows are one. An id with several vectors has a row for each; they are vectors like any others. An empty table gives an empty
    result. Other columns are ignored, whatever their names."""
    items, points = _points(df, id_col, vector_col)
    links = None
    for n in _lengths(points):
        some = _joined(points.where(F.col("d") == n).select("id", "n", "v"), n, radius, cell, False)
        links = some if links is None else links.unionByName(some)
    if links is None:
        return items.select(F.col("id").alias("vec_id"), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    found = saved(classes(links, points))
    known = saved(checked_join(points, found, "id", "left").select("v", "first", "n", F.coalesce("class_id", "first").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    alone = known.where("n = 1").select(F.col("first").alias("vec_id"), "class_id", "n_links")
    several = checked_join(items, known.where("n > 1").select("v", "class_id", "n_links"), "v", row_bytes=1024)
    return alone.unionByName(several.select(F.col("id").alias("vec_id"), "class_id", "n_links"))


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", radius: float = RADIUS, cell: int = CELL) -> DataFrame:
    """(vec_a, vec_b, distance): every pair of different vectors at most ``radius`` apart, each under its lowest id; vec_a <= vec_b, equal only where one id has both vectors. As many
    rows as there are pairs; rows are treated as by ``near_classes``."""
    _, points = _points(df, id_col, vector_col)
    pairs = df.sparkSession.createDataFrame([], "a long, b long, distance double")
    for n in _lengths(points):
        pairs = pairs.unionByName(_joined(points.where(F.col("d") == n).select("id", "n", "v"), n, radius, cell, True))
    name = points.select("id", "first")
    named = pairs.join(name.select(F.col("id").alias("a"), F.col("first").alias("x")), "a").join(name.select(F.col("id").alias("b"), F.col("first").alias("y")), "b")
    return named.select(F.least("x", "y").alias("vec_a"), F.greatest("x", "y").alias("vec_b"), "distance")


def _points(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, v) of the usable rows, and of each different vector (id, first, n, d, v): a number of its own, its lowest id, its ids, its length."""
    v = F.col(vector_col).cast("array<float>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = float('inf'))")
    items = saved(rows.select("id", F.transform("v", lambda x: x + F.lit(0.0).cast("float")).alias("v")).distinct())  # -0 is 0
    found = items.groupBy("v").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    return items, saved(found.select(F.monotonically_increasing_id().alias("id"), "first", "n", F.size("v").alias("d"), "v"))


def _lengths(points: DataFrame) -> list[int]:
    return sorted(r.d for r in points.select("d").distinct().collect())


def _joined(points: DataFrame, n: int, radius: float, cell: int, pairs: bool) -> DataFrame:
    spark = points.sparkSession
    total = points.count()
    wanted = min(math.ceil(total / cell), BROADCAST_BYTES // (8 * n))  # beyond that the cells grow, and have more parts
    pivots = _matrix(points.orderBy(F.xxhash64("v"), "id").limit(max(1, wanted)).select("v").toArrow().column("v"))
    told = spark.sparkContext.broadcast(pivots)

    def nearest(batches):
        for b in batches:
            x = _matrix(b.column(2))
            d = _distances(x, told.value)
            own = d.argmin(1)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(d[np.arange(len(own)), own]), pa.array(np.sqrt((x * x).sum(1)))], names=["cell", "d", "norm"])

    radii, members, visitors, slack = np.full(len(pivots), -np.inf), np.zeros(len(pivots), np.int64), np.zeros(len(pivots), np.int64), _SLACK
    for r in points.mapInArrow(nearest, "cell int, d double, norm double").groupBy("cell").agg(F.max("d").alias("d"), F.count("*").alias("n"), F.max("norm").alias("norm")).collect():  # a row a pivot
        radii[r.cell], members[r.cell], slack = r.d, r.n, max(slack, _SLACK * r.norm)

    def goes(x: np.ndarray):
        """(row, cell, whether it is its own) of each cell that rows go to."""
        pivots, every = told.value, np.arange(len(told.value))
        for a in range(0, len(x), 1024):
            d = _distances(x[a : a + 1024], pivots)
            own = d.argmin(1)
            least = d[np.arange(len(own)), own][:, None]
            sends = (((own[:, None] + every) & 1) == 0) == (own[:, None] < every[None])
            i, j = np.nonzero((d <= least + 2 * radius + slack) & (d <= radii[None] + radius + slack) & sends & (own[:, None] != every[None]))
            gap = _distances(pivots, pivots)[own[i], j] if len(pivots) <= 2048 else np.concatenate([np.zeros(0), *(np.sqrt(((pivots[own[i[k : k + 65536]]] - pivots[j[k : k + 65536]]) ** 2).sum(1)) for k in range(0, len(i), 65536))])
            ok = d[i, j] ** 2 - least[i, 0] ** 2 <= 2 * (radius + slack) * (gap + slack) + slack
            yield np.r_[np.arange(len(own)), i[ok]] + a, np.r_[own, j[ok]], np.r_[np.ones(len(own), bool), np.zeros(int(ok.sum()), bool)]

    def visits(batches):
        n = np.zeros(len(told.value), np.int64)
        for b in batches:
            for _, j, own in goes(_matrix(b.column(2))):
                n += np.bincount(j[~own], minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], names=["cell", "n"])

    for r in points.mapInArrow(visits, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # a row a pivot
        visitors[r.cell] = r.n
    inner, outer = np.maximum(1, -(-members // PART)), -(-visitors // PART)

    def replicate(batches):
        """Parts of a cell's members meet each other and the parts of its visitors: (cell, one part, other part, whether the row is of the first)."""
        for b in batches:
            ids = b.column(0).to_numpy()
            dealt = mixed(ids)
            for i, j, own in goes(_matrix(b.column(2))):
                g, h = inner[j], outer[j]
                part = np.where(own, dealt[i] % g, dealt[i] % np.maximum(h, 1) + g)
                copies = np.where(own, g + h, g)
                k = np.repeat(np.arange(len(i)), copies)
                other = np.arange(len(k)) - np.repeat(np.cumsum(copies) - copies, copies)
                low, high = np.minimum(part[k], other), np.maximum(part[k], other)
                rows = pa.array(i[k])
                yield pa.RecordBatch.from_arrays([pa.array(j[k].astype(np.int32)), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), pa.array(part[k] == low), b.column(0).take(rows), b.column(1).take(rows), b.column(2).take(rows)], names=["cell", "low", "high", "left", "id", "n", "v"])

    def join(key, table):
        out = _part(table, radius, pairs, key[1] == key[2])
        trim()
        return out

    replicas = points.mapInArrow(replicate, "cell int, low int, high int, left boolean, id long, n long, v array<float>")
    return replicas.groupBy("cell", "low", "high").applyInArrow(join, "a long, b long, distance double" if pairs else LINKS)


def mixed(ids: np.ndarray) -> np.ndarray:
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)


def _blocks(guide: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """``rows`` split at the median of the distance that tells them apart most, until each part is a block."""
    out, open_ = [], [rows]
    while open_:
        r = open_.pop()
        if len(r) <= _BLOCK:
            if len(r):
                out.append(r)
            continue
        g = guide[r]
        order = np.argpartition(g[:, np.argmax(g.max(0) - g.min(0))], len(r) // 2)
        open_ += [r[order[: len(r) // 2]], r[order[len(r) // 2 :]]]
    return out


def _part(table: pa.Table, radius: float, pairs: bool, one: bool) -> pa.Table:
    """The links between two parts, or within one."""
    left = table.column("left").to_numpy(zero_copy_only=False)
    order = np.lexsort((table.column("id").to_numpy(), ~left))
    ids, weight, left = table.column("id").to_numpy()[order], table.column("n").to_numpy()[order], left[order]
    x = _matrix(table.column("v"))[order]
    links = Links(weight)
    a_, b_, d_ = [], [], []
    if one or left.any():
        guide = _distances(x, x[np.linspace(0, len(x) - 1, min(_GUIDES, len(x))).astype(int)])
        y = x - x.mean(0)
        norm = (y * y).sum(1)
        slack = 1e-5 * float(norm.max()) + 1e-12
        edge = _SLACK * (1 + math.sqrt(float((x * x).sum(1).max())))
        A = np.c_[y, norm, np.ones(len(y))].astype(np.float32)
        B = np.c_[-2 * y, np.ones(len(y)), norm].astype(np.float32)
        first = _blocks(guide, np.flatnonzero(left))
        second = first if one else _blocks(guide, np.flatnonzero(~left))
        bounds = [np.array([[guide[r].min(0), guide[r].max(0)] for r in blocks]) for blocks in (first, second)]
        right = [B[r].T.copy() for r in second]
        for s, r in enumerate(first):
            lo, hi = bounds[0][s]
            near = ((bounds[1][:, 0] - hi <= radius + edge) & (lo - bounds[1][:, 1] <= radius + edge)).all(1)
            for t in np.flatnonzero(near).tolist():
                if one and t < s:
                    continue
                square = A[r] @ right[t]
                i, j = np.nonzero(square <= radius * radius + slack)
                if one and t == s:
                    i, j = i[i < j], j[i < j]
                if not len(i):
                    continue
                sure = np.zeros(len(i), bool) if pairs else square[i, j] < radius * radius - slack
                i, j = r[i], second[t][j]
                d = np.zeros(len(i))
                open_ = np.flatnonzero(~sure)
                for k in range(0, len(open_), 16_384):
                    o = open_[k : k + 16_384]
                    d[o] = np.sqrt(((x[i[o]] - x[j[o]]) ** 2).sum(1))
                ok = sure | (d <= radius)
                if pairs:
                    a_.append(ids[i[ok]])
                    b_.append(ids[j[ok]])
                    d_.append(d[ok])
                else:
                    links.add(i[ok], j[ok])
    if not pairs:
        return links.table(ids)
    a, b, d = (np.concatenate(v) if v else np.zeros(0) for v in (a_, b_, d_))
    return pa.table({"a": a.astype(np.int64), "b": b.astype(np.int64), "distance": np.round(d.astype(np.float64), 9)})
