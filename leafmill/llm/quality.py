"""A quality classifier made of two compressors: one zstandard dictionary is trained on text labelled good, one on text labelled bad, and
a text is good as far as the first helps more than the second. The difference of the compressed sizes, normalised by the text's size,
becomes a probability through a logistic curve fitted on labelled rows that the dictionaries haven't seen, each class weighted to its
share among all labels.

Texts are compressed whole, in pieces of ``PIECE`` bytes, each against the dictionary anew: of a long text the later pieces count like the first.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

DICTIONARY, PIECE, LEVEL = 112_640, 512, 3
#: The labelled rows of each class that the model is fitted on, the lowest by a hash of their id; half train the dictionary, half the curve.
FIT_ROWS = 3000
#: The bytes of each class's texts that come to the driver at most: rows that would go beyond, in the order of the hash, aren't fitted on.
FIT_BYTES = 48 << 20
#: A text below this probability of being good is rejected.
KEEP = 0.4
#: Bytes added to a text's size where the difference is normalised: very short texts prove little.
PRIOR_BYTES = 48


class Model(NamedTuple):
    good: bytes
    bad: bytes
    slope: float
    level: float
    #: Whether the good and the bad dictionary are raw text, not trained.
    raw: tuple[bool, bool]

    def scorer(self):
        compressors = []
        for data, raw in zip((self.good, self.bad), self.raw):
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT if raw else zstandard.DICT_TYPE_FULLDICT)
            d.precompute_compress(level=LEVEL)
            compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress)
        good, bad = compressors

        def difference(text: str | None) -> float:
            data = text.encode("utf-8", "replace") if text else b""
            if not data.strip():
                return np.nan
            return sum(len(bad(x)) - len(good(x)) for x in (data[i : i + PIECE] for i in range(0, len(data), PIECE))) / (len(data) + PRIOR_BYTES)

        return difference

    def probability(self, difference: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * difference + self.level, -40, 40)))


def _dictionary(texts: list[bytes]) -> tuple[bytes, bool]:
    """(dictionary, whether it is raw): trained on all pieces of the texts; raw only where zstandard refuses to train on so little."""
    try:
        return zstandard.train_dictionary(DICTIONARY, [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]).as_bytes(), False
    except zstandard.ZstdError:
        return _raw(texts), True


def _raw(texts: list[bytes]) -> bytes:
    """The beginnings of all texts, each of at most so many bytes that DICTIONARY holds them."""
    most, left = 0, DICTIONARY
    for k, size in enumerate(sorted(map(len, texts))):
        most = max(1, left // (len(texts) - k))
        if most < size:
            break
        left -= size
    return b"".join(t[:most] for t in texts)[:DICTIONARY]


def fit_texts(good: list[str], bad: list[str], share_good: float) -> Model | None:
    """The model of labelled texts, every other one of which calibrates; None if either class has fewer than two texts."""
    if min(len(good), len(bad)) < 2:
        return None
    halves = {k: ([x.encode("utf-8", "replace") for x in v[::2]], v[1::2]) for k, v in (("good", good), ("bad", bad))}
    (good_, good_raw), (bad_, bad_raw) = (_dictionary(halves[k][0]) for k in ("good", "bad"))
    model = Model(good_, bad_, 1.0, 0.0, (good_raw, bad_raw))
    measure = model.scorer()
    x = np.array([measure(t) for t in halves["good"][1] + halves["bad"][1]])
    y = np.r_[np.ones(len(halves["good"][1])), np.zeros(len(halves["bad"][1]))]
    weight = np.where(y == 1, share_good / y.sum(), (1 - share_good) / (1 - y).sum()) * len(y)
    ok = ~np.isnan(x)
    x, y, weight = x[ok], y[ok], weight[ok]
    scale = max(1e-9, float(np.abs(x).mean())) if len(x) else 1.0
    z, b = np.c_[x / scale, np.ones(len(x))], np.zeros(2)
    for _ in range(50):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-np.clip(z @ b, -40, 40)))
        g = z.T @ (weight * (y - p)) - 1e-3 * b
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return model._replace(slope=float(b[0] / scale), level=float(b[1]))


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> Model | None:
    """Fit on at most ``fit_rows`` labelled rows of each class (``label_col`` 1 good, 0 bad) and ``fit_bytes`` of their texts. A document labelled both ways is bad; labels that are
    null, of no document or of a blank one count for nothing; repeated rows are one, and an id's texts are rows of their own. None if a class is missing."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)").groupBy("id").agg(F.min("y").alias("y"))
    counts = dict(known.groupBy("y").count().collect())
    if len(counts) < 2:
        return None
    picked = [known.where(f"y = {y}").orderBy(F.xxhash64("id"), "id").limit(fit_rows) for y in (0, 1)]
    sample = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * fit_rows rows of 12 bytes
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where(r"text RLIKE '\\S'").join(sample, "id").select("id", "y", "text", F.xxhash64("text").alias("fp"))
    sizes = rows.select("id", "y", "fp", F.octet_length("text").alias("n")).distinct()
    chosen = []
    for y in (0, 1):
        first = sizes.where(f"y = {y}").orderBy(F.xxhash64("id"), "id", "fp").limit(fit_rows).toPandas()
        chosen.append(first[first.n.cumsum() <= fit_bytes])
    wanted = pd.concat(chosen)[["id", "fp"]]
    if not len(wanted):
        return None
    told = F.broadcast(documents.sparkSession.createDataFrame(wanted, "id long, fp long"))
    found = rows.join(told, ["id", "fp"]).distinct().orderBy(F.xxhash64("id"), "id", "fp").select("y", "text").toPandas()
    texts = {y: [t for t in found.text[found.y == y] if t.strip()] for y in (0, 1)}
    return fit_texts(texts[1], texts[0], counts[1] / (counts[0] + counts[1]))


def with_score(df: DataFrame, model: Model | None, text_col: str = "text", score: str = "score") -> DataFrame:
    """``df`` and the probability that its text is good, as ``score``: null where the text is null or blank, or where there is no model. A column of that name raises ValueError."""
    if score in df.columns:
        raise ValueError(f"there is a column {score}")
    if model is None:
        return df.withColumn(score, F.lit(None).cast("double"))
    small_batches(df.sparkSession)
    told = df.sparkSession.sparkContext.broadcast(model)  # two dictionaries

    @F.pandas_udf("double")
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        measure = told.value.scorer()
        for texts in batches:
            x = np.array([measure(t) for t in texts], np.float64)
            yield pd.Series(told.value.probability(x)).where(~np.isnan(x))

    return df.withColumn(score, rate(F.col(text_col)))


def classified(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(doc_id, score, keep) of every row of ``documents``. A row is rejected if its score is under ``KEEP``; a null score rejects nothing: null and
    blank texts, and all texts where the labels lack a class, are kept. Repeated rows score alike; other columns are ignored."""
    model = fit(documents, labels, id_col, text_col, label_col)
    scored = with_score(documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model)
    return scored.select("doc_id", "score", (F.coalesce("score", F.lit(1.0)) >= KEEP).alias("keep"))


def kept(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of ``documents`` that ``classified`` keeps, with their own columns."""
    name = "__leafmill_score"
    scored = with_score(documents, fit(documents, labels, id_col, text_col, label_col), text_col, name)
    return scored.where(F.coalesce(F.col(name), F.lit(1.0)) >= KEEP).select(*documents.columns)
