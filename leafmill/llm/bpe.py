"""Byte-pair encoding through a minimal acyclic transducer.

Texts are cut into words by the vocabulary's pattern. The words that make up at least ``FREQUENT`` of the corpus are encoded once and compiled, with their
ids as outputs, into a minimal acyclic automaton whose suffixes are shared; each state knows how many words lie under it, so a word's path adds up to
its rank and the rank to its ids. The automaton's arrays are one file that every worker maps into memory. A word that it doesn't hold is merged
exactly, by rank. The automaton is bounded by ``FREQUENT`` - there cannot be more than its inverse of such words - and changes nothing but speed.
"""

from __future__ import annotations

import atexit
import base64
import functools
import itertools
import mmap
import os
import shutil
import tempfile
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTES, buckets_for, byte_views, lean, mix, saved, trim

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The share of all words from which a word is frequent.
FREQUENT = 2e-6
#: The words that a worker remembers, and the bytes that it cuts at once. They change nothing but speed.
_MEMO, _STEP = 1_500_000, 400_000


def read_vocabulary(path: str) -> dict[bytes, int]:
    """Bytes -> rank of a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@functools.lru_cache(maxsize=4)
def _vocabulary(path: str) -> tuple[dict[bytes, int], list[bytes]]:
    ranks = read_vocabulary(path)
    back = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        back[rank] = token
    return ranks, back


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word: of its adjacent parts the pair of lowest rank is joined, the leftmost of equals, until none is in the vocabulary. Every byte must be."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    parts = [word[i : i + 1] for i in range(len(word))]
    if len(parts) > 400:
        return _merge_long(parts, ranks)
    pair = [ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
    while pair:
        low = min(pair)
        if low == 1 << 60:
            break
        i = pair.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pair[i]
        if i < len(pair):
            pair[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
        if i:
            pair[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
    return [ranks[p] for p in parts]


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap, for words of many bytes: n log n."""
    import heapq

    n = len(parts)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, both = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or parts[i] + parts[j] != both:
            continue
        parts[i], alive[j] = both, False
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] < n and (r := ranks.get(parts[k] + parts[after[k]])) is not None:
                heapq.heappush(heap, (r, k, parts[k] + parts[after[k]]))
    return [ranks[p] for p, a in zip(parts, alive) if a]


class PairTable:
    """Which pairs of ids join to which id, sorted, and the merging of many words in step: in every round each word joins its lowest pair, the leftmost of equals."""

    LONGEST = 24

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys, self.values = np.array(keys, np.int64)[order], np.array(values, np.int32)[order]
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int32)

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id that each pair joins to; a huge one for none."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], _NONE)

    def merged(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as bytes; words have at most LONGEST bytes. Those of like length go together."""
        out: list[bytes] = [b""] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        for low, high in ((0, 6), (6, 8), (8, 10), (10, 13), (13, 17), (17, self.LONGEST)):
            some = np.flatnonzero((size > low) & (size <= high)).tolist()
            if some:
                for k, ids in zip(some, self._merged([words[k] for k in some], size[some], high)):
                    out[k] = ids
        return out

    def _merged(self, words: list[bytes], size: np.ndarray, width: int) -> list[bytes]:
        columns = np.arange(width + 1, dtype=np.int32)[None]
        ids = np.zeros((len(words), width + 1), np.int32)
        ids[columns < size[:, None]] = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        pair = np.full((len(words), width), _NONE, np.int32)
        r, c = np.nonzero(columns[:, 1:] < size[:, None])
        pair[r, c] = self.joined(ids[r, c], ids[r, c + 1])
        final, left_over = ids.copy(), size.copy()
        where, size = np.arange(len(words)), size.copy()
        while True:
            p = pair.argmin(1)
            best = pair[np.arange(len(p)), p]
            going = best < _NONE
            if not going.all():
                stop = ~going
                final[where[stop]], left_over[where[stop]] = ids[stop], size[stop]
                ids, pair, size, where, p, best = ids[going], pair[going], size[going], where[going], p[going], best[going]
            if not len(where):
                return [row[:k].tobytes() for row, k in zip(final, left_over.tolist())]
            rows = np.arange(len(p))
            right = columns > p[:, None]
            ids[:, :-1] = np.where(right[:, :-1], ids[:, 1:], ids[:, :-1])  # what follows moves up
            pair[:, :-1] = np.where(columns[:, : width - 1] >= p[:, None], pair[:, 1:], pair[:, :-1])
            pair[:, -1] = _NONE
            ids[rows, p] = best
            size -= 1
            pair[rows, np.minimum(p, width - 1)] = _NONE
            i = rows[p + 1 < size]
            pair[i, p[i]] = self.joined(best[i], ids[i, p[i] + 1])
            i = rows[p > 0]
            pair[i, p[i] - 1] = self.joined(ids[i, p[i] - 1], best[i])


_NONE = np.int32(1 << 30)


class Transducer:
    """A minimal acyclic automaton over bytes in arrays: state -> its edges, edge -> byte, target, words passed over; rank -> ids."""

    FIELDS = ("final", "first", "label", "target", "skip", "at", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays = arrays
        self.final, self.first, _, self.target, self.skip, self.at, self.ids = (memoryview(arrays[k]) for k in self.FIELDS)
        self.find = arrays["label"].tobytes().find

    @classmethod
    def compiled(cls, words: dict[bytes, list[int]]) -> Transducer:
        """Sorted words are added one by one; states that can no longer change are replaced by equal ones registered before (incremental minimisation)."""
        register: dict[tuple, int] = {}
        states: list[tuple] = []  # (final, ((byte, state), ...)) of registered states
        path: list[list] = [[False, []]]  # the unregistered states of the last word: final, edges so far

        def close(down_to: int) -> None:
            while len(path) > down_to:
                final, edges = path.pop()
                key = (final, tuple(edges))
                k = register.get(key)
                if k is None:
                    k = register[key] = len(states)
                    states.append(key)
                byte = spelled[len(path) - 1]
                path[-1][1].append((byte, k))

        spelled = b""
        ordered = sorted(words)
        for w in ordered:
            common = len(os.path.commonprefix([spelled, w]))
            close(common + 1)
            path.extend([False, []] for _ in range(len(w) - common))
            path[-1][0] = True
            spelled = w
        close(1)
        states.append((path[0][0], tuple(path[0][1])))
        count = []  # words under each state; targets come before their sources
        for final, edges in states:
            count.append(final + sum(count[t] for _, t in edges))
        first = np.zeros(len(states) + 1, np.int32)
        label, target, skip = [], [], []
        for k, (final, edges) in enumerate(states):
            passed = int(final)
            for byte, t in edges:
                label.append(byte)
                target.append(t)
                skip.append(passed)
                passed += count[t]
            first[k + 1] = len(label)
        ids = [words[w] for w in ordered]
        return cls({"final": np.array([f for f, _ in states], np.uint8), "first": first, "label": np.array(label, np.uint8), "target": np.array(target, np.int32), "skip": np.array(skip, np.int32), "at": np.cumsum([0] + [len(x) for x in ids]).astype(np.int32), "ids": np.array([y for x in ids for y in x], np.int32)})

    def get(self, word: bytes) -> list[int] | None:
        first, find, target, skip = self.first, self.find, self.target, self.skip
        state, rank = len(self.final) - 1, 0
        for byte in word:
            e = find(byte, first[state], first[state + 1])
            if e < 0:
                return None
            rank += skip[e]
            state = target[e]
        return self.ids[self.at[rank] : self.at[rank + 1]].tolist() if self.final[state] else None

    def save(self, path: str) -> None:
        with open(path, "wb") as f:
            f.write(np.array([len(self.arrays[k]) for k in self.FIELDS], np.int64).tobytes())
            for k in self.FIELDS:
                data = self.arrays[k].tobytes()
                f.write(data + bytes(-len(data) % 8))

    @classmethod
    def mapped(cls, path: str) -> Transducer:
        with open(path, "rb") as f:
            data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        sizes = np.frombuffer(data, np.int64, len(cls.FIELDS))
        at, arrays = sizes.nbytes, {}
        for k, n in zip(cls.FIELDS, sizes.tolist()):
            kind = np.dtype(np.uint8 if k in ("final", "label") else np.int32)
            arrays[k] = np.frombuffer(data, kind, n, at)
            at += -(-n * kind.itemsize // 8) * 8
        return cls(arrays)


@functools.lru_cache(maxsize=2)
def _mapped(name: str) -> Transducer:
    return Transducer.mapped(SparkFiles.get(name))


_LETTER, _NUMBER, _OTHER, _WHITE, _END = range(5)
_FIND = regex.compile(PATTERN).findall
_CODE = np.uint64(0xA24BAED4963EE407)


@functools.lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Code point -> what the pattern takes it for; one more for what stands between two texts."""
    every = "".join(map(chr, range(0x110000)))
    kinds = np.full(0x110001, _OTHER, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_WHITE, r"\s+")):
        for m in regex.finditer(pattern, every):
            kinds[m.start() : m.end()] = kind
    kinds[-1] = _END
    return kinds


def cut(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(all texts with a line feed after each, its code points, start and end of each word of the pattern, words up to the end of each text): the words that the pattern's search
    finds, from the kinds of neighbouring characters alone, all at once."""
    whole = "\n".join([*texts, ""])
    code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds()[code]
    stop = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    kind[stop] = _END
    begins = np.empty(len(kind), bool)
    begins[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    begins[stop] = True
    begins[stop[:-1] + 1] = True
    white = kind == _WHITE
    # of white space before something else, the last character stands alone; if it is a space, what follows belongs to it
    last = np.flatnonzero(white[:-1] & ~white[1:] & (kind[1:] != _END))
    begins[last] = True
    begins[last[code[last] == 32] + 1] = False
    # an apostrophe that a word of the pattern begins with takes s, t, m, d, re, ve or ll after it
    mark = np.flatnonzero((code[:-1] == 39) & begins[:-1] & (kind[1:] == _LETTER))
    if len(mark):
        one = code[mark + 1]
        two = code[np.minimum(mark + 2, len(code) - 1)]
        long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
        short = (one == 115) | (one == 116) | (one == 109) | (one == 100)
        begins[mark[long | short] + 1] = False
        begins[mark[short] + 2] = True
        begins[mark[long] + 3] = True
    start = np.flatnonzero(begins)
    end = np.append(start[1:], len(kind))
    inside = kind[start] != _END
    start, end = start[inside], end[inside]
    return whole, code, start, end, np.searchsorted(start, stop)


def _hashes(code: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = _BYTES.to(len(code))
    sums = np.zeros(len(code) + 1, np.uint64)
    np.cumsum((code + np.uint64(1)) * _CODE * up[: len(code)], out=sums[1:])
    h = mix((sums[end] - sums[start]) * down[start])
    return np.where(h == 0, np.uint64(1), h)


class Table:
    """Word hash -> number of the word, by open addressing: all searches of a batch go on in step."""

    def __init__(self, most: int = _MEMO):
        self.bits = max(8, int(most).bit_length() + 1)
        self.mask = np.int64((1 << self.bits) - 1)
        self.most, self.n = most, 0
        self.keys, self.place = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash; -1 for one that isn't there."""
        slot = self._slots(h)
        key = self.keys[slot]
        out = np.where(key == h, self.place[slot], np.int32(-1))
        open_ = np.flatnonzero((key != h) & (key != 0))
        while len(open_):
            slot[open_] = slot[open_] + 1 & self.mask
            at = slot[open_]
            key = self.keys[at]
            hit = key == h[open_]
            out[open_[hit]] = self.place[at[hit]]
            open_ = open_[~hit & (key != 0)]
        return out

    def add(self, h: np.ndarray) -> None:
        """Distinct hashes that aren't there get the next numbers."""
        number = np.arange(self.n, self.n + len(h), dtype=np.int32)
        self.n += len(h)
        slot = self._slots(h)
        while len(h):
            free = self.keys[slot] == 0
            taken, first = np.unique(slot[free], return_index=True)
            who = np.flatnonzero(free)[first]
            self.keys[taken], self.place[taken] = h[who], number[who]
            left = np.ones(len(h), bool)
            left[who] = False
            h, number, slot = h[left], number[left], slot[left] + 1 & self.mask


class _Store:
    """A growing array."""

    def __init__(self, kind):
        self.data, self.n = np.zeros(1024, kind), 0

    def extend(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.zeros(self.n + len(x), self.data.dtype)])
        self.data[self.n : self.n + len(x)] = x
        self.n += len(x)


@functools.lru_cache(maxsize=2)
def _pairs(vocabulary: str) -> PairTable:
    return PairTable(_vocabulary(vocabulary)[0])


class Encoder:
    """Texts -> ids. A word is looked up by its hash; a word that is new to the worker is looked up in the transducer, and merged if that lacks it. What the ids spell is held against
    the text afterwards, so that two words of one hash can't be mistaken for each other: such a text is encoded word by word."""

    def __init__(self, vocabulary: str, transducer: Transducer | None, most: int = _MEMO):
        self.ranks, self.transducer, self.table, self.most = _vocabulary(vocabulary)[0], transducer, _pairs(vocabulary), most
        self.back = _flat_vocabulary(vocabulary)
        self._forget()

    def _forget(self, least: int = 0) -> None:
        self.known, self.start, self.size, self.flat = Table(max(self.most, least)), _Store(np.int32), _Store(np.int32), _Store(np.int32)

    def _ids(self, words: list[str]) -> list[bytes]:
        out, lacking = [b""] * len(words), []
        get = self.transducer.get if self.transducer else lambda _: None
        for k, w in enumerate(words):
            data = w.encode("utf-8", "replace")
            ids = get(data)
            if ids is None and len(data) <= PairTable.LONGEST:
                lacking.append((k, data))
            else:
                out[k] = array("i", merge(data, self.ranks) if ids is None else ids).tobytes()
        if lacking:
            for (k, _), ids in zip(lacking, self.table.merged([d for _, d in lacking])):
                out[k] = ids
        return out

    def _numbers(self, whole: str, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        numbers = self.known.find(h)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            fresh, first = np.unique(h[new], return_index=True)
            if self.known.n + len(fresh) > self.known.most:
                self._forget(len(np.unique(h)))
                return self._numbers(whole, h, start, end)
            w = new[first]
            ids = self._ids([whole[a:b] for a, b in zip(start[w].tolist(), end[w].tolist())])
            size = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
            self.start.extend((np.cumsum(size) - size + self.flat.n).astype(np.int32))
            self.size.extend(size)
            self.flat.extend(np.frombuffer(b"".join(ids), np.int32))
            self.known.add(fresh)
            numbers[new] = self.known.find(h[new])
        return numbers

    def __call__(self, texts: list[str], views: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has, whether they spell it)."""
        if not texts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool)
        whole, code, start, end, stop = cut(texts)
        numbers = self._numbers(whole, _hashes(code, start, end), start, end)
        size = self.size.data[numbers].astype(np.int64)
        ends = np.cumsum(size)
        at = np.repeat(self.start.data[numbers] - (ends - size), size)
        at += np.arange(len(at))
        ids = self.flat.data[at]
        count = np.diff(np.r_[0, np.r_[0, ends][stop]])
        same = self.back.spell(ids, count, views)
        if same.all():
            return ids, count, same
        parts = np.split(ids, np.cumsum(count)[:-1])  # hashes were mistaken, or the text is no UTF-8
        for k in np.flatnonzero(~same).tolist():
            parts[k] = np.array([x for w in _FIND(texts[k]) for x in merge(w.encode("utf-8", "replace"), self.ranks)], np.int32)
        count = np.fromiter(map(len, parts), np.int64, len(parts))
        return np.concatenate(parts), count, self.back.spell(np.concatenate(parts), count, views)


@functools.lru_cache(maxsize=1)
def _worker_encoder(vocabulary: str, name: str) -> Encoder:
    """A worker's tasks share what it remembers."""
    return Encoder(vocabulary, _mapped(name))


def _slices(column: pa.Array, size: int = _STEP):
    """(place, texts, bytes of each) of runs of a column's values that aren't null, of about ``size`` bytes."""
    places, held, views = [], [], []
    total = 0
    for k, (x, view) in enumerate(zip(column, byte_views(column))):
        if view is None:
            continue
        places.append(k)
        held.append(x.as_py())
        views.append(view)
        total += len(view)
        if total >= size:
            yield places, held, views
            places, held, views, total = [], [], [], 0
    if places:
        yield places, held, views


_COUNT = np.dtype([("hash", "u8"), ("n", "i8")])


def word_counts(docs: DataFrame, frequent: float = FREQUENT) -> DataFrame:
    """(word, n) of a (text) table: how often each word occurs that makes up ``frequent`` of the words of some task or more - every word that makes up so much of all is one of
    them - and, under no word, how many words there are. Tasks count what they read by hash; a row a bucket carries their counts and the words told."""
    n_buckets = buckets_for(docs, 4 << 20)

    def count(batches):
        known, n, words, total = Table(_MEMO), _Store(np.int64), [], 0
        hashes = _Store(np.uint64)

        def rows() -> pa.RecordBatch:
            told = np.flatnonzero(n.data[: n.n] >= frequent * total)
            bucket = ((hashes.data[: n.n] >> np.uint64(9)) % np.uint64(n_buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            packed = np.empty(n.n, _COUNT)
            packed["hash"], packed["n"] = hashes.data[: n.n][order], n.data[: n.n][order]
            cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
            names = [[] for _ in range(n_buckets)]
            for k in told.tolist():
                names[bucket[k]].append({"hash": int(hashes.data[k : k + 1].view(np.int64)[0]), "word": words[k]})
            used = np.flatnonzero(np.diff(cuts)).tolist()
            kind = pa.list_(pa.struct([("hash", pa.int64()), ("word", pa.string())]))
            return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([packed[cuts[b] : cuts[b + 1]].tobytes() for b in used], pa.binary()), pa.array([names[b] for b in used], kind)], names=["bucket", "rows", "names"])

        for b in batches:
            for _, texts, _ in _slices(b.column(0)):
                whole, code, start, end, _ = cut(texts)
                h = _hashes(code, start, end)
                found = known.find(h)
                new = np.flatnonzero(found < 0)
                fresh, first = np.unique(h[new], return_index=True)
                if known.n + len(fresh) > known.most:
                    if known.n:
                        yield rows()
                    fresh, first = np.unique(h, return_index=True)
                    new = np.arange(len(h))
                    known, n, words, total, hashes = Table(max(_MEMO, len(fresh))), _Store(np.int64), [], 0, _Store(np.uint64)
                if len(fresh):
                    w = new[first]
                    words += [whole[x:y] for x, y in zip(start[w].tolist(), end[w].tolist())]
                    known.add(fresh)
                    n.extend(np.zeros(len(fresh), np.int64))
                    hashes.extend(fresh)
                    found[new] = known.find(h[new])
                n.data[: n.n] += np.bincount(found, minlength=n.n)
                total += len(h)
        if known.n:
            yield rows()

    def add(key, table):
        rows = np.concatenate([np.frombuffer(x.as_buffer(), _COUNT) for c in table.column("rows").chunks for x in c])
        fresh, back = np.unique(rows["hash"], return_inverse=True)
        n = np.bincount(back, rows["n"]).astype(np.int64)
        names = {x["word"]: x["hash"] for x in itertools.chain.from_iterable(table.column("names").to_pylist())}
        at = np.searchsorted(fresh, np.fromiter(names.values(), np.int64, len(names)).view(np.uint64))
        trim()
        return pa.table({"word": pa.array([None, *names], pa.string()), "n": np.r_[rows["n"].sum(), n[at]].astype(np.int64)})

    packed = docs.mapInArrow(lean(count), "bucket int, rows binary, names array<struct<hash: long, word: string>>")
    return packed.groupBy("bucket").applyInArrow(add, "word string, n long")


def lexicon(docs: DataFrame, vocabulary: str = VOCABULARY, frequent: float = FREQUENT) -> Transducer:
    """The transducer of the words that make up at least ``frequent`` of the words of a (text) table: at most 1 / frequent come to the driver. Words of one hash count as one, which
    may let a rarer word in and changes no id."""
    counts = saved(word_counts(docs, frequent))
    total = counts.where("word IS NULL").agg(F.sum("n")).first()[0] or 0
    words = [r.word.encode() for r in counts.where(F.col("word").isNotNull() & (F.col("n") >= max(2, frequent * total))).select("word").collect()]
    ranks, _ = _vocabulary(vocabulary)
    return Transducer.compiled({w: merge(w, ranks) for w in words})


def encoded(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, frequent: float = FREQUENT) -> DataFrame:
    """(doc_id, ids, n_ids, round_trip): the ids of each row's text, and whether they decode to it.

    A null text has null ids; an empty one none. Repeated rows are encoded each. An empty table gives an empty result. Other columns are ignored."""
    spark = df.sparkSession
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    folder = tempfile.mkdtemp(prefix="leafmill-")
    atexit.register(shutil.rmtree, folder, True)  # served as long as the session lasts
    handle, path = tempfile.mkstemp(prefix="lexicon-", suffix=".mat", dir=folder)
    os.close(handle)
    lexicon(texts.select("text"), vocabulary, frequent).save(path)
    name = os.path.basename(path)
    spark.sparkContext.addFile(path)  # the driver serves it; each executor fetches it once and its workers map it

    def encode(batches):
        run = _worker_encoder(vocabulary, name)
        for b in batches:
            done = 0
            for places, held, views in _slices(b.column(1)):
                yield _encoded(run, b.slice(done, places[-1] + 1 - done), [k - done for k in places], held, views)
                done = places[-1] + 1
            if done < len(b):
                yield _encoded(run, b.slice(done), [], [], [])

    return texts.mapInArrow(lean(encode), "doc_id long, ids array<int>, n_ids int, round_trip boolean")


def _encoded(run: Encoder, part: pa.RecordBatch, places: list[int], texts: list[str], views: list[np.ndarray]) -> pa.RecordBatch:
    ids, count, same = run(texts, views)
    there = np.zeros(len(part), bool)
    there[places] = True
    n, ok = np.zeros(len(part), np.int32), np.zeros(len(part), bool)
    n[places], ok[places] = count, same
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(ids), mask=pa.array(~there))
    return pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(n, mask=~there), pa.array(ok, mask=~there)], names=["doc_id", "ids", "n_ids", "round_trip"])


class _Flat:
    """The vocabulary's bytes in one array."""

    def __init__(self, back: list[bytes]):
        self.size = np.array([len(x) for x in back], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(back), np.uint8)

    def spell(self, ids: np.ndarray, count: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
        """Of each text, given as bytes, whether its ``count`` ids decode to it."""
        size = self.size[ids]
        ends = np.cumsum(size)
        after = np.r_[0, ends][np.cumsum(count)]
        spelt = np.diff(np.r_[0, after])
        same = spelt == np.fromiter(map(len, texts), np.int64, len(texts))
        if len(ids):
            at = np.repeat(self.start[ids] - (ends - size), size)
            at += np.arange(len(at))
            got = self.bytes[at]
            if same.all():
                wrong = np.flatnonzero(got != np.concatenate(texts))
                same[np.searchsorted(after, wrong, side="right")] = False
            else:
                for k in np.flatnonzero(same).tolist():
                    same[k] = bool((got[after[k] - spelt[k] : after[k]] == texts[k]).all())
        return same


@functools.lru_cache(maxsize=2)
def _flat_vocabulary(path: str) -> _Flat:
    return _Flat(_vocabulary(path)[1])


def decoded(df: DataFrame, ids_col: str = "ids", vocabulary: str = VOCABULARY, text: str = "text") -> DataFrame:
    """``df`` and the text that ``ids_col`` stands for, as ``text``: null for null ids or an id that the vocabulary lacks; bytes that aren't UTF-8 become replacement
    characters. A column of that name raises ValueError."""
    if text in df.columns:
        raise ValueError(f"there is a column {text}")
    @F.pandas_udf("string")
    def decode(batch: pd.Series) -> pd.Series:
        _, back = _vocabulary(vocabulary)
        return pd.Series([None if x is None or any(i is None or not 0 <= i < len(back) for i in x) else b"".join([back[i] for i in x]).decode("utf-8", "replace") for x in batch], dtype=object)

    return df.withColumn(text, decode(F.col(ids_col)))
