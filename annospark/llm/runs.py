"""Periodic runs of words by internal pattern matching.

A run is a stretch of words with smallest period q and length at least
``max(least, times * q)`` that no neighbouring word extends.  Texts are split
at aligned blocks of 2^k words.  A run with 2^k <= q < 2^(k+1) holds one whole
block of 2^k words that comes again q words later, so it is enough to ask, for
every aligned block, where it occurs in the windows beside it (the first level
also serves all smaller periods).  Prefix doubling gives the block classes and
the suffix array; a wavelet matrix over the suffix array answers the range
successor.  Occurrences in a window at most as long as the block form one
progression.  Of up to two occurrences each distance is a candidate period.
Three or more have the block's own period d as difference: then the first
distance is a candidate, and the two distances between the ends of the
stretches of period d around the block and around its last occurrence, as a
run with another period must map one stretch onto the other.  Candidates are
extended in both directions by the block classes and checked.

Work is O(n log n) a text.  Many short texts are searched together in numpy;
a text is never split over tasks.  Memory is about 4 bytes for each word and
each doubling that its longest repeat needs.

Defined results: null, empty and white-space texts have no words and no runs;
repeated rows are searched each on its own; equal exponents go to the smallest
start, then period; an empty table gives no rows; columns other than doc_id and
text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, TIMES = 24, 3
#: Words searched together; a longer text is searched alone.
TOGETHER = 150_000

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = ("doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, "
          "top struct<start:long,length:long,period:long>, collapsed string")


def first_level(least: int, times: int) -> int:
    """The largest k for which 2^k words serve all periods below 2^(k+1)."""
    k = 0
    while all(max(least, times * q) - q >= 2 ** (k + 2) - 1 for q in range(1, 2 ** (k + 2))):
        k += 1
    return k


class Wavelet:
    """Wavelet matrix: counts and order statistics of slices of an array, for many slices at once."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels = []
        for b in range(bits - 1, -1, -1):
            one = (values >> b) & 1 == 1
            zeros = np.zeros(len(values) + 1, np.int64)
            np.cumsum(~one, out=zeros[1:])
            self.levels.append((b, zeros))
            values = np.concatenate([values[~one], values[one]])

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values of each slice are smaller than x."""
        n = np.zeros(len(lo), np.int64)
        for b, zeros in self.levels:
            one = (x >> b) & 1 == 1
            zl, zh = zeros[lo], zeros[hi]
            n += np.where(one, zh - zl, 0)
            lo, hi = np.where(one, zeros[-1] + lo - zl, zl), np.where(one, zeros[-1] + hi - zh, zh)
        return n

    def kth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value with k smaller ones in each slice."""
        value = np.zeros(len(lo), np.int64)
        for b, zeros in self.levels:
            zl, zh = zeros[lo], zeros[hi]
            one = k >= zh - zl
            value |= one.astype(np.int64) << b
            k = np.where(one, k - (zh - zl), k)
            lo, hi = np.where(one, zeros[-1] + lo - zl, zl), np.where(one, zeros[-1] + hi - zh, zh)
        return value


class Blocks:
    """Classes of the blocks of 2^k words, suffix array and aligned blocks that occur twice in their text."""

    def __init__(self, words: np.ndarray, text: np.ndarray, begin: np.ndarray, end: np.ndarray, level: int):
        n = len(words)
        self.n = n
        self.tables: list[np.ndarray] = []
        self.queries: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        rank = np.zeros(n, np.int32)
        open_ = np.arange(n)
        key = text * (int(words.max(initial=0)) + 1) + words
        first = np.zeros(n, np.int64)
        k = 0
        while True:
            order = np.argsort(key, kind="stable" if n < 4096 else None)
            open_, key, first = open_[order], key[order], first[order]
            new = np.empty(len(open_), bool)
            new[:1] = True
            np.not_equal(key[1:], key[:-1], out=new[1:])
            old = np.empty(len(open_), bool)
            old[:1] = True
            np.not_equal(first[1:], first[:-1], out=old[1:])
            at = np.arange(len(open_))
            place = first + at - np.maximum.accumulate(np.where(old, at, 0))
            heads = np.flatnonzero(new)
            sizes = np.diff(np.append(heads, len(open_)))
            rank = rank.copy()
            rank[open_] = np.repeat(place[heads], sizes)
            self.tables.append(rank)
            twice = np.repeat(sizes > 1, sizes)
            open_, counts = open_[twice], np.repeat(sizes, sizes)[twice]
            if not len(open_):
                break
            if k >= level:
                aligned = (open_ - begin[open_]) % (1 << k) == 0
                at = open_[aligned]
                self.queries.append((k, at, rank[at].astype(np.int64), counts[aligned]))
            after = open_ + (1 << k)
            inside = after < end[open_]
            second = np.where(inside, rank[np.minimum(after, n - 1)].astype(np.int64) + 1, 0)
            first = rank[open_].astype(np.int64)
            key = first * (n + 1) + second
            k += 1
        self.order = np.empty(n, np.int64)
        self.order[rank] = np.arange(n)

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common stretch that begins at i and at j > i."""
        n = np.zeros(len(i), np.int64)
        for k in range(len(self.tables) - 1, -1, -1):
            table, b = self.tables[k], j + n
            same = (b < self.n) & (table[np.minimum(i + n, self.n - 1)] == table[np.minimum(b, self.n - 1)])
            n += same.astype(np.int64) << k
        return n

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common stretch that ends before i and before j > i."""
        n = np.zeros(len(i), np.int64)
        for k in range(len(self.tables) - 1, -1, -1):
            table, a = self.tables[k], i - n - (1 << k)
            same = (a >= 0) & (table[np.maximum(a, 0)] == table[np.maximum(j - n - (1 << k), 0)])
            n += same.astype(np.int64) << k
        return n


def find(words: np.ndarray, bounds: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Runs (start, length, period) of the texts between ``bounds``; starts count from the first text's first word."""
    if times < 3:
        raise ValueError("a run needs at least three periods")
    none = np.zeros((0, 3), np.int64)
    if not len(words):
        return none
    sizes = np.diff(bounds)
    text = np.repeat(np.arange(len(sizes)), sizes)
    begin, end = np.repeat(bounds[:-1], sizes), np.repeat(bounds[1:], sizes)
    level = first_level(least, times)
    blocks = Blocks(words, text, begin, end, level)
    asked = [q for q in blocks.queries if len(q[1])]
    if not asked:
        return none
    # the suffix array of a text lies at the text's own places: keep the texts with queries
    used = np.zeros(len(sizes), bool)
    for _, at, _, _ in asked:
        used[text[at]] = True
    kept = used[text]
    moved = np.cumsum(kept) - 1
    small = moved[blocks.order[kept]]
    back = np.flatnonzero(kept)
    wavelet = Wavelet(small, int(len(small)).bit_length())
    found = []
    for k, at, lo, count in asked:
        size = 1 << k
        for near, far in ([(1, size + 1), (size + 1, 2 * size)] if k == level else [(size, 2 * size)]):
            if far > near:
                found.append(_candidates(blocks, wavelet, moved, back, at, lo, count, near, far, end))
    s = np.concatenate([f[0] for f in found])
    q = np.concatenate([f[1] for f in found])
    ok = (q > 0) & (s + q < end[s])
    s, q = s[ok], q[ok]
    start = s - blocks.behind(s, s + q)
    length = s + q + blocks.ahead(s, s + q) - start
    ok = length >= np.maximum(least, times * q)
    runs = np.stack([start[ok], length[ok], q[ok]], axis=1)
    if not len(runs):
        return none
    # the same stretch with a multiple of its smallest period is the same run
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.append(True, (runs[1:, :2] != runs[:-1, :2]).any(axis=1))
    runs = runs[new]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _candidates(blocks, wavelet, moved, back, at, lo, count, near, far, end) -> tuple[np.ndarray, np.ndarray]:
    """Blocks (first word) and distances that may be periods, from occurrences ``near`` to ``far - 1`` words on."""
    lo, hi = moved[lo], moved[lo] + count
    here = moved[at]
    stop = moved[end[at] - 1] + 1
    low, high = np.minimum(here + near, stop), np.minimum(here + far, stop)
    before = wavelet.below(lo, hi, low)
    many = wavelet.below(lo, hi, high) - before
    hit = many > 0
    at, lo, hi, before, many = at[hit], lo[hit], hi[hit], before[hit], many[hit]
    first = back[wavelet.kth(lo, hi, before)]
    last = back[wavelet.kth(lo, hi, before + many - 1)]
    starts, periods = [at], [first - at]
    two = many == 2
    starts.append(at[two])
    periods.append((last - at)[two])
    row = many > 2
    if row.any():
        s, u = at[row], last[row]
        d = back[wavelet.kth(lo[row], hi[row], before[row] + 1)] - first[row]
        starts += [s, s]
        periods += [(u + blocks.ahead(u, u + d)) - (s + blocks.ahead(s, s + d)),
                    (u - blocks.behind(u, u + d)) - (s - blocks.behind(s, s + d))]
    return np.concatenate(starts), np.concatenate(periods)


def _better(run, top) -> bool:
    return top is None or int(run[1]) * int(top[2]) > int(top[1]) * int(run[2])


def _searched(keys: list, split: list[list[bytes]], least: int, times: int) -> pa.RecordBatch:
    ids: dict[bytes, int] = {}
    for words in split:
        for w in set(words):
            if w not in ids:
                ids[w] = len(ids)
    sizes = np.array([len(w) for w in split], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.fromiter((ids[w] for words in split for w in words), np.int64, int(bounds[-1]))
    runs = find(flat, bounds, least, times)
    owner = np.searchsorted(bounds, runs[:, 0], side="right") - 1
    runs[:, 0] -= bounds[owner]
    limits = np.searchsorted(owner, np.arange(len(split) + 1)).astype(np.int32)
    tops, collapsed = [], []
    for i, words in enumerate(split):
        own = runs[limits[i]:limits[i + 1]]
        top = None
        if len(own):
            drop = np.zeros(len(words) + 1, np.int64)
            np.add.at(drop, own[:, 0] + own[:, 2], 1)
            np.add.at(drop, own[:, 0] + own[:, 1], -1)
            kept = np.cumsum(drop[:-1]) == 0
            for run in own:
                if _better(run, top):
                    top = run
            words = [w for w, k in zip(words, kept.tolist(), strict=True) if k]
        tops.append(None if top is None else dict(zip(("start", "length", "period"), map(int, top), strict=True)))
        collapsed.append(b" ".join(words))
    parts = [pa.array(np.ascontiguousarray(runs[:, c])) for c in range(3)]
    lists = pa.ListArray.from_arrays(pa.array(limits), pa.StructArray.from_arrays(parts, fields=list(RUN)))
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int64()), pa.array(sizes), lists, pa.array(tops, RUN),
         pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "top", "collapsed"])


def collapse_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs (by start, then period), top (the run with the greatest length / period) and
    collapsed: the words, joined by a space, without those that a run holds after its first period."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, split, held = [], [], 0
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()  # ASCII white space only
                if keys and held + len(words) > TOGETHER:
                    yield _searched(keys, split, least, times)
                    keys, split, held = [], [], 0
                keys.append(key)
                split.append(words)
                held += len(words)
            yield _searched(keys, split, least, times)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)
