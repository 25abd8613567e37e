"""Packing by non-negative least squares over the histogram of lengths.

Documents over the window are cut into whole windows and a remainder.  For the
remainders, combinations of up to three lengths that fill a window are
enumerated (all ones and pairs; triples over the most frequent lengths first).
How often each is to be used is the non-negative least squares fit of their
lengths to the histogram, by accelerated projected gradients.  The counts are
rounded in the order of their size within what is there.  Residual lengths are
packed greedily, the largest that fits first; the gap that is left is filled by
the front of a longer piece, whose rest stays to be packed.  The last tokens,
fewer than a window, become sequences at powers of two.  So only whole windows
and powers of two are left, which need no padding.

The fit and the plan work on at most ``capacity`` counts and do not grow with
the data; Spark numbers the pieces of each length by distributed counts and
deals them to the plan.

Defined results: null, empty and white-space texts are one piece of the end id;
rows that repeat are packed each on its own; an empty table gives no sequences;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annospark.llm.common import written
from annospark.llm.word_ids import VOCABULARY, parts_of_worker, text_ids

CAPACITY, END = 2048, 1
#: Combinations in the fit, and its steps.
COMBINATIONS, STEPS = 30_000, 300
#: Pieces of one length numbered in one group.
NUMBERED = 2000

PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, place long, ids binary"


def vocabulary_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(VOCABULARY)


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, path: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, place (in its task) and, below a window, ids (unsigned 16-bit)."""
    path = path or vocabulary_path()
    tail = end.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, place = parts_of_worker(path), 0
        for batch in batches:
            rows: list[tuple] = []
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = (text_ids(parts, text.as_buffer().to_pybytes()) if text.is_valid else b"") + tail
                n = len(ids) // 4
                for at in range(0, n, capacity):
                    own = ids[4 * at:4 * (at + capacity)]
                    short = len(own) < 4 * capacity
                    rows.append((key, at, len(own) // 4, zlib.crc32(own), n, place,
                                 np.frombuffer(own, "<u4").astype("<u2").tobytes() if short else None))
                    place += 1
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "place", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, PIECES)


# ---------------------------------------------------------------- the plan, from the counts by length
def combinations(counts: np.ndarray, capacity: int, most: int = COMBINATIONS) -> np.ndarray:
    """Rows of up to three lengths (0: none) that fill a window; counts[n]: pieces of length n."""
    there = counts > 0
    there[0] = False
    lengths = np.flatnonzero(there)
    rows = [np.stack([lengths, np.zeros_like(lengths), np.zeros_like(lengths)], axis=1)[lengths == capacity]]
    big = lengths[(lengths >= capacity - lengths) & (lengths < capacity)]
    big = big[there[capacity - big]]
    rows.append(np.stack([big, capacity - big, np.zeros_like(big)], axis=1))
    held = sum(map(len, rows))
    seen = np.zeros(len(counts), bool)
    for third in lengths[np.argsort(-counts[lengths], kind="stable")]:
        rest = capacity - third
        a = lengths[lengths < rest]
        a = a[(a >= rest - a) & there[rest - a]]
        a = a[~seen[a] & ~seen[rest - a]]   # triples with an earlier third length are there already
        seen[third] = True
        rows.append(np.stack([a, rest - a, np.full_like(a, third)], axis=1))
        held += len(a)
        if held >= most:
            break
    return np.concatenate(rows)[:most]


def fitted(rows: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Non-negative x that minimises the squared distance of the lengths used, x times each row, to ``counts``."""
    size, (m, k) = len(counts), rows.shape
    if not m:
        return np.zeros(0)
    flat = rows.ravel()
    real = flat > 0
    target = counts.astype(float)

    def used(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, weights=np.repeat(x, k) * real, minlength=size)

    # a bound of the largest eigenvalue: greatest row sum of A'A
    bound = float((np.bincount(flat[real], minlength=size)[flat] * real).reshape(m, k).sum(axis=1).max())
    x = y = np.zeros(m)
    t = 1.0
    for _ in range(steps):
        left = used(y) - target
        slope = (left[flat] * real).reshape(m, k).sum(axis=1)
        new = np.maximum(0.0, y - slope / bound)
        if ((y - new) @ (new - x)) > 0:   # restart when the momentum points uphill
            t = 1.0
        faster = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / faster * (new - x)
        x, t = new, faster
    return x


class Plan:
    """Pieces of each length still to be packed, as ranges of numbers, and the slots given to them."""

    def __init__(self, counts: np.ndarray, capacity: int):
        self.capacity, self.sequence = capacity, 0
        # length -> ranges (length of the whole piece, first number, how many, start in the piece)
        self.pool: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        self.left: dict[int, int] = {}
        self.lengths: list[int] = []
        for n in np.flatnonzero(counts).tolist():
            self.give(n, (n, 0, int(counts[n]), 0))
        #: (piece length, first number, number after the last, start, length, sequence of the first, offset)
        self.slots: list[tuple[int, int, int, int, int, int, int]] = []

    def give(self, n: int, part: tuple[int, int, int, int]) -> None:
        if not self.left.get(n):
            insort(self.lengths, n)
            self.left[n] = 0
        self.pool[n].append(part)
        self.left[n] += part[2]

    def take(self, n: int, times: int) -> list[tuple[int, int, int, int]]:
        parts, ranges = [], self.pool[n]
        self.left[n] -= times
        while times:
            whole, first, count, start = ranges.pop()
            got = min(count, times)
            parts.append((whole, first, got, start))
            if got < count:
                ranges.append((whole, first + got, count - got, start))
            times -= got
        if not self.left[n]:
            del self.lengths[bisect_right(self.lengths, n) - 1]
        return parts

    def place(self, n: int, times: int, first_sequence: int, offset: int, cut: int = 0) -> None:
        """Put ``times`` pieces of length n (their first ``cut`` ids) into sequences in a row."""
        for whole, first, count, start in self.take(n, times):
            self.slots.append((whole, first, first + count, start, cut or n, first_sequence, offset))
            first_sequence += count
            if cut:
                self.give(n - cut, (whole, first, count, start + cut))

    def bins(self, lengths: list[int], times: int, cut: tuple[int, int] | None = None) -> None:
        offset = 0
        for n in lengths:
            self.place(n, times, self.sequence, offset)
            offset += n
        if cut:
            self.place(cut[0], times, self.sequence, offset, cut[1])
        self.sequence += times

    def round(self, rows: np.ndarray, x: np.ndarray) -> None:
        """Use the fitted combinations, most used first, each at least once as long as its lengths are there."""
        for i in np.argsort(-x, kind="stable").tolist():
            if x[i] <= 0:
                break
            lengths = [n for n in rows[i].tolist() if n]
            times = min(max(1, round(float(x[i]))), *(self.left.get(n, 0) // lengths.count(n) for n in lengths))
            if times:
                self.bins(lengths, times)

    def pattern(self, least: int) -> tuple[list[int], tuple[int, int] | None, dict[int, int]] | None:
        """Lengths of one bin, the largest that fits first, and the piece whose front fills its gap; only
        lengths with ``least`` pieces left.  None if these do not fill a bin."""
        room, uses = self.capacity, defaultdict(int)
        lengths: list[int] = []
        at = len(self.lengths) - 1
        while room and at >= 0:
            at = min(at, bisect_right(self.lengths, room) - 1)
            if at < 0:
                break
            n = self.lengths[at]
            if self.left[n] >= least and (some := min(room // n, self.left[n])):
                uses[n] += some
                lengths += [n] * some
                room -= n * some
            at -= 1
        if not room:
            return lengths, None, uses
        for n in self.lengths[bisect_right(self.lengths, room):]:
            if self.left[n] >= least and self.left[n] > uses[n]:
                uses[n] += 1
                return lengths, (n, room), uses
        return None

    def greedy(self) -> None:
        """Bins of the frequent lengths first, so that equal bins are made all at once."""
        total = sum(n * c for n, c in self.left.items())
        while total >= self.capacity:
            least = max(self.left.values()) // 4
            while not (found := self.pattern(max(1, least))):
                least //= 2
            lengths, cut, uses = found
            times = min(self.left[n] // k for n, k in uses.items() if k)
            self.bins(lengths, times, cut)
            total -= self.capacity * times

    def rest(self) -> None:
        """Fewer ids than a window: sequences at the powers of two of their number."""
        total = sum(n * c for n, c in self.left.items())
        for power in range(self.capacity.bit_length(), -1, -1):
            if not total >> power & 1:
                continue
            room = 1 << power
            while room:
                n = self.lengths[-1]
                own = min(n, room)
                self.place(n, 1, self.sequence, (1 << power) - room, own if own < n else 0)
                room -= own
            self.sequence += 1


def plan(counts: dict[int, int], capacity: int = CAPACITY, most: int = COMBINATIONS, steps: int = STEPS) -> list[tuple]:
    """Slots for the pieces of each length."""
    if bad := [n for n in counts if not 1 <= n <= capacity]:
        raise ValueError(f"lengths outside 1..{capacity}: {bad[:5]}")
    table = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        table[n] = c
    made = Plan(table, capacity)
    rows = combinations(table, capacity, most)
    made.round(rows, fitted(rows, table, steps))
    made.greedy()
    made.rest()
    return made.slots


# ---------------------------------------------------------------- the pieces, dealt to the plan
def numbered(items: DataFrame, counts: dict[int, int], limit: int = NUMBERED) -> DataFrame:
    """``items`` with ``number`` from 0 within each length; a frequent length is numbered in many groups."""
    spark = items.sparkSession
    blocks = spark.createDataFrame([(n, -(-c // limit)) for n, c in counts.items()], "__n int, __blocks long")
    dealt = (items.join(F.broadcast(blocks), F.col("length") == F.col("__n"))   # at most a row for each length
             .withColumn("__block", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "place"), F.col("__blocks"))).drop("__n", "__blocks"))
    before = (dealt.groupBy(F.col("length").alias("__n"), F.col("__block").alias("__b")).agg(F.count(F.lit(1)).alias("__c"))
              .withColumn("__first", F.coalesce(F.sum("__c").over(
                  Window.partitionBy("__n").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__c"))
    own = F.row_number().over(Window.partitionBy("length", "__block").orderBy("doc_id", "start", "ids_crc32", "place")) - 1
    return (dealt.withColumn("__own", own)
            .join(before, (F.col("length") == F.col("__n")) & (F.col("__block") == F.col("__b")))
            .select(*items.columns, (F.col("__own") + F.col("__first")).alias("number")))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ids_crc32 of cut pieces, from their ids."""
    for batch in batches:
        whole = batch.column("ids_crc32").to_pylist()
        for i, ids in enumerate(batch.column("cut")):
            if ids.is_valid:
                whole[i] = zlib.crc32(np.frombuffer(ids.as_buffer(), "<u2").astype("<u4"))
        kept = [c for c in batch.schema.names if c != "cut"]
        yield pa.RecordBatch.from_arrays(
            [pa.array(whole, pa.int64()) if c == "ids_crc32" else batch.column(c) for c in kept], kept)


def packed_pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, path: str | None = None,
                  most: int = COMBINATIONS, limit: int = NUMBERED) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    items = written(pieces(docs, capacity, end, path), "nnls-pieces")
    counts = {r[0]: r[1] for r in items.groupBy("length").count().collect()}  # at most ``capacity`` rows
    # the plan's size follows from the number of lengths and combinations, not from the data
    slots = spark.createDataFrame(plan(counts, capacity, most), "__length int, __from long, __to long, __start long, "
                                                                "__own long, __sequence long, __offset long")
    dealt = (numbered(items, counts, limit)
             .join(F.broadcast(slots), (F.col("length") == F.col("__length")) & (F.col("number") >= F.col("__from"))
                   & (F.col("number") < F.col("__to"))))
    cut = F.when(F.col("__own") < F.col("length"),
                 F.expr("substring(ids, CAST(2 * __start + 1 AS INT), CAST(2 * __own AS INT))"))
    rows = dealt.select("doc_id", (F.col("start") + F.col("__start")).alias("start"), F.col("__own").alias("length"), "ids_crc32",
                        "doc_tokens", (F.col("__sequence") + F.col("number") - F.col("__from")).alias("sequence_id"),
                        F.col("__offset").alias("offset"), cut.alias("cut"))
    return rows.mapInArrow(_digests, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
                                     "sequence_id long, offset long")
