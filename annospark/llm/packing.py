"""Best-two-fit packing of token pieces into sequences.

A bin is filled greedily with the largest piece that fits, again and again;
then, if a gap is left, its smallest piece is replaced by the two unpacked
pieces that fit the widened gap most tightly.  What a bin gets depends only on
which lengths are still there, so equal bins are made all at once: the search
runs over the counts of the at most ``capacity`` lengths, whose size does not
grow with the data.  Spark then deals the pieces of each length, numbered by
distributed counts, to the places that the patterns hold for that length.

Defined results: null and empty texts are one piece of the end token; rows that
repeat are packed each on its own; an empty table gives no sequences; columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annospark.llm.common import written
from annospark.llm.tokens import RANKS, VOCABULARY, TextIds

CAPACITY, END = 1024, 2
#: Pieces of one length numbered in one group; more are numbered in several.
NUMBERED = 2000

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, place long"


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path(VOCABULARY), public_tokenizers.path(RANKS)


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, paths: tuple[str, str] | None = None,
           with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, place (in its task) and, if asked for, ids (binary, unsigned 32-bit).

    Documents over ``capacity`` are cut into full pieces; the first takes the remainder.
    """
    paths = paths or tokenizer_paths()
    tail = end.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, place = TextIds(*paths), 0
        for batch in batches:
            rows: list[tuple] = []
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = encode(text.as_py()) + tail
                n = len(ids) // 4
                at, piece = 0, 0
                while at < n:
                    stop = at + ((n - 1) % capacity + 1 if piece == 0 else capacity)
                    own = ids[4 * at:4 * stop]
                    rows.append((key, piece, at, stop - at, zlib.crc32(own), place, own if with_ids else None))
                    at, piece, place = stop, piece + 1, place + 1
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "place", "ids"][:7 if with_ids else 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k, _ in zip(columns, kinds, names, strict=False)], names)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA + ", ids binary" * with_ids)


def patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Best-two-fit over counts by length: (lengths of a bin, number of such bins)."""
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left)
    found = []

    def largest(room: int, used: Counter) -> int:
        at = bisect_right(lengths, room) - 1
        while at >= 0 and left[lengths[at]] <= used[lengths[at]]:
            at -= 1
        return lengths[at] if at >= 0 else 0

    def tighter(low: int, room: int, used: Counter) -> tuple[int, int] | None:
        """The two unpacked lengths that fill the gap without ``low`` best, if better than ``low``."""
        gap, best, pair = room + low, low, None
        used = used.copy()
        used[low] -= 1
        n = largest(gap - 1, used)
        while 2 * n > best and best < gap:
            used[n] += 1
            m = largest(min(gap - n, n), used)
            used[n] -= 1
            if m and n + m > best:
                best, pair = n + m, (n, m)
            n = largest(n - 1, used)
        return pair

    while lengths:
        used: Counter = Counter()
        room = capacity
        while n := largest(room, used):
            take = min(room // n, left[n] - used[n])
            used[n] += take
            room -= take * n
        if room and (pair := tighter(low := min(used), room, used)):
            used[low] -= 1
            used.update(pair)
            used += Counter()
        times = min(left[n] // k for n, k in used.items())
        found.append((tuple(sorted(used.elements(), reverse=True)), times))
        for n, k in used.items():
            left[n] -= k * times
        lengths = [n for n in lengths if left[n]]
    return found


def places(found: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first number, number after the last, sequence of the first, offset) of each pattern's slots."""
    rows, taken, sequence = [], Counter(), 0
    for lengths, times in found:
        offset = 0
        for n in lengths:
            rows.append((n, taken[n], taken[n] + times, sequence, offset))
            taken[n] += times
            offset += n
        sequence += times
    return rows


def pack(items: DataFrame, capacity: int = CAPACITY, length: str = "length",
         order: tuple[str, ...] = ("doc_id", "piece", "ids_crc32", "place"), numbered: int = NUMBERED) -> DataFrame:
    """``items`` with sequence_id and offset.  Lengths from 1 to ``capacity``.

    Rows that repeat in every column of ``order`` are numbered in one group;
    ``place`` spreads them.
    """
    spark = items.sparkSession
    order = tuple(c for c in order if c in items.columns)
    counts = {r[0]: r[1] for r in items.groupBy(length).count().collect()}  # at most ``capacity`` rows
    if bad := [n for n in counts if n is None or not 1 <= n <= capacity]:
        raise ValueError(f"lengths outside 1..{capacity}: {bad[:5]}")
    slots = places(patterns(counts, capacity))
    blocks = max(1, -(-max(counts.values(), default=1) // numbered))
    dealt = items.withColumn("__block", F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    before = (dealt.groupBy(F.col(length).alias("__n"), F.col("__block").alias("__b")).agg(F.count(F.lit(1)).alias("__c"))
              .withColumn("__first", F.coalesce(F.sum("__c").over(
                  Window.partitionBy("__n").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .drop("__c"))
    own = F.row_number().over(Window.partitionBy(length, "__block").orderBy(*order)) - 1
    numbers = (dealt.withColumn("__own", own)
               .join(before, (F.col(length) == F.col("__n")) & (F.col("__block") == F.col("__b")))
               .withColumn("__number", F.col("__own") + F.col("__first")))
    # the slots follow from the counts by length: their number is bounded by the capacity, not by the data
    table = spark.createDataFrame(slots, f"__length {dict(items.dtypes)[length]}, __from long, __to long, "
                                         "__sequence long, __offset long")
    return (numbers.join(F.broadcast(table), (F.col(length) == F.col("__length")) & (F.col("__number") >= F.col("__from"))
                         & (F.col("__number") < F.col("__to")))
            .select(*items.columns, (F.col("__sequence") + F.col("__number") - F.col("__from")).alias("sequence_id"),
                    F.col("__offset").alias("offset")))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (binary): the packed sequences; a group holds at most the capacity of ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return (packed.groupBy("sequence_id").agg(parts.alias("parts"))
            .select("sequence_id", F.aggregate("parts", F.lit(b"").cast("binary"),
                                               lambda done, part: F.concat(done, part["ids"])).alias("ids")))


def packed_pieces(docs: DataFrame, capacity: int = CAPACITY, paths: tuple[str, str] | None = None) -> DataFrame:
    """Pieces of all documents with their places, without the ids (kept apart by ``pieces``)."""
    return pack(written(pieces(docs, capacity, paths=paths, with_ids=False), "pack-pieces"), capacity).drop("place")
