"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint's bit i gets a vector m(i) of radius + 1 bits; the mask of every
non-zero vector v keeps the bits with <m(i), v> odd.  At most ``radius``
differing bits give at most ``radius`` equations <m(i), v> = 0, which always
have a non-zero solution: under that mask both fingerprints are equal.  So each
pair within the radius shares a bucket in at least one of 2^(radius+1) - 1
tables, with no chance of a miss.

Defined results: null, empty and white-space texts have fingerprint 0 and are
linked like others; repeated rows share a fingerprint; a null doc_id counts as
larger than all others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annospark.llm.common import components, unsized, written

SHINGLE, RADIUS = 4, 4
#: Members of a bucket compared in one group; larger buckets are split into pairs of blocks.
BLOCK = 1024
#: Groups up to this size are compared by shifts over a whole batch at once.
SMALL = 32

_BIT = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_BYTE = (np.arange(8) * 256).astype(np.uint16)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint: majority of the bits of the shingles' XXH64."""
    words = text.lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        line = b" ".join(words)
        ends = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        starts = [0, *(ends + 1).tolist()]
        stops = [*ends[shingle - 1:].tolist(), len(line)]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], 42) for a, b in zip(starts, stops, strict=False)]
    h = np.array(hashes, np.uint64)
    seen = np.bincount((h.view(np.uint8).reshape(-1, 8) + _BYTE).ravel(), minlength=2048).reshape(8, 256)
    bits = (2 * (seen @ _BIT) > len(h)).astype(np.uint8)
    return int(np.packbits(bits, axis=1, bitorder="little").ravel().view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, sig (hash of id and text), fp."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x.as_py(), shingle) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("sig"), pa.array(fps, pa.int64())],
                                             ["doc_id", "sig", "fp"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("sig"),
                       F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, sig long, fp long")


def covering_masks(radius: int = RADIUS) -> list[int]:
    """2^(radius+1) - 1 masks as signed longs; each keeps about half of the bits."""
    n = (1 << (radius + 1)) - 1
    vectors = [i % n + 1 for i in range(64)]
    masks = [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, n + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    # counted without sign: of a negative number numpy counts the bits of its absolute value
    return np.bitwise_count((a ^ b).view(np.uint64)) <= radius


def _forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what links within the radius connect, without listing all links."""
    a, b = [], []
    left = np.arange(len(fps))
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            i = front.pop()
            near = _near(fps[left], fps[i], radius)
            hit = left[near]
            if len(hit):
                a.append(np.full(len(hit), i))
                b.append(hit)
                front.extend(hit.tolist())
                left = left[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (left[:0], left[:0])


def _links(group: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges within runs of equal ``group``."""
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[start, len(group)])
    a, b = [], []
    small = np.repeat(size <= SMALL, size)
    end = np.repeat(start + size, size)
    for shift in range(1, int(min(size.max(), SMALL))):
        i = np.flatnonzero(small & (np.arange(len(group)) + shift < end))
        i = i[_near(fps[i], fps[i + shift], radius)]
        a.append(i)
        b.append(i + shift)
    for s, n in zip(start[size > SMALL], size[size > SMALL], strict=True):
        x, y = _forest(fps[s:s + n], radius)
        a.append(x + s)
        b.append(y + s)
    if not a:
        return fps[:0], fps[:0]
    return fps[np.concatenate(a)], fps[np.concatenate(b)]


def links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` whose closure is that of all
    pairs within ``radius`` bits.

    Buckets of one fingerprint go at once.  A bucket over ``block`` members is cut
    into blocks by hash, and every pair of its blocks is a group of its own, so no
    group grows with the data; a group gives a forest, not all its pairs.
    """
    keys = F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m))) for t, m in enumerate(covering_masks(radius))])
    tables = fps.select("fp", F.explode(keys).alias("bucket"))
    # counted and joined, so that not even the members of one bucket meet in a task before they are cut
    counts = tables.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = tables.join(unsized(counts), "bucket")
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64(F.col("fp"), F.lit(7)), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = (members.select("fp", "bucket", blocks.alias("blocks"), own.alias("own"))
             .select("fp", "bucket", "own", "blocks", other.alias("other"))
             .select("fp", F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("cell")))
    dealt = cells.repartition("cell").sortWithinPartitions("cell", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out(group: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
            a, b = _links(group, values, radius)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
        for batch in batches:
            cell = np.r_[cell, batch.column("cell").to_numpy()]
            fp = np.r_[fp, batch.column("fp").to_numpy()]
            if len(cell):
                cut = int(np.searchsorted(cell, cell[-1]))  # the last group may go on
                if cut:
                    yield out(cell[:cut], fp[:cut])
                    cell, fp = cell[cut:], fp[cut:]
        if len(cell):
            yield out(cell, fp)
    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, sig, fp, component_id (smallest doc_id that links reach), keep.

    ``keep`` marks the rows of the component's smallest (doc_id, sig); only rows
    that repeat each other share that mark.  Copies meet by fingerprint first, so
    the tables hold each distinct fingerprint once.
    """
    rows = written(fingerprints(docs, shingle), "simhash-rows")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sig")
    distinct = written(rows.groupBy("fp").agg(F.min(first).alias("first")), "simhash-distinct")
    roots = components(links(distinct.select("fp"), radius), "simhash")
    classes = (distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
               .select("fp", "first", F.coalesce("root", "fp").alias("root")))
    classes = written(classes, "simhash-classes")
    lowest = classes.groupBy("root").agg(F.min("first").alias("lowest"))
    named = classes.join(unsized(lowest), "root").select("fp", "lowest")
    return rows.join(unsized(named), "fp").select(
        "doc_id", "sig", "fp", F.col("lowest.doc_id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("lowest.doc_id")) & (F.col("sig") == F.col("lowest.sig"))).alias("keep"))


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Rows of ``docs`` without all but one document of each component."""
    kept = (near_duplicates(docs, shingle, radius).where("keep")
            .groupBy(F.col("sig").alias("__sig")).agg(F.count(F.lit(1)).alias("__n")))
    columns = docs.columns
    rows = docs.select(F.struct(*columns).alias("__row"), F.xxhash64("doc_id", "text").alias("__sig"))
    rows = rows.join(unsized(kept), "__sig")
    # only rows that repeat each other need a second look
    single = rows.where("__n = 1").select("__row")
    repeated = rows.where("__n > 1").dropDuplicates(["__sig"]).select("__row")
    return single.unionByName(repeated).select(*[F.col("__row")[c].alias(c) for c in columns])
