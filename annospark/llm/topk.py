"""Exact top-k search by distributed histogram selection.

Queries and candidates are cut into blocks of bounded size; every pair of a
query block and a candidate block is one row, made where the candidate block
lies, and scores everything in it.  A query's k-th highest score is located by refining
histograms: each round splits the interval known to hold it into equal bins,
every pair of blocks counts its scores by bin, Spark adds the counts up, and the bin in
which the count from above reaches k is the next interval.  When the interval
is one score wide, that score is the threshold: all scores above it are
results, and those equal to it fill up by smallest id.

A pair reports only its bins from the top down to its own k-th score (the k-th
of all scores cannot be lower), and of scores equal to the threshold only the
k smallest ids (no other can win), so what a pair reports is bounded by k.

Defined results: rows with a null id or vector, or with a null or non-finite
component, take no part.  A shorter vector counts as if filled up with zeros,
an empty one scores 0.  Components and scores beyond the range of a long are
held at its ends; sums are exact before that.  Rows that repeat an id count
each as a candidate and each as a query; a query never meets rows of its own
id.  Fewer than k candidates are all returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annospark.llm.common import prefix_sums, unsized, written

K, STEP, SCALE = 20, 20, 64
#: Rows of a block of queries, of candidates; bins of a round.
QUERIES, CANDIDATES, BINS = 1024, 4096, 256

BLOCK = "ids binary, width int, vectors binary"


def integer_vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, q: array<long> of floor(scale * x) with x as double."""
    clean = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"),
                              F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    clean = clean.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & finite)

    def held(v):
        # 2^63 is a double; the largest double below it is a long
        return F.when(v >= 2.0 ** 63, F.lit(2 ** 63 - 1)).when(v < -2.0 ** 63, F.lit(-2 ** 63)).otherwise(F.floor(v))
    return clean.select("vec_id", F.transform("x", lambda v: held(v * scale)).alias("q"))


def _blocks(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    """(block, ids, width, vectors): blocks of ``size`` rows, numbered from 0; and their number."""
    rows = rows.select("vec_id", "q", F.xxhash64("vec_id", "q").alias("key"), F.lit(1).cast("long").alias("one"))
    placed = prefix_sums(rows, ["key", "vec_id"], "one", "place", name=name + "-order")
    dealt = placed.select("vec_id", "q", F.floor(F.col("place") / size).alias("block"))

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        lists = table.column("q").to_pylist()
        vectors = np.zeros((len(lists), max(map(len, lists))), np.int64)
        for i, x in enumerate(lists):
            vectors[i, :len(x)] = x
        small = vectors.astype(np.int16)
        vectors = small if (small == vectors).all() else vectors
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()),
                         "ids": [table.column("vec_id").to_numpy().astype(np.int64).tobytes()],
                         "width": pa.array([vectors.itemsize], pa.int32()), "vectors": [vectors.tobytes()]})
    packed = written(dealt.groupBy("block").applyInArrow(pack, f"block long, {BLOCK}"), name)
    return packed, packed.count()


def _pairs(queries: tuple[DataFrame, int], candidates: tuple[DataFrame, int], name: str) -> DataFrame:
    """Each query block with each candidate block: (q_block, q_ids, q_width, ..., c_vectors).

    A query block, the lesser of the two, goes to every candidate block; a candidate block moves once.
    """
    def side(blocks: DataFrame, tag: str) -> DataFrame:
        return blocks.select(F.col("block").alias(f"{tag}_block"), *[F.col(c).alias(f"{tag}_{c}") for c in ("ids", "width", "vectors")])
    (q, _), (c, n_c) = queries, candidates
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(n_c, 1) - 1).cast("long")))   # without candidates, no row meets it
    met = side(q, "q").select("*", each.alias("c_block"))
    return written(met.join(unsized(side(c, "c")), "c_block"), name)


def _scores(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, candidate ids, scores."""
    ids, others = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["c_ids"], np.int64)
    q = np.frombuffer(row["q_vectors"], f"i{row['q_width']}").reshape(len(ids), -1)
    c = np.frombuffer(row["c_vectors"], f"i{row['c_width']}").reshape(len(others), -1)
    both = min(q.shape[1], c.shape[1])   # further components meet zeros
    q, c = q[:, :both], c[:, :both]
    most = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(c.astype(np.float64)).max(initial=0)) * q.shape[1]
    for kind, whole in ((np.float32, 2.0 ** 24), (np.float64, 2.0 ** 53)):  # up to there they add integers exactly
        if most < whole:
            return ids, others, (q.astype(kind) @ c.T.astype(kind)).astype(np.int64)
    if most < 2.0 ** 62:
        return ids, others, q.astype(np.int64) @ c.T.astype(np.int64)
    exact = q.astype(object) @ c.T.astype(object)   # whole numbers of any size
    return ids, others, np.clip(exact, _OWN + 1, -_OWN - 1).astype(np.int64)


_OWN = int(np.iinfo(np.int64).min)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


def _own(ids: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of a score table where a query meets its own id."""
    order = np.argsort(others, kind="stable")
    low = np.searchsorted(others[order], ids, "left")
    high = np.searchsorted(others[order], ids, "right")
    rows = np.repeat(np.arange(len(ids)), high - low)
    columns = [order[a:b] for a, b in zip(low, high, strict=True) if b > a]
    return rows, np.concatenate(columns) if columns else rows


def _extremes(pairs: DataFrame) -> DataFrame:
    """q_block, place, low, high, n: range and number of each query's scores; a query's place is that in its block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            ids, others, scores = _scores(row)
            r, c = _own(ids, others)
            scores[r, c] = _OWN
            high = scores.max(1)
            scores[r, c] = np.iinfo(np.int64).max
            n = len(others) - np.bincount(r, minlength=len(ids))
            some = np.flatnonzero(n > 0)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(some), row["q_block"]), some, scores.min(1)[some],
                                                                    high[some], n[some])],
                                             ["q_block", "place", "low", "high", "n"])
    each = pairs.mapInArrow(run, "q_block long, place long, low long, high long, n long")
    return each.groupBy("q_block", "place").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))


def _with_state(pairs: DataFrame, state: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs with the states of their queries as bytes, one row of state a query block."""
    names = ["place", *columns]

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        return pa.table({"q_block": pa.array([key[0].as_py()], pa.int64()),
                         **{c: [table.column(c).to_numpy().astype(np.int64).tobytes()] for c in names}})
    packed = (state.select("q_block", *names).groupBy("q_block")
              .applyInArrow(pack, "q_block long, " + ", ".join(f"{c} binary" for c in names)))
    return pairs.join(packed, "q_block")


def _own_kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th score of each row of a table, its least if there are fewer."""
    n = scores.shape[1]
    return np.partition(scores, n - k, axis=1)[:, n - k] if n > k else scores.min(1)


def _bins(pairs: DataFrame, k: int, bins: int) -> DataFrame:
    """q_block, place, bin, n: counts of the scores in the interval that the pair's own k-th does not rule out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            ids, others, scores = _scores(row)
            scores[_own(ids, others)] = _OWN
            place, low, high = (np.frombuffer(row[c], np.int64) for c in ("place", "low", "high"))
            own = scores[place]
            r, c = np.nonzero((own >= np.maximum(low, _own_kth(own, k))[:, None]) & (own <= high[:, None]))
            # differences of longs need not be longs, but are unsigned ones
            width = (high.view(np.uint64) - low.view(np.uint64)) // np.uint64(bins) + np.uint64(1)
            place_in = (own[r, c].astype(np.uint64) - low[r].astype(np.uint64)) // width[r]
            cell, n = np.unique(r * bins + place_in.astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(cell), row["q_block"]), place[cell // bins],
                                                                    cell % bins, n)], ["q_block", "place", "bin", "n"])
    return pairs.mapInArrow(run, "q_block long, place long, bin long, n long")


def _winners(pairs: DataFrame, k: int) -> DataFrame:
    """All scores above the threshold, and of those equal to it each pair's k smallest ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            ids, others, scores = _scores(row)
            scores[_own(ids, others)] = _OWN
            place, low = np.frombuffer(row["place"], np.int64), np.frombuffer(row["low"], np.int64)
            own = scores[place]
            r, c = np.nonzero(own > low[:, None])
            tr, tc = np.nonzero(own == low[:, None])
            order = np.lexsort((others[tc], tr))
            tr, tc = tr[order], tc[order]
            first = np.searchsorted(tr, np.arange(len(place)))
            few = np.arange(len(tr)) - first[tr] < k
            r, c = np.r_[r, tr[few]], np.r_[c, tc[few]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(r), row["q_block"]), place[r], ids[place[r]],
                                                                    others[c], own[r, c])],
                                             ["q_block", "place", "query_id", "vec_id", "score"])
    return pairs.mapInArrow(run, "q_block long, place long, query_id long, vec_id long, score long")


def exact_top_k(embeddings: DataFrame, k: int = K, step: int = STEP, scale: int = SCALE, bins: int = BINS) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of every query row
    (vec_id divisible by ``step``) among all rows of other ids, ties to the smaller vec_id."""
    vectors = written(integer_vectors(embeddings, scale), "topk-vectors")
    queries = _blocks(vectors.where(F.col("vec_id") % step == 0), QUERIES, "topk-queries")
    pairs = _pairs(queries, _blocks(vectors, CANDIDATES, "topk-candidates"), "topk-pairs")
    one = ["q_block", "place"]
    state = written(_extremes(pairs).withColumn("need", F.least(F.lit(k).cast("long"), "n")).drop("n"), "topk-state")
    # the interval holds the score of rank ``need`` among the scores not above it
    while not (wide := state.where("low < high")).isEmpty():
        counts = _bins(_with_state(pairs, wide, ["low", "high"]), k, bins).groupBy(*one, "bin").agg(F.sum("n").alias("n"))
        above = Window.partitionBy(*one).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
        reached = (counts.withColumn("above", F.coalesce(F.sum("n").over(above), F.lit(0)))
                   .join(wide, one).where("above < need AND above + n >= need"))
        low, high = (F.col(c).cast("decimal(20,0)") for c in ("low", "high"))
        width = (F.floor((high - low) / F.lit(bins).cast("decimal(9,0)")) + 1).cast("decimal(20,0)")
        start = low + F.col("bin").cast("decimal(9,0)") * width
        narrowed = reached.select(*one, start.cast("long").alias("low"), F.least(start + width - 1, high).cast("long").alias("high"),
                                  (F.col("need") - F.col("above")).alias("need"))
        state = written(state.where("low >= high").unionByName(narrowed), "topk-state")
    best = _winners(_with_state(pairs, state, ["low"]), k)
    order = Window.partitionBy(*one).orderBy(F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
