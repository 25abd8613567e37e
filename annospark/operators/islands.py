"""Clusters of overlapping intervals by island (E2/E3 core).

An island is a maximal chain of overlapping intervals of an entry.  Hits of
different islands share no position, their Jaccard similarity is 0 and their
row distance at least sqrt(2), so with eps < 1 every cluster lies in one
island, and the distances of an island follow from its own nodes alone.

* islands of up to ``SMALL`` distinct intervals are dealt whole, in one
  exchange on (entry, island), and solved there as dense matrices, all islands
  of one size together;
* a larger island is dealt in blocks of nodes: each block meets the island's
  nodes, keeps the pairs that its exact prefilter leaves and sums their
  distances, so a hot region is spread over as many tasks as it has blocks;
  the clusters follow from the edges by contraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annospark.session import cut_lineage

EPS_SLACK = 1e-12             # float slack when comparing distances with eps
SMALL = 128                   # nodes of an island solved whole
BLOCK = 512                   # nodes of a larger island per task
CELLS = 1 << 21               # matrix cells held at once in a task


def with_islands(nodes: DataFrame) -> DataFrame:
    """nodes (entry, s, e, ...) with ``island`` (its first position) and ``n`` (its distinct intervals).

    The window sees one row for each distinct start of an entry, so at most its length.
    """
    starts = nodes.groupBy("entry", "s").agg(F.max("e").alias("e"), F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("entry").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("entry").orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max("e").over(before)
    marked = starts.withColumn("first", F.when(reach.isNull() | (reach <= F.col("s")), F.col("s")))
    placed = marked.withColumn("island", F.last("first", ignorenulls=True).over(upto))
    sized = placed.withColumn("n", F.sum("c").over(Window.partitionBy("entry", "island")))
    return nodes.join(sized.select("entry", "s", "island", "n"), ["entry", "s"])


def similarity(s1: np.ndarray, e1: np.ndarray, s2: np.ndarray, e2: np.ndarray) -> np.ndarray:
    """Jaccard similarity of intervals, by broadcasting."""
    inter = np.maximum(0, np.minimum(e1, e2) - np.maximum(s1, s2))
    return inter / ((e1 - s1) + (e2 - s2) - inter)


def solve(s: np.ndarray, e: np.ndarray, w: np.ndarray, eps: float, metric: str) -> np.ndarray:
    """Cluster (index of its first node) of each node of m islands of n nodes each, given as (m, n)."""
    m, n = s.shape
    jac = similarity(s[:, :, None], e[:, :, None], s[:, None, :], e[:, None, :])
    if metric == "precomputed":
        near = 1.0 - jac <= eps + EPS_SLACK
    else:
        weighted = jac * w[:, None, :]
        square = (weighted * jac).sum(axis=2)
        d2 = square[:, :, None] + square[:, None, :] - 2.0 * (weighted @ jac)
        near = d2 <= eps * eps + EPS_SLACK
    near[:, np.arange(n), np.arange(n)] = True
    label = np.broadcast_to(np.arange(n), (m, n))
    while True:
        low = np.where(near, label[:, None, :], n).min(axis=2)
        if (low == label).all():
            return label
        label = low


def _solved(eps: float, metric: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entries, lists = batch.column("entry"), batch.column("nodes")
            bounds = np.asarray(lists.offsets)
            flat = lists.values
            s, e, w = (flat.field(k).to_numpy().astype(np.int64) for k in range(3))
            sizes = np.diff(bounds)
            first = np.zeros(len(s), np.int64)
            for n in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == n)
                for part in np.array_split(rows, max(1, -(-len(rows) * n * n // CELLS))):
                    at = bounds[part][:, None] + np.arange(n)
                    found = solve(s[at], e[at], w[at].astype(float), eps, metric)
                    first[at] = bounds[part][:, None] + found
            owner = np.repeat(np.arange(len(sizes)), sizes)
            yield pa.RecordBatch.from_arrays(
                [entries.take(pa.array(owner)), flat.field(0), flat.field(1), flat.field(2), flat.field(0).take(pa.array(first)),
                 flat.field(1).take(pa.array(first))], ["entry", "s", "e", "w", "cs", "ce"])
    return run


def block_edges(s: np.ndarray, e: np.ndarray, w: np.ndarray, own: np.ndarray, eps: float, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i in ``own``, i < j, of the island's nodes within ``eps``."""
    left, right, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], len(s)
    step = max(1, CELLS // n)
    limit = eps * eps + EPS_SLACK
    for at in range(0, len(own), step):
        i = own[at:at + step]
        dist = 1.0 - similarity(s[i, None], e[i, None], s[None, :], e[None, :])
        later = np.arange(n) > i[:, None]
        if metric == "precomputed":
            a, b = np.nonzero(later & (dist <= eps + EPS_SLACK))
            left.append(i[a])
            right.append(b)
            continue
        # the terms k = i and k = j alone give d2 >= (w_i + w_j) * D_ij^2
        a, b = np.nonzero(later & ((w[i, None] + w[None, :]) * dist * dist <= limit))
        for cut in range(0, len(a), step):
            p, q = a[cut:cut + step], b[cut:cut + step]
            other = 1.0 - similarity(s[q, None], e[q, None], s[None, :], e[None, :])
            d2 = ((dist[p] - other) ** 2 * w).sum(axis=1)
            left.append(i[p[d2 <= limit]])
            right.append(q[d2 <= limit])
    return np.concatenate(left), np.concatenate(right)


def contracted(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b; any ordered type): (node, root), root the least node.

    Each round every node hooks onto its least neighbour, hooks are shortened
    once and the graph is contracted, so at least half of its nodes vanish.
    """
    edges = cut_lineage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = cut_lineage(both.groupBy("a").agg(F.min("b").alias("low"))
                           .select(F.col("a").alias("node"), F.least("a", "low").alias("up")))
        jump = hook.select(F.col("node").alias("up"), F.col("up").alias("root"))
        step = cut_lineage(hook.join(jump, "up").select("node", "root"))
        rounds.append(step)
        left = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = cut_lineage(edges.join(left, "a").join(right, "b").where("ra <> rb")
                            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = rounds[-1]
    for earlier in reversed(rounds[:-1]):   # nodes absent from a later round keep the root they had
        later = out.select(F.col("node").alias("root"), F.col("root").alias("top"))
        out = earlier.join(later, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return out


def _large(nodes: DataFrame, eps: float, metric: str, block: int) -> DataFrame:
    """Clusters of the nodes of large islands."""
    kinds = dict(nodes.dtypes)
    number = F.col("n") / block
    own = F.pmod(F.xxhash64("s", "e"), F.ceil(number).cast("long"))
    dealt = nodes.withColumn("own", own).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(number).cast("long") - 1)))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("s", "ascending"), ("e", "ascending")])
        s, e, w = (table.column(c).to_numpy().astype(np.int64) for c in ("s", "e", "w"))
        mine = np.flatnonzero(table.column("own").to_numpy() == key[2].as_py())
        i, j = block_edges(s, e, w.astype(float), mine, eps, metric) if len(mine) else (mine, mine)
        i, j = pa.array(i), pa.array(j)
        entry, first, last = table.column("entry"), table.column("s"), table.column("e")
        return pa.table([entry.take(i), first.take(i), last.take(i), first.take(j), last.take(j)], ["entry", "s1", "e1", "s2", "e2"])
    schema = f"entry {kinds['entry']}, s1 {kinds['s']}, e1 {kinds['e']}, s2 {kinds['s']}, e2 {kinds['e']}"
    edges = dealt.groupBy("entry", "island", "block").applyInArrow(run, schema)

    def node(tag: str):
        return F.struct(F.col("entry").alias("entry"), F.col(f"s{tag}").alias("s"), F.col(f"e{tag}").alias("e"))
    roots = contracted(edges.select(node("1").alias("a"), node("2").alias("b")))
    roots = roots.select("node.entry", "node.s", "node.e", F.col("root.s").alias("cs"), F.col("root.e").alias("ce"))
    return (nodes.join(roots, ["entry", "s", "e"], "left")
            .select("entry", "s", "e", "w", F.coalesce("cs", "s").alias("cs"), F.coalesce("ce", "e").alias("ce")))


def island_clusters(nodes: DataFrame, eps: float, metric: str = "rows", small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """(entry, s, e, w, cs, ce): the cluster of each node, named by its first node."""
    if metric not in ("rows", "precomputed"):
        raise ValueError("metric must be 'rows' or 'precomputed'")
    if not 0 <= eps < 1:
        raise ValueError("islands hold whole clusters only for eps below 1")
    placed = cut_lineage(with_islands(nodes))
    single = placed.where("n = 1").select("entry", "s", "e", "w", F.col("s").alias("cs"), F.col("e").alias("ce"))
    kinds = dict(nodes.dtypes)
    schema = ", ".join(f"{c} {kinds[t]}" for c, t in zip(("entry", "s", "e", "w", "cs", "ce"), ("entry", "s", "e", "w", "s", "e"), strict=True))
    whole = (placed.where(f"n BETWEEN 2 AND {small}").groupBy("entry", "island")
             .agg(F.array_sort(F.collect_list(F.struct("s", "e", "w"))).alias("nodes"))   # at most ``small`` nodes
             .select("entry", "nodes").mapInArrow(_solved(eps, metric), schema))
    large = placed.where(F.col("n") > small)
    out = single.unionByName(whole)
    return out if large.isEmpty() else out.unionByName(_large(large, eps, metric, block))
