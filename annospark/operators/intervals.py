"""Interval ensemble: clustering of domain hits + majority vote.

Hits are half-open intervals ``[seq_start, seq_end)`` per entry.  The
reference clusters the hits of each entry with DBSCAN(eps, min_samples=1)
applied to the rows of the Jaccard-distance matrix (Euclidean distance
between matrix rows, ``metric='rows'``) or to the matrix itself
(``metric='precomputed'``).  With min_samples=1 the clusters are the
connected components of the graph "distance <= eps".

Spark formulation (no all-pairs step):
* identical hits are collapsed into one node with a multiplicity ``w`` (they
  are at distance 0 and every copy votes);
* clusters never leave an island of overlapping intervals: small islands are
  solved whole, large ones in blocks of nodes (``operators.islands``);
* overlapping pairs (E2, C9) come from a bucketed overlap equi-join, so the work
  is proportional to the local overlap, not to the size of an entry;
* vote: +w/-w events at interval ends and a running sum per cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annospark.operators import islands
from annospark.operators.matrix import BLOCK_ITEMS, pairs_blocked
from annospark.session import cut_lineage

OVERLAP_BUCKET = 256          # positions per bucket of the overlap join
SWEEP_ROWS = 8192             # intervals per range of the sweep join
PLAIN_ROWS = 256              # intervals of an entry that are paired at once


def stack_models(dfs: Sequence[DataFrame]) -> DataFrame:
    """Union-all of model outputs (by column name)."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def collapse_hits(hits: DataFrame, entry: str = "entry", start: str = "seq_start", end: str = "seq_end") -> DataFrame:
    """Non-empty intervals as weighted nodes: (entry, s, e, w)."""
    return (hits.where(F.col(end) > F.col(start))
            .groupBy(F.col(entry).alias("entry"), F.col(start).alias("s"), F.col(end).alias("e"))
            .agg(F.count(F.lit(1)).alias("w")))


def overlap_pairs(nodes: DataFrame, bucket: int = OVERLAP_BUCKET, include_self: bool = False) -> DataFrame:
    """C9/C7 core: ordered pairs (i, j), i != j, of overlapping intervals of the same entry.

    Each interval is replicated into the position buckets it touches; pairs
    are joined on (entry, bucket) and kept only in the bucket where their
    overlap starts, so each pair is produced once.  Output columns:
    entry, s1, e1, w1, s2, e2, w2, inter.
    """
    def side(tag: str) -> DataFrame:
        return nodes.select(
            "entry", F.col("s").alias(f"s{tag}"), F.col("e").alias(f"e{tag}"), F.col("w").alias(f"w{tag}"),
            F.explode(F.sequence(F.floor(F.col("s") / bucket).cast("long"),
                                 F.floor((F.col("e") - 1) / bucket).cast("long"))).alias("b"))
    a, b = side("1"), side("2")
    lo = F.greatest(F.col("s1"), F.col("s2"))
    hi = F.least(F.col("e1"), F.col("e2"))
    cond = (lo < hi) & (F.floor(lo / bucket).cast("long") == F.col("b"))
    if not include_self:
        cond = cond & ((F.col("s1") != F.col("s2")) | (F.col("e1") != F.col("e2")))
    return (a.join(b, ["entry", "b"]).where(cond)
            .select("entry", "s1", "e1", "w1", "s2", "e2", "w2", (hi - lo).alias("inter")))


def jaccard_pairs(nodes: DataFrame, bucket: int = OVERLAP_BUCKET) -> DataFrame:
    """Jaccard similarity J and distance 1-J of every overlapping pair
    (including each node with itself, J = 1); pairs absent here have J = 0."""
    p = overlap_pairs(nodes, bucket, include_self=True)
    union = (F.col("e1") - F.col("s1")) + (F.col("e2") - F.col("s2")) - F.col("inter")
    j = F.col("inter").cast("double") / union.cast("double")
    return p.withColumn("jac", j).withColumn("dist", F.lit(1.0) - F.col("jac"))


def eps_clusters(hits: DataFrame, eps: float = 0.4, metric: str = "rows", entry: str = "entry",
                 start: str = "seq_start", end: str = "seq_end", small: int = islands.SMALL,
                 block: int = islands.BLOCK) -> DataFrame:
    """Cluster label (cs, ce) of every distinct hit, with its multiplicity w."""
    return islands.island_clusters(collapse_hits(hits, entry, start, end), eps, metric, small, block)


def majority_vote(clustered: DataFrame) -> DataFrame:
    """E4 + D7: per cluster keep positions covered by at least half of its hits
    (2*votes >= n); output the min and max kept position per cluster.

    Event sweep: +w at s, -w at e; coverage is constant on [p_i, p_{i+1}).  The
    weights that begin add up to n, so the clusters are read once.
    """
    key = ["entry", "cs", "ce"]
    event = lambda pos, dw, begun: F.struct(F.col(pos).alias("p"), dw.alias("dw"), begun.alias("begun"))
    weight = F.col("w")
    ends = F.array(event("s", weight, weight), event("e", -weight, weight - weight))
    events = (clustered.dropna(subset=key).select(*key, F.inline(ends))
              .groupBy(*key, "p").agg(F.sum("dw").alias("dw"), F.sum("begun").alias("begun")))
    w = Window.partitionBy(*key).orderBy("p")
    seg = (events.withColumn("cov", F.sum("dw").over(w.rowsBetween(Window.unboundedPreceding, 0)))
           .withColumn("next_p", F.lead("p").over(w))
           .withColumn("n", F.sum("begun").over(Window.partitionBy(*key))))
    kept = seg.where((F.col("cov") > 0) & (2 * F.col("cov") >= F.col("n")) & F.col("next_p").isNotNull())
    return kept.groupBy(*key).agg(F.min("p").alias("seq_start"), F.max(F.col("next_p") - 1).alias("seq_end"))


def ensemble(dfs: Sequence[DataFrame], eps: float = 0.4, metric: str = "rows", entry: str = "entry",
             start: str = "seq_start", end: str = "seq_end") -> DataFrame:
    """E5: stack -> cluster -> vote -> ranges; output (entry, seq_start, seq_end)."""
    hits = stack_models(dfs)
    voted = majority_vote(eps_clusters(hits, eps, metric, entry, start, end))
    return voted.select(F.col("entry").alias(entry), "seq_start", "seq_end")


def merge_intervals(df: DataFrame, keys: Sequence[str], start: str = "seq_start", end: str = "seq_end") -> DataFrame:
    """Union of half-open intervals per key as disjoint runs (keys..., s, e).

    Coverage sweep: +1/-1 events are first summed per (key, position) (map-side
    partial aggregation), so the ordered window per key sees at most two rows
    per distinct endpoint -- bounded by the sequence length, not by the number
    of hits of a hot key.  A run starts where coverage becomes positive and
    ends where it returns to zero; touching intervals merge.
    """
    k = list(keys)
    nonempty = df.where(F.col(end) > F.col(start))
    # both events of an interval from one row, so that the input is computed once and keeps its partitions
    ends = F.array(F.struct(F.col(start).alias("p"), F.lit(1).alias("d")), F.struct(F.col(end).alias("p"), F.lit(-1).alias("d")))
    events = nonempty.select(*k, F.inline(ends)).groupBy(*k, "p").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(*k).orderBy("p")
    cov = events.withColumn("cov", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    opens = (F.col("cov") > 0) & (F.col("cov") == F.col("d"))
    closes = (F.col("cov") == 0) & (F.col("d") < 0)
    # openings and closings alternate, so a run ends at the next row
    return (cov.where(opens | closes).withColumn("e", F.lead("p").over(w)).where(opens)
            .select(*k, F.col("p").alias("s"), "e"))


def interval_overlap_join(a: DataFrame, b: DataFrame, keys: Sequence[str], bucket: int = OVERLAP_BUCKET) -> DataFrame:
    """Overlapping pairs between two interval tables (keys..., s, e) on equal keys.

    Bucketed like ``overlap_pairs``: each pair is emitted once, in the bucket
    where the overlap begins.  Other columns of both sides are carried
    (they must not collide).  Output: ..., s1, e1, s2, e2, lo, hi.
    """
    k = list(keys)
    def side(df: DataFrame, tag: str) -> DataFrame:
        extra = [c for c in df.columns if c not in ("s", "e")]
        return df.select(*extra, F.col("s").alias(f"s{tag}"), F.col("e").alias(f"e{tag}"),
                         F.explode(F.sequence(F.floor(F.col("s") / bucket).cast("long"),
                                              F.floor((F.col("e") - 1) / bucket).cast("long"))).alias("_b"))
    lo = F.greatest(F.col("s1"), F.col("s2"))
    hi = F.least(F.col("e1"), F.col("e2"))
    return (side(a, "1").join(side(b, "2"), [*k, "_b"])
            .where((lo < hi) & (F.floor(lo / bucket).cast("long") == F.col("_b")))
            .select(*[c for c in a.columns if c not in ("s", "e")],
                    *[c for c in b.columns if c not in ("s", "e") and c not in k],
                    "s1", "e1", "s2", "e2", lo.alias("lo"), hi.alias("hi")))


def interval_join(dom: DataFrame, struct: DataFrame, entry: str = "entry", bucket: int = OVERLAP_BUCKET) -> DataFrame:
    """Overlapping (domain, structure) pairs of an entry with overlap length ``inter`` > 0.

    dom: (entry, seq_start, seq_end); struct: (entry, struct_id, s_start, s_end).  Empty intervals overlap nothing.
    """
    d = dom.where("seq_end > seq_start").withColumnsRenamed({"seq_start": "s", "seq_end": "e"})
    t = struct.where("s_end > s_start").withColumnsRenamed({"s_start": "s", "s_end": "e"})
    return (interval_overlap_join(d, t, [entry], bucket)
            .withColumnsRenamed({"s1": "seq_start", "e1": "seq_end", "s2": "s_start", "e2": "s_end"})
            .withColumn("inter", F.col("hi") - F.col("lo")).drop("lo", "hi"))


def sweep_join(dom: DataFrame, struct: DataFrame, entry: str = "entry", rows: int = SWEEP_ROWS) -> DataFrame:
    """C9 by a distributed sweep: overlapping (domain, structure) pairs with overlap length ``inter`` > 0.

    Both sides are dealt by range of (entry, start), so an entry with many
    intervals spans many ranges.  An interval is native to the range of its
    start and is carried into every later range that begins before its end: the
    active set of the sweep at that point.  Of an overlapping pair, the later
    start is native to one range, and there the other is native or carried; no
    range pairs two carried intervals, so each pair comes once.  Other columns
    of both sides are carried along (they must not collide).
    """
    def side(df: DataFrame, tag: int, start: str, end: str) -> DataFrame:
        rest = [c for c in df.columns if c not in (entry, start, end)]
        return df.where(F.col(end) > F.col(start)).select(
            F.lit(tag).alias("_side"), F.col(entry).alias("_entry"), F.col(start).cast("long").alias("_s"), F.col(end).cast("long").alias("_e"),
            (F.struct(*rest) if rest else F.lit(None).cast("string")).alias(f"_rest{tag}"))
    a, b = side(dom, 1, "seq_start", "seq_end"), side(struct, 2, "s_start", "s_end")
    both = a.unionByName(b, allowMissingColumns=True)
    ranges = max(1, -(-both.count() // rows))
    # written, so that an interval's range is the same for all readers
    dealt = cut_lineage(both.repartitionByRange(ranges, "_entry", "_s").withColumn("_range", F.spark_partition_id()))
    # one row for each range
    begins = dealt.groupBy(F.col("_range").alias("_to")).agg(F.min(F.struct("_entry", "_s")).alias("_begin"))
    begins = begins.select("_to", F.col("_begin._entry").alias("_entry"), F.col("_begin._s").alias("_from"))
    native = dealt.withColumn("_carried", F.lit(False))
    carried = (dealt.join(begins, "_entry").where((F.col("_to") > F.col("_range")) & (F.col("_from") < F.col("_e")))
               .withColumn("_range", F.col("_to")).select(*dealt.columns, F.lit(True).alias("_carried")))
    active = native.unionByName(carried)

    def of(tag: int) -> DataFrame:
        return active.where(F.col("_side") == tag).select("_range", "_entry", F.col("_s").alias(f"_s{tag}"), F.col("_e").alias(f"_e{tag}"),
                                                          F.col("_carried").alias(f"_c{tag}"), f"_rest{tag}")
    inter = F.least("_e1", "_e2") - F.greatest("_s1", "_s2")
    pairs = of(1).join(of(2), ["_range", "_entry"]).where((inter > 0) & ~(F.col("_c1") & F.col("_c2")))
    kinds = dict(dom.dtypes) | dict(struct.dtypes)

    def rest(df: DataFrame, tag: int, skip: tuple[str, ...]) -> list:
        return [F.col(f"_rest{tag}.{c}").alias(c) for c in df.columns if c not in (entry, *skip)]
    ends = [F.col(f"_{x}").cast(kinds[c]).alias(c) for x, c in (("s1", "seq_start"), ("e1", "seq_end"), ("s2", "s_start"), ("e2", "s_end"))]
    return pairs.select(F.col("_entry").alias(entry), *rest(dom, 1, ("seq_start", "seq_end")), *rest(struct, 2, ("s_start", "s_end")),
                        *ends, inter.cast(kinds["seq_start"]).alias("inter"))


def swept_pairs(dom: DataFrame, struct: DataFrame, entry: str = "entry", plain: int = PLAIN_ROWS, rows: int = SWEEP_ROWS) -> DataFrame:
    """C9 as ``sweep_join`` gives it, where most entries have few intervals.

    An entry with at most ``plain`` of them on either side is paired by one join
    on the entry, so by at most that many comparisons for each interval; only the
    others are dealt by range and swept.
    """
    def large(df: DataFrame) -> DataFrame:
        return df.groupBy(entry).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > plain).select(entry)
    many = cut_lineage(large(dom).join(large(struct), entry, "full").select(entry))
    inter = F.least("seq_end", "s_end") - F.greatest("seq_start", "s_start")

    def paired(d: DataFrame, s: DataFrame) -> DataFrame:
        full = d.where("seq_end > seq_start").join(s.where("s_end > s_start"), entry).where(inter > 0)
        return full.withColumn("inter", inter.cast(dict(dom.dtypes)["seq_start"]))
    if many.isEmpty():
        return paired(dom, struct)
    few = paired(dom.join(many, entry, "left_anti"), struct.join(many, entry, "left_anti"))
    return few.unionByName(sweep_join(dom.join(many, entry, "left_semi"), struct.join(many, entry, "left_semi"), entry, rows))


def pair_self_join(df: DataFrame, group: str, item: str, block: int = BLOCK_ITEMS) -> DataFrame:
    """Unordered pairs (i < j) of items inside a group.

    The output is quadratic in the group size by definition; items are hashed
    into blocks of about ``block`` and each block pair is its own join key, so a
    large group is paired by many tasks instead of one.
    """
    return pairs_blocked(df.select(group, item, F.lit(0).alias("_v")), group, item, "_v", block).select(group, "i", "j")
