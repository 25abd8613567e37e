"""Ontology graph operators.

Graph model: ``nodes(term, label)`` holds the labelled, non-obsolete terms;
``edges(child, parent)`` holds the ``is_a`` relations (endpoints need not be
labelled).  Ancestors and descendants (F4/F5) are the transitive closure,
handed down level by level with minimum path length.  What only moves values up
the graph needs no closure: ``edge_levels`` peels it into topological levels,
``depth_from_roots`` walks it down once.
"""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annospark.session import cut_lineage, ensure_checkpoint_dir


class OntologyCycleError(RuntimeError):
    """The is_a graph has a cycle (the walk would never end)."""


def parents(edges: DataFrame) -> DataFrame:
    """child -> sorted list of distinct is_a parents."""
    return (edges.groupBy("child")
            .agg(F.array_sort(F.collect_set("parent")).alias("parents")))


def labels(nodes: DataFrame) -> DataFrame:
    """labelled term -> label."""
    return nodes.select("term", "label")


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """labelled terms without any parent."""
    return nodes.join(edges.select(F.col("child").alias("term")), "term", "left_anti")


def _handed_down(own: DataFrame, known: DataFrame, kind: str) -> DataFrame:
    """(child, ancestor, dist): of each edge the parent and its list, as arrays."""
    # merged: files hold the lists in far less than their size, and Spark would broadcast them
    return own.join(known.hint("merge"), "parent", "left").select(
        "child", F.concat(F.array("parent"), F.coalesce("ancestors", F.array().cast(f"array<{kind}>"))).alias("ancestor"),
        F.concat(F.array(F.lit(1)), F.coalesce(F.transform("dists", lambda d: d + 1), F.array().cast("array<int>"))).alias("dist"))


def closure_lists(edges: DataFrame) -> DataFrame:
    """(term, ancestors, dists): the ancestors of every child with the fewest is_a steps to each, as two arrays.

    Terms are taken by ``edge_levels`` from the top down, so that the lists of a
    term's parents are ready before its own: an edge moves its parent's list
    once, and no path is composed twice.  A list holds the ancestors of one
    term; lists are written by level.
    """
    spark = edges.sparkSession
    levels = edge_levels(edges)   # fails on a cycle
    top = levels.agg(F.max("level")).first()[0]
    kinds = dict(edges.dtypes)
    schema = f"term {kinds['child']}, ancestors array<{kinds['parent']}>, dists array<int>"
    if top is None:
        return spark.createDataFrame([], schema)
    path = f"{ensure_checkpoint_dir(spark)}/closure-{uuid.uuid4().hex}"
    for level in range(top, -1, -1):
        own = levels.where(F.col("level") == level).select("child", "parent")
        none = spark.createDataFrame([], schema)
        known = (none if level == top else spark.read.schema(schema).parquet(path)).withColumnRenamed("term", "parent")
        met = _handed_down(own, known, kinds["parent"])
        lists = met.groupBy("child").agg(F.collect_list(F.struct("ancestor", "dist")).alias("_lists"))   # one for each parent
        pairs = F.flatten(F.transform("_lists", lambda x: F.arrays_zip(x["ancestor"].alias("ancestor"), x["dist"].alias("dist"))))
        ordered = lists.select("child", F.array_sort(pairs).alias("_pairs"))
        first = F.filter("_pairs", lambda x, i: (i == 0) | (x["ancestor"] != F.get("_pairs", i - 1)["ancestor"]))
        (ordered.select("child", first.alias("_pairs"))
         .select(F.col("child").alias("term"), F.col("_pairs.ancestor").alias("ancestors"), F.col("_pairs.dist").alias("dists"))
         .write.mode("append").parquet(path))
    return spark.read.schema(schema).parquet(path)


def closure_rows(lists: DataFrame) -> DataFrame:
    """(descendant, ancestor, dist): the rows of ``closure_lists``."""
    pairs = F.arrays_zip(F.col("ancestors").alias("ancestor"), F.col("dists").alias("dist"))
    return lists.select(F.col("term").alias("descendant"), F.inline(pairs))


def closure_with_distance(edges: DataFrame) -> DataFrame:
    """All (descendant, ancestor, dist) pairs, dist = fewest is_a steps."""
    return closure_rows(closure_lists(edges))


def closure_bfs(edges: DataFrame) -> DataFrame:
    """Same table as ``closure_with_distance`` by semi-naive breadth-first
    expansion: layer r holds the pairs whose shortest path has exactly r
    steps; layer r+1 = layer r extended by one is_a edge, minus every pair
    already known.  Moves only O(closure x parents) rows in total; one
    checkpointed layer per level (ontologies are ~15-20 levels deep).
    """
    e = (edges.select(F.col("child").alias("mid"), F.col("parent").alias("ancestor"))
         .where(F.col("mid").isNotNull() & F.col("ancestor").isNotNull()).distinct())
    e = cut_lineage(e)
    layer = cut_lineage(e.select(F.col("mid").alias("descendant"), "ancestor", F.lit(1).alias("dist")))
    known = layer
    for level in itertools.count(2):
        nxt = (layer.select("descendant", F.col("ancestor").alias("mid"))
               .join(e, "mid").select("descendant", "ancestor").distinct()
               .join(known.select("descendant", "ancestor"), ["descendant", "ancestor"], "left_anti")
               .select("descendant", "ancestor", F.lit(level).alias("dist")))
        nxt = cut_lineage(nxt)
        if nxt.isEmpty():
            break
        if not nxt.where(F.col("descendant") == F.col("ancestor")).isEmpty():
            raise OntologyCycleError("is_a graph contains a cycle")
        known = known.unionByName(nxt)
        layer = nxt
    if not known.where(F.col("descendant") == F.col("ancestor")).isEmpty():
        raise OntologyCycleError("is_a graph contains a cycle")
    return cut_lineage(known)


def _labelled(nodes: DataFrame, closure: DataFrame) -> DataFrame:
    """Closure rows of labelled descendants; lists are joined before they become rows."""
    lists = "ancestors" in closure.columns
    key = "term" if lists else "descendant"
    kept = closure.join(nodes.select(F.col("term").alias(key)), key, "left_semi")
    return closure_rows(kept) if lists else kept


#: Terms of a block of ``blocked_lists`` (a power of two).
BLOCK_TERMS = 64


def _beginnings() -> list[Column]:
    """Keys of fixed size by which lists of ancestors with a common beginning lie together, the longer the closer."""
    return [F.xxhash64(F.slice("ancestors", 1, n)) for n in (8, 16, 32, 64)]


def blocked_lists(nodes: DataFrame, lists: DataFrame) -> DataFrame:
    """F5 as lists: (block, term, ancestors) of the labelled terms, terms of like ancestors together in blocks of ``BLOCK_TERMS``.

    The lists are sorted by their ancestors, so that the terms of a block share most of them; written, so that a term's
    block is the same for all readers.  Ranges are dealt by hashes of the lists' beginnings: the driver samples the keys
    of the ranges, and whole lists would fill it.
    """
    spark = lists.sparkSession
    kept = lists.join(nodes.select("term").hint("merge"), "term", "left_semi").select("term", "ancestors")
    # the partition in the upper bits, the place in it in the lower ones
    place = F.monotonically_increasing_id()
    path = f"{ensure_checkpoint_dir(spark)}/blocks-{uuid.uuid4().hex}"
    out = kept.repartitionByRange(*_beginnings(), "term").sortWithinPartitions("ancestors", "term").select(
        F.shiftright(place, BLOCK_TERMS.bit_length() - 1).alias("block"), "term", "ancestors")
    out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def ancestors(nodes: DataFrame, closure: DataFrame) -> DataFrame:
    """(term, ancestor) for labelled terms, as a set; ``closure`` as rows or as lists."""
    return _labelled(nodes, closure).select(F.col("descendant").alias("term"), "ancestor")


def descendants(nodes: DataFrame, closure: DataFrame) -> DataFrame:
    """(term, descendant) with labelled descendants only; leaves have no rows; ``closure`` as rows or as lists."""
    return _labelled(nodes, closure).select(F.col("ancestor").alias("term"), "descendant")


def depth(nodes: DataFrame, edges: DataFrame, closure: DataFrame) -> DataFrame:
    """(term, depth) = fewest steps from a labelled term to a root; roots 0.

    Terms whose ancestors never reach a root get no row.
    """
    root_ids = roots(nodes, edges).select(F.col("term").alias("ancestor"))
    via_root = (closure.join(root_ids, "ancestor", "left_semi")
                .join(nodes.select(F.col("term").alias("descendant")), "descendant", "left_semi")
                .groupBy(F.col("descendant").alias("term")).agg(F.min("dist").alias("depth")))
    at_root = root_ids.select(F.col("ancestor").alias("term"), F.lit(0).alias("depth"))
    return at_root.unionByName(via_root)


def edge_levels(edges: DataFrame) -> DataFrame:
    """(child, parent, level): edges by the level of their child, the longest path from it down to a leaf.

    Each round takes the terms that are nobody's parent any more, with their
    edges; a value pushed along the levels in order has then met all of a
    term's children before the term's own edges are used.
    """
    left = cut_lineage(edges.select("child", "parent").where(F.col("child").isNotNull() & F.col("parent").isNotNull()).distinct())
    levels: list[DataFrame] = []
    for level in itertools.count():
        if left.isEmpty():
            break
        inner = left.select(F.col("parent").alias("child")).distinct()
        levels.append(left.join(inner, "child", "left_anti").withColumn("level", F.lit(level)))
        left = cut_lineage(left.join(inner, "child", "left_semi"))
        levels[-1] = cut_lineage(levels[-1])
        if levels[-1].isEmpty():
            raise OntologyCycleError("is_a graph contains a cycle")
    out = edges.select("child", "parent").limit(0).withColumn("level", F.lit(0))
    for part in levels:
        out = out.unionByName(part)
    # as many partitions as one level, so that a deep graph's levels are not read by thousands of tasks
    return cut_lineage(out.coalesce(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def depth_from_roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """F6 without the closure: (term, depth), a walk down from the roots that uses every edge once."""
    e = cut_lineage(edges.select(F.col("parent").alias("up"), F.col("child").alias("term"))
                    .where(F.col("up").isNotNull() & F.col("term").isNotNull()).distinct())
    layer = cut_lineage(roots(nodes, edges).select("term").distinct().withColumn("depth", F.lit(0)))
    known = layer
    for depth_ in itertools.count(1):
        nxt = (e.join(layer.select(F.col("term").alias("up")), "up", "left_semi").select("term").distinct()
               .join(known.select("term"), "term", "left_anti").withColumn("depth", F.lit(depth_)))
        layer = cut_lineage(nxt)
        if layer.isEmpty():
            return cut_lineage(known.join(nodes.select("term").hint("merge"), "term", "left_semi"))
        known = known.unionByName(layer)


def ontology_table(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """term, label, parents joined by '; ' (null when the term has none)."""
    p = parents(edges).select(F.col("child").alias("term"), "parents")
    return (nodes.join(p, "term", "left")
            .select("term", "label",
                    F.when(F.col("parents").isNotNull(),
                           F.array_join(F.col("parents").cast("array<string>"), "; ")).alias("is_a")))
