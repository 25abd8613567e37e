"""Joins, set operations, grouping and top-k.

All joins are equi-joins (semi/anti/inner/left); Spark/AQE chooses hash,
sort-merge or broadcast from runtime sizes.  Top-k per group is two-stage and
salted so that a hot group is ranked by many tasks before the final cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annospark.session import cut_lineage

TOPK_SALT_BUCKETS = 64


def semi_join(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``keys``."""
    return df.join(keys, on, "left_semi")


def anti_join(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key does not occur in ``keys``."""
    return df.join(keys, on, "left_anti")


def annotate(ann: DataFrame, dim: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Inner equi-join."""
    return ann.join(dim, on, "inner")


def left_join_fill(left: DataFrame, right: DataFrame, on: str | Sequence[str],
                   list_cols: Sequence[str] = ()) -> DataFrame:
    """Left join; null list columns of the right side become empty lists."""
    out = left.join(right, on, "left")
    for c in list_cols:
        out = out.withColumn(c, F.coalesce(F.col(c), F.array().cast(out.schema[c].dataType)))
    return out


def edge_keep(edges: DataFrame, keep: DataFrame, a: str = "protein1", b: str = "protein2",
              key: str = "id") -> DataFrame:
    """C4: keep an edge when either endpoint is in ``keep`` (two semi joins, no OR join).

    Edges matching on both ends are reported once: the second branch excludes
    edges whose first endpoint is kept.
    """
    k = keep.select(F.col(key))
    by_a = edges.join(k.withColumnRenamed(key, a), a, "left_semi")
    not_a = edges.join(k.withColumnRenamed(key, a), a, "left_anti")
    by_b = not_a.join(k.withColumnRenamed(key, b), b, "left_semi")
    return by_a.unionByName(by_b)


def subset_violations(a: DataFrame, b: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Keys of ``a`` missing from ``b`` (empty = the subset assertion holds)."""
    return a.join(b, on, "left_anti")


def set_difference(universe: DataFrame, positives: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Universe minus positives."""
    return universe.join(positives, on, "left_anti")


def entity_link(article_entry: DataFrame, annotation: DataFrame, dictionary: DataFrame,
                article: str = "article", entry: str = "entry", text: str = "text",
                label: str = "label", term: str = "term") -> DataFrame:
    """Exact label match of mined annotation strings to a dictionary.

    Duplicated dictionary labels keep their smallest id; the result is the
    distinct set of (entry, term).
    """
    dedup = dictionary.groupBy(label).agg(F.min(term).alias(term))
    linked = annotation.join(dedup, annotation[text] == dedup[label]).select(article, term)
    return linked.join(article_entry.select(article, entry), article).select(entry, term).distinct()


def class_lookup(df: DataFrame, dim: DataFrame, on: str) -> DataFrame:
    """Id -> class code; unknown ids get null."""
    return df.join(dim, on, "left")


def top_k_per_group(df: DataFrame, group_cols: Sequence[str], order: Sequence[Column], k: int,
                    salt_buckets: int = TOPK_SALT_BUCKETS) -> DataFrame:
    """Best ``k`` rows per group; ``order`` must be a total order (add tie-breakers).

    Stage 1 ranks inside (group, salt) so a hot group is spread over
    ``salt_buckets`` tasks; stage 2 ranks the at most ``salt_buckets * k``
    survivors per group.
    """
    g = list(group_cols)
    if not g:
        return df.orderBy(*order).limit(k)
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(salt_buckets)).alias("_salt")
    staged = df.withColumn("_salt", salt)
    w1 = Window.partitionBy(*g, "_salt").orderBy(*order)
    w2 = Window.partitionBy(*g).orderBy(*order)
    first = staged.withColumn("_rk", F.row_number().over(w1)).where(F.col("_rk") <= k).drop("_rk", "_salt")
    return first.withColumn("_rk", F.row_number().over(w2)).where(F.col("_rk") <= k).drop("_rk")


def group_size(df: DataFrame, keys: Sequence[str], drop_null: Sequence[str] = ()) -> DataFrame:
    """Rows per key tuple, rows with a null in ``drop_null`` ignored."""
    out = df
    for c in drop_null:
        out = out.where(F.col(c).isNotNull())
    return out.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def level_distinct_counts(df: DataFrame, levels: Sequence[str], entry: str = "entry") -> DataFrame:
    """For each level column separately, distinct entries per value.

    One GROUPING SETS aggregation; output (level, value, n_entries).
    """
    base = df.select(entry, *levels)
    agg = (base.groupingSets([[F.col(c)] for c in levels], *levels)
           .agg(F.count_distinct(entry).alias("n_entries"),
                *[F.grouping(c).alias(f"_g{i}") for i, c in enumerate(levels)]))
    level = F.lit(None).cast("string")
    value = F.lit(None).cast("string")
    for i, c in reversed(list(enumerate(levels))):
        level = F.when(F.col(f"_g{i}") == 0, F.lit(c)).otherwise(level)
        value = F.when(F.col(f"_g{i}") == 0, F.col(c).cast("string")).otherwise(value)
    return (agg.select(level.alias("level"), value.alias("value"), "n_entries")
            .where(F.col("value").isNotNull()))


def collect_set_per_key(df: DataFrame, key: str, value: str, out: str = "values") -> DataFrame:
    """Key -> sorted distinct values."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias(out))


def collect_chunks_per_key(df: DataFrame, key: str, value: str, chunk: int = 1000, out: str = "values") -> DataFrame:
    """J4 for keys with any number of values: key -> numbered chunks of its sorted distinct values.

    The distinct rows are dealt by range of (key, value) and numbered by the
    counts of earlier ranges, so a hot key spans many tasks and no list is
    longer than ``chunk``.
    """
    # written, so that a row's range is the same for all readers
    ranged = cut_lineage(df.select(key, value).where(F.col(value).isNotNull()).distinct()
                         .repartitionByRange(key, value).withColumn("_range", F.spark_partition_id()))
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = (ranged.groupBy(key, "_range").agg(F.count(F.lit(1)).alias("_c"))
              .select(F.col(key).alias("_key"), F.col("_range").alias("_r"), F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before")))
    own = F.row_number().over(Window.partitionBy(key, "_range").orderBy(value)) - 1
    placed = (ranged.withColumn("_own", own).join(before, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_r")))
              .withColumn("chunk", F.floor((F.col("_own") + F.col("_before")) / chunk)))
    return placed.groupBy(key, "chunk").agg(F.array_sort(F.collect_list(value)).alias(out))


def set_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of two id sets."""
    return a.unionByName(b).distinct()


def sorted_head(df: DataFrame, order: Sequence[str], k: int) -> DataFrame:
    """Order by ``order`` and keep ``k`` rows."""
    return df.orderBy(*order).limit(k)
