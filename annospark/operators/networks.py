"""Target/background builders through networks (H1-H8).

Edges are ``(protein1, protein2, combined_score)``; annotation tables carry
an entry column; entry tables map entries to network or structure ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annospark.operators.reshape import explode_list
from annospark.operators.setops import top_k_per_group


def interactors(seeds: DataFrame, edges: DataFrame, min_score: float = 700, seed_col: str = "id") -> DataFrame:
    """H1: seeds plus every protein2 reached from a seed protein1 with score > min_score (one hop)."""
    s = seeds.select(F.col(seed_col).alias("id"))
    hop = (edges.where(F.col("combined_score") > min_score)
           .join(s.withColumnRenamed("id", "protein1"), "protein1", "left_semi")
           .select(F.col("protein2").alias("id")))
    return s.unionByName(hop).distinct()


def interaction_sets(ann: DataFrame, entries: DataFrame, seeds: DataFrame, edges: DataFrame,
                     entry: str = "entry", net_id: str = "net_id", min_score: float = 700,
                     seed_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """H2: target = annotations of entries with a network id among the interactors;
    background = annotations of entries having a network id.  Cells of entries and
    seeds may hold several ids."""
    with_id = explode_list(entries, net_id, ";", keep=[entry])
    reached = interactors(explode_list(seeds, seed_col, ";", "id"), edges, min_score).withColumnRenamed("id", net_id)
    target_entries = with_id.join(reached, net_id, "left_semi").select(entry)
    background = ann.join(with_id.select(entry), entry, "left_semi")
    target = ann.join(target_entries, entry, "left_semi")
    return target, background


def shared_structure(seeds: DataFrame, mapping: DataFrame, entry: str = "entry",
                     struct: str = "struct_id") -> DataFrame:
    """H3: entries mapped to any structure of a seed entry (seeds included)."""
    seed_structs = mapping.join(seeds.select(entry), entry, "left_semi").select(struct)
    return mapping.join(seed_structs, struct, "left_semi").select(entry).distinct()


def structure_map_from_lists(entries: DataFrame, entry: str = "entry", col: str = "pdb_ids",
                             struct: str = "struct_id") -> DataFrame:
    """H3 helper: ';'-terminated structure lists -> (entry, lower-cased structure id)."""
    return (explode_list(entries, col, ";", struct, keep=[entry])
            .select(entry, F.lower(F.col(struct)).alias(struct)).distinct())


def structure_sets(ann: DataFrame, seeds: DataFrame, mapping: DataFrame, entry: str = "entry",
                   struct: str = "struct_id") -> tuple[DataFrame, DataFrame]:
    """H4: background = annotations of entries having any structure; target =
    background restricted to entries sharing a structure with a seed (which
    all have one, so the target needs no join with the mapping)."""
    background = ann.join(mapping.select(entry), entry, "left_semi")
    target = ann.join(shared_structure(seeds, mapping, entry, struct), entry, "left_semi")
    return target, background


def architecture_sets(ann: DataFrame, arch: DataFrame, entry: str = "entry",
                      arch_col: str = "architecture") -> tuple[DataFrame, DataFrame]:
    """H5: background = annotations of entries with an architecture; targets =
    the same rows carrying their architecture as the group column."""
    keyed = ann.join(arch.select(entry, arch_col).where(F.col(arch_col).isNotNull()), entry)
    return keyed, keyed.drop(arch_col)


def degree_stats(edges: DataFrame) -> DataFrame:
    """H6: distinct protein1, distinct protein2, rows per distinct protein1."""
    return edges.agg(F.count_distinct("protein1").alias("n_protein1"),
                     F.count_distinct("protein2").alias("n_protein2"),
                     F.count(F.lit(1)).alias("n_edges")).withColumn(
        "mean_interactions", F.try_divide(F.col("n_edges").cast("double"), F.col("n_protein1")))


def score_histogram(edges: DataFrame, bins: int = 30, col: str = "combined_score") -> DataFrame:
    """H7: equal-width histogram between min and max (last bin closed).

    Output (bin 1..bins, lower, upper, n) for the non-empty bins.
    """
    bounds = edges.agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    lo = bounds.select("lo").scalar()
    hi = bounds.select("hi").scalar()
    width = (hi - lo).cast("double")
    idx = F.when(width == 0, F.lit(1)).otherwise(
        F.least(F.lit(bins), (F.floor((F.col(col) - lo).cast("double") * bins / width) + 1).cast("int")))
    return (edges.where(F.col(col).isNotNull())
            .groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
            .select("bin", (lo + (F.col("bin") - 1) * width / bins).alias("lower"),
                    (lo + F.col("bin") * width / bins).alias("upper"), "n"))


def top_interactors(edges: DataFrame, k: int) -> DataFrame:
    """H8: for every protein1 its ``k`` best partners by score (protein2 breaks ties)."""
    return top_k_per_group(edges.select("protein1", "protein2", "combined_score"), ["protein1"],
                           [F.col("combined_score").desc(), F.col("protein2")], k)
