"""The whole enrichment from files to files: annotations, target groups and an ontology graph in, one result per group out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from annospark.operators import enrichment as enr
from annospark.session import cut_lineage
from annospark.sources import readers, sinks


def enrichment_run(spark: SparkSession, background: str, targets: str, graph: str, out: str | None = None,
                   group: str = "architecture", entry: str = "entry", term: str = "term", max_p: float = 0.05,
                   max_depth: int = 4, bonferroni: bool = True, graph_lines: bool = False) -> DataFrame:
    """Read the tables, test every group against the background, propagate, gate, and write one directory a group.

    ``background``: table of (entry, term); ``targets``: a folder of tables of
    (entry, term), one directory ``group=value`` for each group; ``graph``: an
    OBO graph.  Returns the written rows (columns of ``enrich_many``).
    """
    ann = readers.read_table(spark, background).select(entry, term)
    target = readers.read_table(spark, targets).select(group, entry, term)
    nodes, edges = readers.read_obograph(spark, graph, graph_lines)
    nodes, edges = cut_lineage(nodes.distinct()), cut_lineage(edges.distinct())
    result = cut_lineage(enr.enrich_many(target, ann, nodes, edges, group, term, max_p, max_depth, bonferroni))
    if out:
        sinks.write_partitioned(result, out, group)
    return result
