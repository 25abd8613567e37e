"""Registry of the queries run on the driver tables: Spark plan + DuckDB oracle SQL.

Each entry maps a name to ``(build(spark, sf_dir) -> DataFrame, sql | None)``.
Floating columns are rounded identically on both sides (p 6 places, odds
ratio 6, score 4) so that the oracle comparison is exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annospark.operators import enrichment as enr
from annospark.operators import ontology as onto
from annospark.plans import bindings as V
from annospark.plans.oracle_sql import enrich_ctes, fisher_ctes, gate_sql
from annospark.session import cut_lineage

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Builder, str | None]] = {}

ROUNDING = {"p_value": 6, "odds_ratio": 6, "score": 4, "weight": 6}


def register(name: str, sql: str | None):
    def deco(fn: Builder) -> Builder:
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def rounded(df: DataFrame) -> DataFrame:
    """Round known floating columns (library results keep full precision)."""
    for c, places in ROUNDING.items():
        if c in df.columns:
            df = df.withColumn(c, F.round(F.col(c), places))
    return df


def round_sql(cols: list[str]) -> str:
    parts = []
    for c in cols:
        parts.append(f"round({c}, {ROUNDING[c]}) AS {c}" if c in ROUNDING else c)
    return ", ".join(parts)


FIS_COLS = ["term", "tp", "tn", "fp", "fn", "odds_ratio", "p_value"]
ENR_COLS = FIS_COLS + ["depth", "label"]


# ------------------------------------------------------------------ ontology cache per session
_DAG_CACHE: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def dag(spark: SparkSession, sf_dir: str):
    """(nodes, edges, levels, depth) of V_dag; the graph is walked once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    nodes = V.dag_nodes(spark, sf_dir)
    edges = V.dag_edges(spark, sf_dir)
    if key not in _DAG_CACHE:
        _DAG_CACHE[key] = (onto.edge_levels(edges), onto.depth_from_roots(nodes, edges))
    return nodes, edges, *_DAG_CACHE[key]


_CLOSURE_CACHE: dict[tuple[str, str], DataFrame] = {}


def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transitive closure of V_dag as lists, for the queries that return it; computed once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CLOSURE_CACHE:
        _CLOSURE_CACHE[key] = onto.closure_lists(V.dag_edges(spark, sf_dir))
    return _CLOSURE_CACHE[key]


# ------------------------------------------------------------------ G: enrichment
_BRAND_T = V.SQL_ANN_BRAND + " WHERE l_returnflag = 'R'"


@register("fisher_brand", f"WITH {fisher_ctes(_BRAND_T, V.SQL_ANN_BRAND)} "
          f"SELECT {round_sql(FIS_COLS)} FROM fis")
def q_fisher_brand(spark, sf_dir):
    b = V.ann_brand(spark, sf_dir)
    res = enr.fisher_test(b.where(F.col("l_returnflag") == "R"), b, "term")
    return rounded(res.select(*FIS_COLS))


@register("fisher_part", f"WITH {fisher_ctes(V.SQL_ANN_TARGET, V.SQL_ANN)} SELECT {round_sql(FIS_COLS)} FROM fis")
def q_fisher_part(spark, sf_dir):
    res = enr.fisher_test(V.ann_target(spark, sf_dir), V.ann(spark, sf_dir), "term")
    return rounded(res.select(*FIS_COLS))


@register("term_counts", "SELECT term, count(*) AS n FROM lineitem_ann_t GROUP BY term"
          .replace("lineitem_ann_t", f"({V.SQL_ANN_TARGET})"))
def q_term_counts(spark, sf_dir):
    return enr.term_counts(V.ann_target(spark, sf_dir), "term")


def ann_r_table(spark, sf_dir):
    """Contingency of returned line items vs all line items in one scan."""
    return enr.contingency_flagged(V.ann(spark, sf_dir), F.col("l_returnflag") == "R", "term")


@register("enrich", f"WITH RECURSIVE {V.SQL_DAG_CTES.strip()}, {enrich_ctes(V.SQL_ANN_TARGET, V.SQL_ANN).strip()} "
          f"SELECT {round_sql(ENR_COLS)} FROM res")
def q_enrich(spark, sf_dir):
    nodes, edges, levels, depth = dag(spark, sf_dir)
    res = enr.enrich(None, None, nodes, edges, "term", levels=levels, depth_table=depth,
                     table=ann_r_table(spark, sf_dir))
    return rounded(res.select(*ENR_COLS))


@register("enrich_gate", f"WITH RECURSIVE {V.SQL_DAG_CTES.strip()}, {enrich_ctes(V.SQL_ANN_TARGET, V.SQL_ANN).strip()} "
          f"SELECT {round_sql(ENR_COLS + ['score'])} FROM ({gate_sql('res', 0.05, 4, False)})")
def q_enrich_gate(spark, sf_dir):
    nodes, edges, levels, depth = dag(spark, sf_dir)
    res = enr.enrich(None, None, nodes, edges, "term", levels=levels, depth_table=depth,
                     table=ann_r_table(spark, sf_dir))
    return rounded(enr.significance_gate(res, 0.05, 4, False).select(*ENR_COLS, "score"))


@register("enrich_bonferroni", f"WITH RECURSIVE {V.SQL_DAG_CTES.strip()}, {enrich_ctes(V.SQL_ANN_TARGET, V.SQL_ANN).strip()} "
          f"SELECT {round_sql(ENR_COLS + ['score'])} FROM ({gate_sql('res', 0.05, 4, True)})")
def q_enrich_bonferroni(spark, sf_dir):
    nodes, edges, levels, depth = dag(spark, sf_dir)
    res = enr.enrich(None, None, nodes, edges, "term", levels=levels, depth_table=depth,
                     table=ann_r_table(spark, sf_dir))
    return rounded(enr.significance_gate(res, 0.05, 4, True).select(*ENR_COLS, "score"))


@register("enrich_many", f"WITH RECURSIVE {V.SQL_DAG_CTES.strip()}, "
          f"{enrich_ctes(V.SQL_ANN_TARGET_BY_PRIORITY, V.SQL_ANN, 'grp').strip()} "
          f"SELECT {round_sql(['grp'] + ENR_COLS + ['score'])} FROM ({gate_sql('res', 0.05, 4, True, 'grp')})")
def q_enrich_many(spark, sf_dir):
    nodes, edges, levels, depth = dag(spark, sf_dir)
    res = enr.enrich_many(V.ann_target_by_priority(spark, sf_dir), V.ann(spark, sf_dir), nodes, edges,
                          "grp", "term", 0.05, 4, True, levels, depth)
    return rounded(res.select("grp", *ENR_COLS, "score"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_enrich_gate(spark, sf_dir)


# the remaining query families register themselves on import
from annospark.plans import queries_graph, queries_intervals, queries_sources, queries_table  # noqa: E402,F401
