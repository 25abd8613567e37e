"""Registered queries: ontology (F), enrichment variants (B7, G10-G12), networks (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from annospark.operators import enrichment as enr
from annospark.operators import networks as net
from annospark.operators import ontology as onto
from annospark.operators import reshape as rs
from annospark.plans import bindings as V
from annospark.plans.catalog import ENR_COLS, FIS_COLS, closure, dag, register, round_sql, rounded
from annospark.plans.oracle_sql import enrich_ctes, fisher_ctes, gate_sql

DAG = f"WITH RECURSIVE {V.SQL_DAG_CTES.strip()}"
ENR = f"{DAG}, {enrich_ctes(V.SQL_ANN_TARGET, V.SQL_ANN).strip()}"


# ------------------------------------------------------------------ F: ontology
@register("ontology_parents", f"WITH edges AS ({V.SQL_DAG_EDGES}) SELECT child, count(*) AS n_parents, "
          "string_agg(CAST(parent AS VARCHAR), '; ' ORDER BY parent) AS parents FROM edges GROUP BY child")
def q_parents(spark, sf_dir):
    p = onto.parents(V.dag_edges(spark, sf_dir))
    return p.select("child", F.size("parents").cast("long").alias("n_parents"), rs.join_list(F.col("parents")).alias("parents"))


@register("ontology_labels", f"SELECT term, label FROM ({V.SQL_DAG_NODES})")
def q_labels(spark, sf_dir):
    return onto.labels(V.dag_nodes(spark, sf_dir))


@register("ontology_roots", f"{DAG} SELECT term FROM roots")
def q_roots(spark, sf_dir):
    return onto.roots(V.dag_nodes(spark, sf_dir), V.dag_edges(spark, sf_dir)).select("term")


@register("ontology_ancestors", f"{DAG} SELECT descendant AS term, ancestor FROM clo "
          "WHERE descendant IN (SELECT term FROM nodes)")
def q_ancestors(spark, sf_dir):
    return onto.ancestors(V.dag_nodes(spark, sf_dir), closure(spark, sf_dir))


@register("ontology_descendants", f"{DAG} SELECT ancestor AS term, count(*) AS n_descendants FROM clo "
          "WHERE descendant IN (SELECT term FROM nodes) GROUP BY ancestor")
def q_descendants(spark, sf_dir):
    return onto.descendants(V.dag_nodes(spark, sf_dir), closure(spark, sf_dir)).groupBy("term").agg(F.count(F.lit(1)).alias("n_descendants"))


@register("ontology_depth", f"{DAG} SELECT term, depth FROM depth")
def q_depth(spark, sf_dir):
    _n, _e, _c, depth = dag(spark, sf_dir)
    return depth


@register("ontology_table", f"WITH nodes AS ({V.SQL_DAG_NODES}), edges AS ({V.SQL_DAG_EDGES}) "
          "SELECT term, label, (SELECT string_agg(CAST(parent AS VARCHAR), '; ' ORDER BY parent) FROM edges "
          "WHERE child = term) AS is_a FROM nodes")
def q_ontology_table(spark, sf_dir):
    return onto.ontology_table(V.dag_nodes(spark, sf_dir), V.dag_edges(spark, sf_dir))


# ------------------------------------------------------------------ B7, G10-G12
def _enriched(spark, sf_dir):
    from annospark.plans.catalog import ann_r_table
    nodes, edges, levels, depth = dag(spark, sf_dir)
    return enr.enrich(None, None, nodes, edges, "term", levels=levels, depth_table=depth,
                      table=ann_r_table(spark, sf_dir))


@register("enrich_filter", f"{ENR} SELECT {round_sql(ENR_COLS + ['score'])} FROM "
          "(SELECT *, -ln(p_value) AS score FROM res WHERE p_value < 0.05 AND depth <= 5)")
def q_enrich_filter(spark, sf_dir):
    return rounded(enr.enrich_filter(_enriched(spark, sf_dir), 0.05, 5).select(*ENR_COLS, "score"))


@register("term_weights", f"{ENR}, g AS ({gate_sql('res', 0.05, 4, False)}) "
          "SELECT label, round(score, 4) AS score, round(score / (SELECT max(score) FROM g), 6) AS weight "
          "FROM g ORDER BY g.score DESC, label LIMIT 10")
def q_term_weights(spark, sf_dir):
    g = enr.significance_gate(_enriched(spark, sf_dir), 0.05, 4, False)
    return rounded(enr.term_weights(g, 10))


@register("top_terms", f"{ENR} SELECT {round_sql(ENR_COLS)} FROM res ORDER BY res.p_value, term LIMIT 10")
def q_top_terms(spark, sf_dir):
    return rounded(enr.top_terms(_enriched(spark, sf_dir), 10, by="p_value").select(*ENR_COLS))


_ACCEPTED_T = f"SELECT * FROM ({V.SQL_ANN}) WHERE entry IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')"


@register("enrich_original", f"{DAG}, {enrich_ctes(_ACCEPTED_T, V.SQL_ANN).strip()} "
          f"SELECT {round_sql(ENR_COLS + ['score'])} FROM ({gate_sql('res', 0.05, 4, True)})")
def q_enrich_original(spark, sf_dir):
    nodes, edges, levels, depth = dag(spark, sf_dir)
    accepted = V.table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("entry"))
    target, background = enr.target_background_original(V.ann(spark, sf_dir), accepted)
    res = enr.enrich(target, background, nodes, edges, "term", levels=levels, depth_table=depth)
    return rounded(enr.significance_gate(res, 0.05, 4, True).select(*ENR_COLS, "score"))


# ------------------------------------------------------------------ H: networks
_NET = f"edges AS ({V.SQL_NET_EDGES}), seeds AS ({V.SQL_NET_SEEDS})"
_INTER = ("SELECT id FROM seeds UNION SELECT protein2 FROM edges WHERE combined_score > 700 "
          "AND protein1 IN (SELECT id FROM seeds)")


@register("interactors", f"WITH {_NET} {_INTER}")
def q_interactors(spark, sf_dir):
    return net.interactors(V.net_seeds(spark, sf_dir), V.net_edges(spark, sf_dir), 700)


_H2_T = (f"SELECT * FROM ({V.SQL_NET_ENTRIES}) WHERE entry IN (SELECT entry FROM ({V.SQL_NET_IDS}) "
         f"WHERE net_id IN (WITH {_NET} {_INTER}))")
_H2_B = f"SELECT * FROM ({V.SQL_NET_ENTRIES}) WHERE entry IN (SELECT entry FROM ({V.SQL_NET_IDS}))"


@register("interaction_sets_fisher", f"WITH {fisher_ctes(_H2_T, _H2_B)} SELECT {round_sql(FIS_COLS)} FROM fis")
def q_interaction_sets(spark, sf_dir):
    ents = V.net_entries(spark, sf_dir)
    t, b = net.interaction_sets(ents.select("entry", "term"), ents, V.net_seeds(spark, sf_dir),
                                V.net_edges(spark, sf_dir), "entry", "net_id", 700)
    return rounded(enr.fisher_test(t, b, "term").select(*FIS_COLS))


_HOP = f"map AS ({V.SQL_HOP_MAP}), seeds AS ({V.SQL_HOP_SEEDS})"
_SHARED = ("SELECT DISTINCT entry FROM map WHERE struct_id IN "
           "(SELECT struct_id FROM map WHERE entry IN (SELECT entry FROM seeds))")


@register("shared_structure", f"WITH {_HOP} {_SHARED}")
def q_shared_structure(spark, sf_dir):
    return net.shared_structure(V.hop_seeds(spark, sf_dir), V.hop_map(spark, sf_dir))


_H4_B = f"SELECT * FROM ({V.SQL_ANN}) WHERE entry IN (SELECT l_orderkey FROM lineitem)"
_H4_T = f"SELECT * FROM ({_H4_B}) WHERE entry IN (WITH {_HOP} {_SHARED})"


@register("structure_sets_enrich", f"{DAG}, {enrich_ctes(_H4_T, _H4_B).strip()} "
          f"SELECT {round_sql(ENR_COLS + ['score'])} FROM ({gate_sql('res', 0.05, 4, False)})")
def q_structure_sets(spark, sf_dir):
    nodes, edges, levels, depth = dag(spark, sf_dir)
    t, b = net.structure_sets(V.ann(spark, sf_dir), V.hop_seeds(spark, sf_dir), V.hop_map(spark, sf_dir))
    res = enr.enrich(t, b, nodes, edges, "term", levels=levels, depth_table=depth)
    return rounded(enr.significance_gate(res, 0.05, 4, False).select(*ENR_COLS, "score"))


_ARCH = (f"SELECT entry, rtrim(pfam_ids, ';') AS architecture FROM ({V.SQL_ORDER_BRAND_LIST}) "
         "WHERE entry IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
_H5_T = f"SELECT a.*, arch.architecture AS grp FROM ({V.SQL_ANN}) a JOIN ({_ARCH}) arch USING (entry)"
_H5_B = f"SELECT a.* FROM ({V.SQL_ANN}) a WHERE entry IN (SELECT entry FROM ({_ARCH}))"


def _arch(spark, sf_dir):
    bl = V.order_brand_list(spark, sf_dir)
    acc = V.table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("entry"))
    return bl.join(acc, "entry", "left_semi").select("entry", rs.architecture_key(F.col("pfam_ids")).alias("architecture"))


@register("enrich_by_architecture", f"{DAG}, {enrich_ctes(_H5_T, _H5_B, 'grp').strip()} "
          f"SELECT {round_sql(['grp'] + ENR_COLS + ['score'])} FROM ({gate_sql('res', 0.05, 4, True, 'grp')})")
def q_enrich_by_architecture(spark, sf_dir):
    nodes, edges, _levels, depth = dag(spark, sf_dir)
    keyed, _background = net.architecture_sets(V.ann(spark, sf_dir), _arch(spark, sf_dir))
    # every entry has exactly one architecture: the groups partition the background
    res = enr.enrich_many(keyed.withColumnRenamed("architecture", "grp"), None, nodes, edges, "grp", "term",
                          0.05, 4, True, None, depth, closure(spark, sf_dir))
    return rounded(res.select("grp", *ENR_COLS, "score"))


@register("degree_stats", f"WITH {_NET} SELECT count(DISTINCT protein1) AS n_protein1, count(DISTINCT protein2) AS n_protein2, "
          "count(*) AS n_edges, count(*) / count(DISTINCT protein1) AS mean_interactions FROM edges")
def q_degree_stats(spark, sf_dir):
    return rounded(net.degree_stats(V.net_edges(spark, sf_dir)))


@register("score_histogram", f"WITH {_NET}, b AS (SELECT min(combined_score) AS lo, max(combined_score) AS hi FROM edges) "
          "SELECT bin, b.lo + (bin - 1) * (b.hi - b.lo) / 30 AS lower, b.lo + bin * (b.hi - b.lo) / 30 AS upper, n FROM "
          "(SELECT CASE WHEN b.hi = b.lo THEN 1 ELSE least(30, CAST(floor((combined_score - b.lo) * 30 / (b.hi - b.lo)) AS INTEGER) + 1) END AS bin, "
          "count(*) AS n FROM edges, b WHERE combined_score IS NOT NULL GROUP BY bin) h, b")
def q_score_histogram(spark, sf_dir):
    return net.score_histogram(V.net_edges(spark, sf_dir), 30)


@register("top_interactors", f"WITH {_NET} SELECT protein1, protein2, combined_score FROM "
          "(SELECT *, row_number() OVER (PARTITION BY protein1 ORDER BY combined_score DESC, protein2) AS rk FROM edges) "
          "WHERE rk <= 3")
def q_top_interactors(spark, sf_dir):
    return net.top_interactors(V.net_edges(spark, sf_dir), 3)


@register("score_histogram_seeds", f"WITH {_NET}, se AS (SELECT * FROM edges WHERE protein1 IN (SELECT id FROM seeds) AND combined_score > 700), "
          "b AS (SELECT min(combined_score) AS lo, max(combined_score) AS hi FROM se) "
          "SELECT bin, b.lo + (bin - 1) * (b.hi - b.lo) / 30 AS lower, b.lo + bin * (b.hi - b.lo) / 30 AS upper, n FROM "
          "(SELECT CASE WHEN b.hi = b.lo THEN 1 ELSE least(30, CAST(floor((combined_score - b.lo) * 30 / (b.hi - b.lo)) AS INTEGER) + 1) END AS bin, "
          "count(*) AS n FROM se, b WHERE combined_score IS NOT NULL GROUP BY bin) h, b")
def q_score_histogram_seeds(spark, sf_dir):
    """H7 on the seed subset: edges leaving a seed protein with a score above 700."""
    from annospark.operators.setops import semi_join
    seeds = V.net_seeds(spark, sf_dir).withColumnRenamed("id", "protein1")
    kept = V.net_edges(spark, sf_dir).where(F.col("combined_score") > 700)
    return net.score_histogram(semi_join(kept, seeds, "protein1"), 30)
