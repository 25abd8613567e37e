"""Registered queries: projections/filters (B), joins (C), reshaping (D), grouping (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from annospark.operators import reshape as rs
from annospark.operators import setops as so
from annospark.operators import intervals as iv
from annospark.plans import bindings as V
from annospark.plans.catalog import register

_HITS_SQL = ("SELECT CAST(l_orderkey AS VARCHAR) AS entry_ac, l_linenumber * 10 AS seq_start, "
             "l_linenumber * 10 + CAST(l_quantity AS INTEGER) AS seq_end, l_discount AS e_value FROM lineitem")


def _raw_hits(spark, sf_dir):
    li = V.table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", (F.col("l_linenumber") * 10).alias("s"),
                     (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int")).alias("e"), "l_discount")


# ------------------------------------------------------------------ B
@register("project_hits", _HITS_SQL)
def q_project_hits(spark, sf_dir):
    return rs.project_hits(_raw_hits(spark, sf_dir), "l_orderkey", "s", "e", "l_discount")


@register("evalue_filter", f"SELECT * FROM ({_HITS_SQL}) WHERE e_value < 0.05")
def q_evalue_filter(spark, sf_dir):
    return rs.evalue_filter(rs.project_hits(_raw_hits(spark, sf_dir), "l_orderkey", "s", "e", "l_discount"), 0.05)


@register("membership_flag", f"SELECT entry, coalesce(list_contains(string_split(pfam_ids, ';'), 'Brand#1'), FALSE) AS in_family "
          f"FROM ({V.SQL_ORDER_BRAND_LIST})")
def q_membership_flag(spark, sf_dir):
    bl = V.order_brand_list(spark, sf_dir)
    return bl.select("entry", rs.membership_flag("pfam_ids", "Brand#1").alias("in_family"))


@register("split_by_flag", f"SELECT in_family, count(*) AS n FROM (SELECT coalesce(list_contains(string_split(pfam_ids, ';'), "
          f"'Brand#1'), FALSE) AS in_family FROM ({V.SQL_ORDER_BRAND_LIST})) GROUP BY in_family")
def q_split_by_flag(spark, sf_dir):
    bl = V.order_brand_list(spark, sf_dir).withColumn("in_family", rs.membership_flag("pfam_ids", "Brand#1"))
    inside, outside = rs.split_by_flag(bl, "in_family")
    return (inside.select(F.lit(True).alias("in_family")).unionByName(outside.select(F.lit(False).alias("in_family")))
            .groupBy("in_family").agg(F.count(F.lit(1)).alias("n")))


@register("not_null_filter", f"SELECT o_orderkey AS entry, pfam_ids FROM orders LEFT JOIN ({V.SQL_ORDER_BRAND_LIST}) l "
          "ON o_orderkey = l.entry WHERE pfam_ids IS NOT NULL")
def q_not_null_filter(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry"))
    return rs.not_null_filter(o.join(V.order_brand_list(spark, sf_dir), "entry", "left"), "pfam_ids")


@register("normalise_ids", "SELECT page_id, lower(trim(url)) AS url_norm, CASE WHEN instr(url, ':') > 0 THEN split_part(url, ':', 2) ELSE url END AS after_prefix, "
          "CASE WHEN length(url) > 0 THEN substr(url, 1, length(url) - 1) ELSE url END AS url_cut, "
          "trim(replace(url, '/', '')) AS url_stripped FROM pages")
def q_normalise_ids(spark, sf_dir):
    p = V.table(spark, sf_dir, "pages")
    u = F.col("url")
    return p.select("page_id", rs.normalise_id(u).alias("url_norm"), rs.strip_db_prefix(u).alias("after_prefix"),
                    rs.drop_last_char(u).alias("url_cut"), rs.strip_list_terminator(u, "/").alias("url_stripped"))


@register("distinct_architectures", f"SELECT DISTINCT rtrim(pfam_ids, ';') AS architecture FROM ({V.SQL_ORDER_BRAND_LIST})")
def q_distinct_architectures(spark, sf_dir):
    bl = V.order_brand_list(spark, sf_dir).select(rs.architecture_key(F.col("pfam_ids")).alias("architecture"))
    return rs.distinct_values(bl, "architecture")


# ------------------------------------------------------------------ C
@register("semi_join", f"SELECT entry, term FROM ({V.SQL_ANN}) WHERE entry IN "
          "(SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def q_semi_join(spark, sf_dir):
    keys = (V.table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == "1-URGENT")
            .select(F.col("o_orderkey").alias("entry")))
    return so.semi_join(V.ann(spark, sf_dir).select("entry", "term"), keys, "entry")


@register("annotate", f"SELECT entry, term, label FROM ({V.SQL_ANN}) JOIN ({V.SQL_DAG_NODES}) USING (term)")
def q_annotate(spark, sf_dir):
    return so.annotate(V.ann(spark, sf_dir).select("entry", "term"), V.dag_nodes(spark, sf_dir), "term")


@register("left_join_fill", "SELECT o_orderkey AS entry, CAST(coalesce(len(b), 0) AS INTEGER) AS n_brands, "
          "coalesce(array_to_string(b, ','), '') AS brands FROM orders LEFT JOIN "
          "(SELECT l_orderkey, list(DISTINCT p_brand ORDER BY p_brand) AS b FROM lineitem JOIN part ON l_partkey = p_partkey "
          "GROUP BY l_orderkey) ON o_orderkey = l_orderkey")
def q_left_join_fill(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry"))
    li = V.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    part = V.table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    b = (li.join(part, li.l_partkey == part.p_partkey).groupBy(F.col("l_orderkey").alias("entry"))
         .agg(F.array_sort(F.collect_set("p_brand")).alias("b")))
    out = so.left_join_fill(o, b, "entry", ["b"])
    return out.select("entry", F.size("b").alias("n_brands"), F.array_join("b", ",").alias("brands"))


_KEEP_SQL = (f"SELECT id FROM ({V.SQL_NET_SEEDS}) UNION ALL SELECT 'P' || p_partkey FROM part WHERE p_brand = 'Brand#1'")


@register("edge_keep", f"SELECT * FROM ({V.SQL_NET_EDGES}) WHERE protein1 IN ({_KEEP_SQL}) OR protein2 IN ({_KEEP_SQL})")
def q_edge_keep(spark, sf_dir):
    keep = V.net_seeds(spark, sf_dir).unionByName(
        V.table(spark, sf_dir, "part").where(F.col("p_brand") == "Brand#1")
        .select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id")))
    return so.edge_keep(V.net_edges(spark, sf_dir), keep)


@register("subset_violations", "SELECT 'orders' AS side, l_orderkey AS entry FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders "
          "WHERE o_orderstatus <> 'P') UNION ALL SELECT 'parts', l_partkey FROM lineitem WHERE l_partkey NOT IN "
          "(SELECT p_partkey FROM part WHERE p_size <= 45)")
def q_subset_violations(spark, sf_dir):
    """Line items whose order is not among the closed or open ones, or whose part is not among the smaller ones."""
    li = V.table(spark, sf_dir, "lineitem")
    orders = V.table(spark, sf_dir, "orders").where(F.col("o_orderstatus") != "P").select(F.col("o_orderkey").alias("entry"))
    parts = V.table(spark, sf_dir, "part").where(F.col("p_size") <= 45).select(F.col("p_partkey").alias("entry"))
    a = so.subset_violations(li.select(F.col("l_orderkey").alias("entry")), orders, "entry")
    b = so.subset_violations(li.select(F.col("l_partkey").alias("entry")), parts, "entry")
    return a.select(F.lit("orders").alias("side"), "entry").unionByName(b.select(F.lit("parts").alias("side"), "entry"))


@register("set_difference", "SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars >= 2000)")
def q_set_difference(spark, sf_dir):
    return so.set_difference(V.doc_universe(spark, sf_dir), V.doc_pred(spark, sf_dir), "doc_id")


@register("pair_self_join", "SELECT a.label, a.vec_id AS i, b.vec_id AS j FROM embeddings a JOIN embeddings b "
          "ON a.label = b.label AND a.vec_id < b.vec_id")
def q_pair_self_join(spark, sf_dir):
    return iv.pair_self_join(V.table(spark, sf_dir, "embeddings"), "label", "vec_id").withColumnRenamed("label", "label")


_TOK = "SELECT DISTINCT doc_id, unnest(regexp_split_to_array(text, '\\s+')) AS tok FROM documents"
_DICT = "SELECT unnest(regexp_split_to_array(text, '\\s+')) AS tok, item_id FROM benchmark"


@register("entity_link", f"WITH a AS ({_TOK}), d AS (SELECT tok, min(item_id) AS term FROM ({_DICT}) "
          "WHERE tok <> '' GROUP BY tok) SELECT DISTINCT a.doc_id AS entry, d.term FROM a JOIN d USING (tok)")
def q_entity_link(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents")
    bench = V.table(spark, sf_dir, "benchmark")
    ann = (docs.select(F.col("doc_id").alias("article"), F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("text")))
    dic = (bench.select(F.col("item_id").alias("term"), F.explode(F.split("text", r"\s+")).alias("label"))
           .where("label <> ''"))
    art = docs.select(F.col("doc_id").alias("article"), F.col("doc_id").alias("entry"))
    return so.entity_link(art, ann, dic)


@register("class_lookup", f"SELECT o_orderkey, o_custkey, code FROM orders LEFT JOIN ({V.SQL_CUST_CODES}) c ON o_custkey = c.entry")
def q_class_lookup(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    codes = V.cust_codes(spark, sf_dir).withColumnRenamed("entry", "o_custkey")
    return so.class_lookup(o, codes, "o_custkey").select("o_orderkey", "o_custkey", "code")


# ------------------------------------------------------------------ D
@register("explode_list", f"SELECT * FROM (SELECT entry, trim(unnest(string_split(pfam_ids, ';'))) AS pfam_id "
          f"FROM ({V.SQL_ORDER_BRAND_LIST})) WHERE pfam_id <> ''")
def q_explode_list(spark, sf_dir):
    return rs.explode_list(V.order_brand_list(spark, sf_dir), "pfam_ids", ";", "pfam_id", keep=["entry"])


@register("extract_bracketed", "SELECT l_orderkey AS entry, lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS go_id, "
          f"{V.SQL_GO_DESCR} AS go_descr FROM lineitem JOIN part ON l_partkey = p_partkey")
def q_extract_bracketed(spark, sf_dir):
    return rs.extract_bracketed(V.order_bracketed(spark, sf_dir), "go", "entry")


@register("architecture_key", f"SELECT entry, rtrim(pfam_ids, ';') AS architecture FROM ({V.SQL_ORDER_BRAND_LIST})")
def q_architecture_key(spark, sf_dir):
    bl = V.order_brand_list(spark, sf_dir)
    return bl.select("entry", rs.architecture_key(F.col("pfam_ids")).alias("architecture"))


@register("code_prefixes", f"SELECT entry, split_part(code, '.', 1) AS class, "
          "split_part(code, '.', 1) || '.' || split_part(code, '.', 2) AS architecture, "
          "split_part(code, '.', 1) || '.' || split_part(code, '.', 2) || '.' || split_part(code, '.', 3) AS topology, "
          f"code AS homologous FROM ({V.SQL_CUST_CODES})")
def q_code_prefixes(spark, sf_dir):
    c = V.cust_codes(spark, sf_dir)
    return c.select("entry", *rs.code_prefixes(F.col("code")))


# ------------------------------------------------------------------ J
_ORDER_CODES = (f"SELECT o_custkey AS entry, code FROM orders JOIN ({V.SQL_CUST_CODES}) c ON o_custkey = c.entry")


@register("group_size", f"SELECT entry, code, count(*) AS n FROM ({_ORDER_CODES}) WHERE code IS NOT NULL GROUP BY entry, code")
def q_group_size(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entry"))
    return so.group_size(o.join(V.cust_codes(spark, sf_dir), "entry"), ["entry", "code"], drop_null=["code"])


_LEVELS = (f"SELECT entry, split_part(code, '.', 1) AS class, split_part(code, '.', 1) || '.' || split_part(code, '.', 2) AS architecture, "
           "split_part(code, '.', 1) || '.' || split_part(code, '.', 2) || '.' || split_part(code, '.', 3) AS topology, "
           f"code AS homologous FROM ({_ORDER_CODES})")


@register("level_distinct_counts", f"WITH l AS ({_LEVELS}) "
          "SELECT 'class' AS level, class AS value, count(DISTINCT entry) AS n_entries FROM l GROUP BY class UNION ALL "
          "SELECT 'architecture', architecture, count(DISTINCT entry) FROM l GROUP BY architecture UNION ALL "
          "SELECT 'topology', topology, count(DISTINCT entry) FROM l GROUP BY topology UNION ALL "
          "SELECT 'homologous', homologous, count(DISTINCT entry) FROM l GROUP BY homologous")
def q_level_distinct_counts(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entry"))
    coded = o.join(V.cust_codes(spark, sf_dir), "entry")
    levels = coded.select("entry", *rs.code_prefixes(F.col("code")))
    return so.level_distinct_counts(levels, ["class", "architecture", "topology", "homologous"], "entry")


@register("collect_set_per_key", f"SELECT entry, count(DISTINCT term) AS n_terms, "
          f"string_agg(DISTINCT CAST(term AS VARCHAR), ',' ORDER BY CAST(term AS VARCHAR)) AS terms FROM ({V.SQL_ANN}) GROUP BY entry")
def q_collect_set_per_key(spark, sf_dir):
    a = V.ann(spark, sf_dir).select("entry", F.col("term").cast("string").alias("term"))
    s = so.collect_set_per_key(a, "entry", "term", "terms")
    return s.select("entry", F.size("terms").cast("long").alias("n_terms"), F.array_join("terms", ",").alias("terms"))


@register("collect_chunks_per_key", "SELECT supplier, chunk, count(*)::BIGINT AS n, string_agg(part::VARCHAR, ',' ORDER BY part) AS parts FROM "
          "(SELECT supplier, part, (row_number() OVER (PARTITION BY supplier ORDER BY part) - 1) // 16 AS chunk FROM "
          "(SELECT DISTINCT l_suppkey AS supplier, l_partkey AS part FROM lineitem)) GROUP BY supplier, chunk")
def q_collect_chunks_per_key(spark, sf_dir):
    """J4 by chunks: the parts of each supplier in lists of at most 16."""
    li = V.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("part"))
    c = so.collect_chunks_per_key(li, "supplier", "part", 16, "parts")
    return c.select("supplier", "chunk", F.size("parts").cast("long").alias("n"), F.array_join(F.col("parts").cast("array<string>"), ",").alias("parts"))


@register("set_union", "SELECT l_partkey AS id FROM lineitem WHERE l_quantity > 45 UNION "
          "SELECT p_partkey FROM part WHERE p_brand = 'Brand#1'")
def q_set_union(spark, sf_dir):
    a = V.table(spark, sf_dir, "lineitem").where(F.col("l_quantity") > 45).select(F.col("l_partkey").alias("id"))
    b = V.table(spark, sf_dir, "part").where(F.col("p_brand") == "Brand#1").select(F.col("p_partkey").alias("id"))
    return so.set_union(a, b)


@register("sorted_head", f"SELECT entry, term FROM ({V.SQL_ANN}) ORDER BY entry, term LIMIT 20")
def q_sorted_head(spark, sf_dir):
    return so.sorted_head(V.ann(spark, sf_dir).select("entry", "term"), ["entry", "term"], 20)
