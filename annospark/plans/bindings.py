"""Bindings of the operators to the driver tables (TPC-H-ish parquet).

Every view exists twice: as a Spark DataFrame built from the parquet tables
and as SQL text for the DuckDB oracle, with the same meaning.  Nothing here
samples or caps the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- V_ann
def ann(spark, sf_dir) -> DataFrame:
    """Annotation rows: entry = order, term = part (one row per line item)."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("entry"), F.col("l_partkey").alias("term"), "l_returnflag")


def ann_target(spark, sf_dir) -> DataFrame:
    return ann(spark, sf_dir).where(F.col("l_returnflag") == "R")


def ann_brand(spark, sf_dir) -> DataFrame:
    """Coarse variant: term = brand of the part."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return (li.join(part, li.l_partkey == part.p_partkey)
            .select(F.col("l_orderkey").alias("entry"), F.col("p_brand").alias("term"), "l_returnflag"))


SQL_ANN = "SELECT l_orderkey AS entry, l_partkey AS term, l_returnflag FROM lineitem"
SQL_ANN_TARGET = SQL_ANN + " WHERE l_returnflag = 'R'"
SQL_ANN_BRAND = ("SELECT l_orderkey AS entry, p_brand AS term, l_returnflag "
                 "FROM lineitem JOIN part ON l_partkey = p_partkey")


# ---------------------------------------------------------------- V_dag
def dag_nodes(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("term"), F.col("p_name").alias("label"))


def dag_edges(spark, sf_dir) -> DataFrame:
    """k -> k div 2 and k -> k div 3 for every part k >= 1 (distinct)."""
    p = table(spark, sf_dir, "part").select("p_partkey").where(F.col("p_partkey") >= 1)
    half = p.select(F.col("p_partkey").alias("child"), (F.col("p_partkey") / 2).cast("long").alias("parent"))
    third = p.select(F.col("p_partkey").alias("child"), (F.col("p_partkey") / 3).cast("long").alias("parent"))
    return half.union(third).distinct()


SQL_DAG_NODES = "SELECT p_partkey AS term, p_name AS label FROM part"
SQL_DAG_EDGES = ("SELECT p_partkey AS child, p_partkey // 2 AS parent FROM part WHERE p_partkey >= 1 "
                 "UNION SELECT p_partkey AS child, p_partkey // 3 AS parent FROM part WHERE p_partkey >= 1")

# closure with min distance, labelled descendants; depth per labelled node
SQL_DAG_CTES = f"""
nodes AS ({SQL_DAG_NODES}),
edges AS ({SQL_DAG_EDGES}),
clo0 AS (
  WITH RECURSIVE c(descendant, ancestor, dist) AS (
    SELECT child, parent, 1 FROM edges
    UNION
    SELECT c.descendant, e.parent, c.dist + 1 FROM c JOIN edges e ON c.ancestor = e.child
  ) SELECT * FROM c
),
clo AS (SELECT descendant, ancestor, min(dist) AS dist FROM clo0 GROUP BY descendant, ancestor),
roots AS (SELECT term FROM nodes WHERE term NOT IN (SELECT child FROM edges)),
depth AS (
  SELECT term, 0 AS depth FROM roots
  UNION ALL
  SELECT descendant AS term, min(dist) AS depth FROM clo
  WHERE ancestor IN (SELECT term FROM roots) AND descendant IN (SELECT term FROM nodes)
  GROUP BY descendant
)"""


# ---------------------------------------------------------------- groups
def ann_target_by_priority(spark, sf_dir) -> DataFrame:
    """Target groups: returned line items of the orders of each priority."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry"), F.col("o_orderpriority").alias("grp"))
    return ann_target(spark, sf_dir).join(orders, "entry")


SQL_ANN_TARGET_BY_PRIORITY = (
    "SELECT l_orderkey AS entry, l_partkey AS term, l_returnflag, o_orderpriority AS grp "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'")


# ---------------------------------------------------------------- V_net
def net_edges(spark, sf_dir) -> DataFrame:
    """Supplier<->part network, both directions, score = quantity * 20."""
    li = table(spark, sf_dir, "lineitem")
    s = F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))
    p = F.concat(F.lit("P"), F.col("l_partkey").cast("string"))
    sc = (F.col("l_quantity") * 20).alias("combined_score")
    return li.select(s.alias("protein1"), p.alias("protein2"), sc).unionByName(
        li.select(p.alias("protein1"), s.alias("protein2"), sc))


def net_seeds(spark, sf_dir) -> DataFrame:
    """Seed proteins: suppliers of the nations of region EUROPE."""
    sup = table(spark, sf_dir, "supplier")
    nat = table(spark, sf_dir, "nation")
    reg = table(spark, sf_dir, "region").where(F.col("r_name") == "EUROPE")
    eu = nat.join(reg, nat.n_regionkey == reg.r_regionkey, "left_semi")
    return (sup.join(eu, sup.s_nationkey == eu.n_nationkey, "left_semi")
            .select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id")))


def net_entries(spark, sf_dir) -> DataFrame:
    """Entries (parts) with their cell of network ids (none, one, or one of their own and a supplier's) and one
    annotation (brand)."""
    key = F.col("p_partkey")
    own = F.concat(F.lit("P"), key.cast("string"))
    cell = (F.when(key % 7 == 3, F.lit(None)).when(key % 5 == 0, F.concat(own, F.lit("; S"), (key % 200).cast("string"), F.lit(";")))
            .when(key % 2 == 0, F.concat(own, F.lit(";"))).otherwise(own))
    return table(spark, sf_dir, "part").select(key.alias("entry"), cell.alias("net_id"), F.col("p_brand").alias("term"))


SQL_NET_EDGES = ("SELECT 'S' || l_suppkey AS protein1, 'P' || l_partkey AS protein2, l_quantity * 20 AS combined_score "
                 "FROM lineitem UNION ALL "
                 "SELECT 'P' || l_partkey, 'S' || l_suppkey, l_quantity * 20 FROM lineitem")
SQL_NET_SEEDS = ("SELECT 'S' || s_suppkey AS id FROM supplier WHERE s_nationkey IN "
                 "(SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE')")
SQL_NET_ENTRIES = ("SELECT p_partkey AS entry, CASE WHEN p_partkey % 7 = 3 THEN NULL WHEN p_partkey % 5 = 0 "
                   "THEN 'P' || p_partkey || '; S' || (p_partkey % 200) || ';' WHEN p_partkey % 2 = 0 THEN 'P' || p_partkey || ';' "
                   "ELSE 'P' || p_partkey END AS net_id, p_brand AS term FROM part")
#: one row for each id of a cell
SQL_NET_IDS = ("SELECT entry, trim(id) AS net_id, term FROM (SELECT entry, term, unnest(string_split(net_id, ';')) AS id "
               f"FROM ({SQL_NET_ENTRIES})) WHERE trim(id) <> ''")


# ---------------------------------------------------------------- V_2hop
def hop_map(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("entry"), F.col("l_partkey").alias("struct_id"))


def hop_seeds(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return (o.where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp"))
                    & (F.col("o_orderdate") < F.lit("1997-02-01").cast("timestamp")))
            .select(F.col("o_orderkey").alias("entry")))


SQL_HOP_MAP = "SELECT l_orderkey AS entry, l_partkey AS struct_id FROM lineitem"
SQL_HOP_SEEDS = ("SELECT o_orderkey AS entry FROM orders WHERE o_orderpriority = '1-URGENT' "
                 "AND o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-02-01'")


# ---------------------------------------------------------------- V_list / V_br
def order_brand_list(spark, sf_dir) -> DataFrame:
    """Per order: ';'-terminated list of its distinct brands, sorted."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return (li.join(part, li.l_partkey == part.p_partkey)
            .groupBy(F.col("l_orderkey").alias("entry"))
            .agg(F.concat(F.array_join(F.array_sort(F.collect_set("p_brand")), ";"), F.lit(";")).alias("pfam_ids")))


SQL_ORDER_BRAND_LIST = ("SELECT l_orderkey AS entry, string_agg(DISTINCT p_brand, ';' ORDER BY p_brand) || ';' AS pfam_ids "
                        "FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey")


def order_bracketed(spark, sf_dir) -> DataFrame:
    """Per order: 'name [GO:0000123]; ...' over its line items (sorted items)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    descr = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.col("p_name"), F.lit("; type II"))).otherwise(F.col("p_name"))
    item = F.concat(descr, F.lit(" [GO:"), F.lpad(F.col("p_partkey").cast("string"), 7, "0"), F.lit("]"))
    return (li.join(part, li.l_partkey == part.p_partkey)
            .groupBy(F.col("l_orderkey").alias("entry"))
            .agg(F.array_join(F.array_sort(F.collect_list(item)), "; ").alias("go")))


SQL_GO_DESCR = "p_name || CASE WHEN p_partkey % 3 = 0 THEN '; type II' ELSE '' END"
SQL_ORDER_BRACKETED = (f"SELECT l_orderkey AS entry, string_agg({SQL_GO_DESCR} || ' [GO:' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') || ']', "
                       f"'; ' ORDER BY {SQL_GO_DESCR} || ' [GO:' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') || ']') AS go "
                       "FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey")


# ---------------------------------------------------------------- V_int
def int_hits(spark, sf_dir) -> DataFrame:
    """Domain hits of three 'models' (return flags) per order; duplicates removed."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("entry"), F.col("l_returnflag").alias("model"),
                     (F.col("l_linenumber") * 10).alias("seq_start"),
                     (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int")).alias("seq_end")).distinct()


def int_truth(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where(F.col("l_linestatus") == "F")
    return li.select(F.col("l_orderkey").alias("entry"), (F.col("l_linenumber") * 10).alias("seq_start"),
                     (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int")).alias("seq_end")).distinct()


def int_struct(spark, sf_dir) -> DataFrame:
    """Structures (supplier ids) mapped onto open line items' ranges."""
    li = table(spark, sf_dir, "lineitem").where(F.col("l_linestatus") == "O")
    return li.select(F.col("l_orderkey").alias("entry"), F.col("l_suppkey").alias("struct_id"),
                     (F.col("l_linenumber") * 10 - 5).alias("s_start"),
                     (F.col("l_linenumber") * 10 + 25).alias("s_end"))


def int_entries(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry"), F.lit(121).alias("len"))


SQL_INT_HITS = ("SELECT DISTINCT l_orderkey AS entry, l_returnflag AS model, l_linenumber * 10 AS seq_start, "
                "l_linenumber * 10 + CAST(l_quantity AS INTEGER) AS seq_end FROM lineitem")
SQL_INT_TRUTH = ("SELECT DISTINCT l_orderkey AS entry, l_linenumber * 10 AS seq_start, "
                 "l_linenumber * 10 + CAST(l_quantity AS INTEGER) AS seq_end FROM lineitem WHERE l_linestatus = 'F'")
SQL_INT_STRUCT = ("SELECT l_orderkey AS entry, l_suppkey AS struct_id, l_linenumber * 10 - 5 AS s_start, "
                  "l_linenumber * 10 + 25 AS s_end FROM lineitem WHERE l_linestatus = 'O'")
SQL_INT_ENTRIES = "SELECT o_orderkey AS entry, 121 AS len FROM orders"


# ---------------------------------------------------------------- V_code
def cust_codes(spark, sf_dir) -> DataFrame:
    """Hierarchical class code 'region.nation.segment.bucket' per customer."""
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    code = F.concat_ws(".", F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string"),
                       F.col("c_mktsegment"), (F.col("c_custkey") % 7).cast("string"))
    return c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_custkey").alias("entry"), code.alias("code"))


SQL_CUST_CODES = ("SELECT c_custkey AS entry, CAST(n_regionkey AS VARCHAR) || '.' || CAST(n_nationkey AS VARCHAR) || '.' "
                  "|| c_mktsegment || '.' || CAST(c_custkey % 7 AS VARCHAR) AS code "
                  "FROM customer JOIN nation ON c_nationkey = n_nationkey")


# ---------------------------------------------------------------- labels / documents
def doc_universe(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id")


def doc_truth(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "labels").where(F.col("quality") == 1).select("doc_id")


def doc_pred(spark, sf_dir, min_chars: int = 2000) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.col("n_chars") >= min_chars).select("doc_id")


DOC_CUTOFFS = (500, 1000, 2000, 5000)
