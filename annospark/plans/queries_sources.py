"""Registered queries: text formats and files (A), with records that Spark makes from the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from annospark.operators import matrix as mx
from annospark.plans import bindings as V
from annospark.plans.catalog import ENR_COLS, REGISTRY, register, rounded
from annospark.plans.run import enrichment_run
from annospark.session import ensure_checkpoint_dir
from annospark.sources import readers as rd
from annospark.sources import sinks


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _s(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


# ------------------------------------------------------------------ tables
@register("table_file", "SELECT lpad(l_orderkey::VARCHAR, 10, '0') AS entry, l_partkey::VARCHAR AS term, l_linenumber AS n FROM lineitem")
def q_table_file(spark, sf_dir):
    """A written table read back; ids keep their leading zeros."""
    path = _folder(spark, "table-file")
    sinks.write_table(V.table(spark, sf_dir, "lineitem").select(
        F.lpad(_s("l_orderkey"), 10, "0").alias("entry"), _s("l_partkey").alias("term"), F.col("l_linenumber").alias("n")), path)
    return rd.read_table(spark, path, types={"n": "int"})


@register("commented_file", "SELECT p_partkey::VARCHAR AS pdb, p_brand AS chain, p_name AS entry_ac, p_size::VARCHAR AS res_beg FROM part")
def q_commented_file(spark, sf_dir):
    """A2: comment rows are left out, columns renamed."""
    path = _folder(spark, "commented-file")
    rows = V.table(spark, sf_dir, "part").select(_s("p_partkey").alias("PDB"), F.col("p_brand").alias("CHAIN"),
                                                 F.col("p_name").alias("SP_PRIMARY"), _s("p_size").alias("RES_BEG"))
    sinks.write_table(rows, path)
    rows.where("RES_BEG = '7'").select(F.concat(F.lit("# note on "), "PDB").alias("value")).write.mode("append").text(path)
    return rd.read_commented_table(spark, path, ["pdb", "chain", "entry_ac", "res_beg"])


@register("edges_file", f"SELECT protein1, protein2, combined_score::INTEGER AS combined_score FROM ({V.SQL_NET_EDGES}) "
          f"WHERE protein1 IN ({V.SQL_NET_SEEDS}) OR protein2 IN ({V.SQL_NET_SEEDS})")
def q_edges_file(spark, sf_dir):
    """A3: compressed edge list, spread after the read, edges with an end in the seeds kept."""
    path = _folder(spark, "edges-file")
    (V.net_edges(spark, sf_dir).withColumn("combined_score", F.col("combined_score").cast("int"))
     .write.option("sep", " ").option("header", True).option("compression", "gzip").csv(path))
    return rd.read_edges(spark, path, keep=V.net_seeds(spark, sf_dir))


@register("partitioned_files", "SELECT o_orderkey::VARCHAR AS entry, CASE WHEN o_orderpriority = '1-URGENT' THEN 'again' ELSE o_orderstatus END AS status, "
          "o_orderpriority AS grp FROM orders")
def q_partitioned_files(spark, sf_dir):
    """One directory a value; a second run of one value replaces that value only."""
    path = _folder(spark, "partitioned-files")
    rows = V.table(spark, sf_dir, "orders").select(_s("o_orderkey").alias("entry"), F.col("o_orderstatus").alias("status"),
                                                   F.col("o_orderpriority").alias("grp"))
    sinks.write_partitioned(rows, path, "grp", rows_per_file=2000)
    sinks.write_partitioned(rows.where("grp = '1-URGENT'").withColumn("status", F.lit("again")), path, "grp", rows_per_file=2000)
    return rd.read_table(spark, path)


# ------------------------------------------------------------------ ontologies
def _graph_documents(spark, sf_dir, second: str = "part_of", deprecated: int = 50):
    """OBO-graph documents, one for each part size: k -> k div 2 by is_a, k -> k div 3 by ``second``."""
    key = F.col("p_partkey")

    def term(k):
        return F.concat(F.lit("http://example.org/GO_"), _s(k))

    def edge(pred, parent):
        return F.struct(term(key).alias("sub"), F.lit(pred).alias("pred"), term(parent.cast("long")).alias("obj"))
    meta = F.when(F.col("p_size") == deprecated, F.struct(F.lit("true").alias("deprecated")))
    edges = F.when(key >= 1, F.array(edge("is_a", F.floor(key / 2)), edge(second, F.floor(key / 3)))).otherwise(
        F.array().cast("array<struct<sub:string,pred:string,obj:string>>"))
    docs = (V.table(spark, sf_dir, "part").select("p_size", F.struct(term(key).alias("id"), F.col("p_name").alias("lbl"), meta.alias("meta")).alias("node"),
                                                  edges.alias("edges"))
            .groupBy("p_size").agg(F.collect_list("node").alias("nodes"), F.flatten(F.collect_list("edges")).alias("edges")))
    return docs.select(F.to_json(F.struct(F.array(F.struct("nodes", "edges")).alias("graphs"))).alias("value"))


@register("obograph_documents", "SELECT 'node' AS part, p_partkey::VARCHAR AS term, p_name AS other FROM part WHERE p_size <> 50 "
          "UNION ALL SELECT 'edge', p_partkey::VARCHAR, (p_partkey // 2)::VARCHAR FROM part WHERE p_partkey >= 1")
def q_obograph(spark, sf_dir):
    """A4: nodes without deprecated ones, is_a edges only."""
    nodes, edges = rd.parse_obograph(_graph_documents(spark, sf_dir))
    return (nodes.select(F.lit("node").alias("part"), "term", F.col("label").alias("other"))
            .unionByName(edges.select(F.lit("edge").alias("part"), F.col("child").alias("term"), F.col("parent").alias("other"))))


@register("obo_stanzas", "SELECT p_partkey::VARCHAR AS term, p_name AS label, p_type || ': ' || p_brand AS descr, "
          "CASE WHEN p_partkey % 3 = 0 THEN p_partkey * 11 WHEN p_partkey % 3 = 1 THEN p_partkey * 7 END::VARCHAR AS omim, "
          "unnest([p_partkey // 2, p_partkey // 3])::VARCHAR AS parent FROM part WHERE p_partkey % 10 <> 9")
def q_obo_stanzas(spark, sf_dir):
    """A5: terms with their last cross reference and parents, obsolete ones left out."""
    k = F.col("p_partkey")

    def xref(times):
        return F.concat(F.lit("xref: OMIM:"), _s(k * times))

    def parent(div):
        return F.concat(F.lit("is_a: DOID:"), _s(F.floor(k / div).cast("long")), F.lit(" ! a parent"))
    lines = [F.lit("[Term]"), F.concat(F.lit("id: DOID:"), _s(k)), F.concat(F.lit("name: "), "p_name"),
             F.concat(F.lit('def: "'), "p_type", F.lit(": "), "p_brand", F.lit('" [url]')),
             F.when(k % 3 < 2, xref(7)), F.when(k % 3 == 0, xref(11)), parent(2), parent(3),
             F.when(k % 10 == 9, F.lit("is_obsolete: true"))]
    nodes, edges = rd.parse_obo(V.table(spark, sf_dir, "part").select(F.concat_ws("\n", *lines).alias("value")))
    return nodes.join(edges, nodes.term == edges.child).select("term", "label", "descr", "omim", "parent")


@register("entry_map_file", "SELECT DISTINCT l_suppkey::VARCHAR AS entry, 'P' || l_partkey AS id FROM lineitem")
def q_entry_map(spark, sf_dir):
    """Objects of id lists, read by list."""
    path = _folder(spark, "entry-map")
    lists = (V.table(spark, sf_dir, "lineitem").groupBy(_s("l_suppkey").alias("entry"))
             .agg(F.collect_set(F.concat(F.lit("P"), _s("l_partkey"))).alias("ids")))
    lists.select(F.to_json(F.map_from_arrays(F.array("entry"), F.array("ids"))).alias("value")).write.text(path)
    return rd.read_entry_map(spark, path)


# ------------------------------------------------------------------ search results, sequences, reports
@register("blast_tab_lines", "SELECT 'Q' || l_orderkey AS query_ac, 'U' || l_partkey AS subj_ac, l_extendedprice AS perc_identity, l_linenumber AS align_len, "
          "1 AS mismatches, 0 AS gap_opens, 2 AS q_start, l_linenumber + 9 AS q_end, 3 AS s_start, 44 AS s_end, l_discount AS e_value, "
          "l_tax AS bit_score FROM lineitem")
def q_blast_tab(spark, sf_dir):
    """Typed hits, comments and trailers left out."""
    li = V.table(spark, sf_dir, "lineitem")
    fields = [F.concat(F.lit("Q"), _s("l_orderkey")), F.concat(F.lit("U"), _s("l_partkey")), _s("l_extendedprice"), _s("l_linenumber"), F.lit("1"),
              F.lit("0"), F.lit("2"), _s(F.col("l_linenumber") + 9), F.lit(" 3 "), F.lit("44"), _s("l_discount"), _s("l_tax")]
    lines = li.select(F.concat_ws(",", *fields).alias("value"))
    notes = li.where("l_linenumber = 1").select(F.concat(F.lit("# query "), _s("l_orderkey")).alias("value"))
    return rd.parse_blast_tab(lines.unionByName(notes).unionByName(notes.select(F.lit("rows: 9").alias("value"))))


@register("domtblout_lines", "SELECT 'P' || p_partkey AS entry_ac, 'sp' AS target_db, 'G' || p_size AS target_gene, p_partkey::VARCHAR AS seq_start, "
          "(p_partkey + p_size)::VARCHAR AS seq_end, '1e-' || p_size AS e_value, p_name AS description FROM part")
def q_domtblout(spark, sf_dir):
    """Domain table of white-space fields."""
    k, size = F.col("p_partkey"), F.col("p_size")
    first = F.concat(F.lit("sp|P"), _s(k), F.lit("|G"), _s(size))
    fields = [first, F.lit("-"), F.lit("120"), F.lit("WW"), F.lit("PF00397.29"), F.lit("31"), F.lit("2e-9"), F.lit("40.1"), F.lit("0.2"), F.lit("1"),
              F.lit("2"), F.lit("3e-9"), F.concat(F.lit("1e-"), _s(size)), F.lit("39.9"), F.lit("0.1"), F.lit("2"), F.lit("30"), _s(k), _s(k + size),
              F.lit("5"), F.lit("60"), F.lit("0.97"), F.col("p_name")]
    lines = V.table(spark, sf_dir, "part").select(F.concat_ws("   ", *fields).alias("value"))
    lines = lines.unionByName(lines.limit(1).select(F.lit("# target name").alias("value")))
    return rd.parse_domtblout(lines, raw=True).select(
        F.col("target_name").alias("entry_ac"), "target_db", "target_gene", F.col("align_from").alias("seq_start"),
        F.col("align_to").alias("seq_end"), F.col("dom_i_evalue").alias("e_value"), "description")


@register("blast_xml_hits", "SELECT 'A' || p_partkey AS ac, 'uni' AS database, p_name AS description, p_size + x AS score, p_retailprice AS expectation, "
          "x AS match_start, x + p_size AS match_end, upper(replace(p_name, ' ', '')) AS match_seq FROM part, "
          "unnest(CASE WHEN p_partkey % 2 = 0 THEN [1, 40] ELSE [1] END) u(x)")
def q_blast_xml(spark, sf_dir):
    """Hit elements with one or two alignments."""
    def alignment(x):
        seq = F.upper(F.replace("p_name", F.lit(" "), F.lit("")))
        return F.concat(F.lit("<alignment><score>"), _s(F.col("p_size") + x), F.lit("</score><expectation>"), _s("p_retailprice"),
                        F.lit(f'</expectation><strand>none</strand><matchSeq start="{x}" end="'), _s(F.col("p_size") + x), F.lit('">'), seq,
                        F.lit("</matchSeq></alignment>"))
    two = F.when(F.col("p_partkey") % 2 == 0, alignment(40)).otherwise(F.lit(""))
    hit = F.concat(F.lit('<hit database="uni" id="U'), _s("p_partkey"), F.lit('" ac="A'), _s("p_partkey"), F.lit('" description="'), F.col("p_name"),
                   F.lit('"><alignments>'), alignment(1), two, F.lit("</alignments></hit>"))
    rows = rd.parse_blast_xml(V.table(spark, sf_dir, "part").select(hit.alias("value")))
    return rows.select("ac", "database", "description", "score", "expectation", "match_start", "match_end", "match_seq")


@register("fasta_records", "SELECT 'UniRef90_P' || p_partkey AS id, p_type AS descr, upper(replace(p_name, ' ', '')) || p_brand AS seq FROM part")
def q_fasta(spark, sf_dir):
    """A10: records with wrapped sequences, written as files and read back."""
    path = _folder(spark, "fasta")
    seq = F.upper(F.replace("p_name", F.lit(" "), F.lit("")))
    record = F.concat(F.lit(">UniRef90_P"), _s("p_partkey"), F.lit(" "), "p_type", F.lit("\n"), seq, F.lit("\n"), "p_brand")
    V.table(spark, sf_dir, "part").select(record.alias("value")).write.text(path)
    return rd.read_fasta(spark, path)


def _reports(spark, sf_dir):
    k = F.col("p_partkey")
    lines = [F.concat(F.lit("Name of Chain_1: /data/"), _s(k), F.lit(".pdb")), F.concat(F.lit("Name of Chain_2: /data/"), _s(F.floor(k / 2).cast("long")), F.lit(".pdb")),
             F.concat(F.lit("Length of Chain_1: "), _s(k), F.lit(" residues")), F.concat(F.lit("Length of Chain_2: "), _s("p_size"), F.lit(" residues")),
             F.lit(""), F.concat(F.lit("Aligned length=  "), _s("p_size"), F.lit(", RMSD=   "), F.format_string("%.2f", F.col("p_size") / 10),
                                 F.lit(", Seq_ID=n_identical/n_aligned= 0.250")),
             F.lit("TM-score= 0.90000 (if normalized by length of Chain_1)"), F.lit("TM-score= 0.80000 (if normalized by length of Chain_2)"),
             F.concat(F.lit("TM-score= "), F.format_string("%.5f", F.col("p_size") / 100), F.lit(" (if normalized by average length)")), F.lit("")]
    parts = V.table(spark, sf_dir, "part").where("p_partkey >= 1")
    return rd.parse_alignment_reports(parts.select(F.concat_ws("\n", *lines).alias("value"), F.concat(_s(k), F.lit(".txt")).alias("file_name")))


@register("alignment_reports", "SELECT p_partkey || '.txt' AS file_name, '/data/' || p_partkey || '.pdb' AS name_1, p_partkey::INTEGER AS len_1, "
          "'/data/' || (p_partkey // 2) || '.pdb' AS name_2, p_size AS len_2, 0.9::DOUBLE AS tm_1, 0.8::DOUBLE AS tm_2, "
          "printf('%.5f', p_size / 100.0)::DOUBLE AS tm_score, p_size AS align_len, printf('%.2f', p_size / 10.0)::DOUBLE AS rmsd, "
          "0.25::DOUBLE AS seq_id FROM part WHERE p_partkey >= 1")
def q_alignment_reports(spark, sf_dir):
    """Structure alignment reports."""
    return _reports(spark, sf_dir)


@register("report_matrix", "WITH p AS (SELECT '/data/' || p_partkey || '.pdb' AS i, '/data/' || (p_partkey // 2) || '.pdb' AS j, "
          "round(1 - printf('%.5f', p_size / 100.0)::DOUBLE, 6) AS d FROM part WHERE p_partkey >= 1) "
          "SELECT i, j, d FROM p UNION SELECT j, i, d FROM p UNION SELECT i, i, 0 FROM p UNION SELECT j, j, 0 FROM p")
def q_report_matrix(spark, sf_dir):
    """K3: symmetric long matrix of one minus the normalised score."""
    return mx.report_matrix(_reports(spark, sf_dir), "tm").withColumn("d", F.round("d", 6))


# ------------------------------------------------------------------ from files to files
@register("enrichment_from_files", REGISTRY["enrich_many"][1])
def q_enrichment_from_files(spark, sf_dir):
    """Annotations, target groups and the graph written as files, then the whole run over them."""
    names = ["background", "targets", "graph", "out"]
    paths = {n: _folder(spark, f"run-{n}") for n in names}
    ann = V.ann(spark, sf_dir).select(_s("entry").alias("entry"), _s("term").alias("term"))
    target = V.ann_target_by_priority(spark, sf_dir).select(F.col("grp"), _s("entry").alias("entry"), _s("term").alias("term"))
    sinks.write_table(ann, paths["background"])
    sinks.write_partitioned(target, paths["targets"], "grp")
    _graph_documents(spark, sf_dir, "is_a", 0).write.text(paths["graph"])
    enrichment_run(spark, paths["background"], paths["targets"], paths["graph"], paths["out"], group="grp", graph_lines=True,
                   max_p=0.05, max_depth=4, bonferroni=True)
    types = {c: "long" for c in ("term", "tp", "tn", "fp", "fn")} | {c: "double" for c in ("odds_ratio", "log_p", "p_value", "score")}
    res = rd.read_table(spark, paths["out"], types=types | {"depth": "int"})
    return rounded(res.select("grp", *ENR_COLS, "score"))
