import os

import pytest
from pyspark.sql import functions as F

from annospark.sources import readers as rd
from annospark.sources.sinks import write_partitioned, write_table


def test_read_fasta(spark, fixtures):
    df = rd.read_fasta(spark, os.path.join(fixtures, "sequences.fasta"))
    assert df.count() == 451
    first = df.where(F.col("id") == "UniRef90_P43582").first()
    assert first["descr"].startswith("WW domain-containing protein WWM1")
    assert first["seq"].startswith("MAQSKSNPPQVPSGWKAVFDDEYQTWYYVDLSTNSSQWEPPRG")
    assert "\n" not in first["seq"]


def test_read_blast_tab(spark, fixtures):
    df = rd.read_blast_tab(spark, os.path.join(fixtures, "hits.csv"), sep=",", header=True)
    assert df.count() == 451
    assert df.agg(F.max("e_value")).first()[0] <= 1e-3
    assert dict(df.dtypes)["align_len"] == "int"


def test_read_table_drops_leaked_index(spark, fixtures):
    df = rd.read_table(spark, os.path.join(fixtures, "golden", "do", "targets", "PF00397_arch.csv"))
    assert df.columns == ["entry_ac", "do_id", "name", "descr"]
    ids = {r[0] for r in df.select("do_id").collect()}
    assert all(isinstance(i, str) for i in ids)


def test_truth_ranges_parse(spark, fixtures):
    from annospark.operators.reshape import parse_ranges
    df = rd.read_table(spark, os.path.join(fixtures, "truth_ranges.tsv"))
    df = df.select(F.col("Accession").alias("entry"), parse_ranges(F.col("Matches")).alias("r"))
    assert df.count() == 178
    assert df.select(F.sum(F.size("r"))).first()[0] == 304


def test_read_obo(spark, fixtures):
    for name in ("ontology.obo", "ontology_nonl.obo"):
        nodes, edges = rd.read_obo(spark, os.path.join(fixtures, "synthetic", name))
        got = {r["term"]: r for r in nodes.collect()}
        assert set(got) == {"4", "162", "10763", "1000"}
        assert got["162"]["omim"] == "100001"
        assert got["4"]["descr"] == "A disease is a disposition: it has several parts."
        pairs = {(r["child"], r["parent"]) for r in edges.collect()}
        assert pairs == {("162", "4"), ("10763", "4"), ("10763", "162"), ("1000", "10763")}


def test_read_obograph(spark, fixtures):
    nodes, edges = rd.read_obograph(spark, os.path.join(fixtures, "synthetic", "graph.json"))
    assert {r["term"] for r in nodes.collect()} == {"0000001", "0000002", "0000010", "0000011", "0000020"}
    assert {(r["child"], r["parent"]) for r in edges.collect()} == {
        ("0000010", "0000001"), ("0000011", "0000001"), ("0000020", "0000010"), ("0000020", "0000011"),
        ("0000099", "0000002")}


def test_read_domtblout(spark, fixtures):
    df = rd.read_domtblout(spark, os.path.join(fixtures, "synthetic", "domains.tbl"), raw=True)
    rows = df.collect()
    assert len(rows) == 3
    assert rows[0]["target_name"] == "P46937" and rows[0]["target_db"] == "sp"
    assert rows[0]["description"] == "Transcriptional coactivator YAP1"
    assert rows[2]["description"] == "Uncharacterized"
    hits = rd.read_domtblout(spark, os.path.join(fixtures, "synthetic", "domains.tbl"))
    assert hits.columns == ["entry_ac", "seq_start", "seq_end", "e_value"]


def test_read_blast_xml(spark, fixtures):
    df = rd.read_blast_xml(spark, os.path.join(fixtures, "synthetic", "hits.xml"))
    rows = sorted(df.collect(), key=lambda r: (r["id"], r["match_start"]))
    assert len(rows) == 3
    assert rows[0]["id"] == "UniRef90_P1" and rows[0]["match_start"] == 11 and rows[0]["score"] == 150
    assert [r["match_start"] for r in rows[1:]] == [5, 50]
    assert len(df.columns) == 15


def test_read_alignment_reports(spark, fixtures):
    df = rd.read_alignment_reports(spark, os.path.join(fixtures, "synthetic", "reports"))
    rows = {(r["name_1"], r["name_2"]): r for r in df.collect()}
    assert rows[("/data/a.pdb", "/data/b.pdb")]["tm_score"] == 0.60
    assert rows[("/data/a.pdb", "/data/c.pdb")]["rmsd"] == 3.5
    assert rows[("/data/b.pdb", "/data/c.pdb")]["align_len"] == 33


def test_report_matrix(spark, fixtures):
    from annospark.operators.matrix import report_matrix
    df = rd.read_alignment_reports(spark, os.path.join(fixtures, "synthetic", "reports"))
    m = {(r["i"], r["j"]): r["d"] for r in report_matrix(df, "tm").collect()}
    assert len(m) == 9
    assert abs(m[("/data/b.pdb", "/data/a.pdb")] - 0.40) < 1e-12
    assert m[("/data/c.pdb", "/data/c.pdb")] == 0.0


def test_read_entry_map(spark, fixtures):
    df = rd.read_entry_map(spark, os.path.join(fixtures, "synthetic", "entry_map.json"))
    assert sorted(tuple(r) for r in df.collect()) == [("P1", "10763"), ("P1", "162"), ("P2", "4")]


def test_read_edges_and_keep(spark, fixtures):
    path = os.path.join(fixtures, "synthetic", "edges.txt.gz")
    df = rd.read_edges(spark, path, partitions=2)
    assert df.count() == 5
    keep = spark.createDataFrame([("9606.C",)], "id string")
    kept = rd.read_edges(spark, path, keep=keep)
    assert sorted((r[0], r[1]) for r in kept.collect()) == [("9606.A", "9606.C"), ("9606.C", "9606.D")]


def test_read_commented_table(spark, fixtures):
    names = ["pdb_id", "chain", "entry_ac", "res_beg", "res_end", "pdb_beg", "pdb_end", "seq_start", "seq_end"]
    df = rd.read_commented_table(spark, os.path.join(fixtures, "synthetic", "structure_map.tsv"), names)
    assert df.count() == 3 and df.columns == names


def test_sinks_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([("a;b", 1), ("a;b", 2), ("c", 3)], "architecture string, v int")
    write_table(df, str(tmp_path / "t"))
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "t")).count() == 3
    write_partitioned(df, str(tmp_path / "p"), "architecture")
    back = spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "p"))
    assert sorted(r["architecture"] for r in back.collect()) == ["a;b", "a;b", "c"]


def test_entry_map_of_one_large_object(spark, tmp_path):
    import json
    rows = {f"P{i}": [f"{i}", f"a,{i}", 'q"uote'][: i % 4] for i in range(4000)}
    (tmp_path / "map.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "lines.json").write_text('{"X": ["1"]}\n{"Y": [],\n "Z": ["2", "3"]}\n')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        df = rd.read_entry_map(spark, str(tmp_path / "map.json"))
        assert df.rdd.getNumPartitions() > 4
        got = sorted(tuple(r) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == sorted((k, x) for k, v in rows.items() for x in v)
    assert sorted(tuple(r) for r in rd.read_entry_map(spark, str(tmp_path / "lines.json")).collect()) == [("X", "1"), ("Z", "2"), ("Z", "3")]


@pytest.mark.parametrize("text", ['{"P1": ["1", "2"', '{"P1": "1"}', "no map", '{"P1": ["1"], "P2": [2, {]}'])
def test_malformed_entry_map_raises(spark, tmp_path, text):
    (tmp_path / "map.json").write_text(text)
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        rd.read_entry_map(spark, str(tmp_path / "map.json")).collect()


def test_partitioned_files_by_measured_size(spark, tmp_path):
    rows = [("hot", i) for i in range(900)] + [("cold", 1), ("warm", 2), (None, 3)]
    df = spark.createDataFrame(rows, "architecture string, v int").repartition(7)
    path = tmp_path / "p"
    write_partitioned(df, str(path), "architecture", rows_per_file=100)
    files = {d.name: len(list(d.glob("part-*"))) for d in path.iterdir() if d.is_dir()}
    assert files.pop("architecture=hot") > 3 and set(files.values()) == {1} and len(files) == 3
    write_partitioned(spark.createDataFrame([("cold", 7)], "architecture string, v int"), str(path), "architecture")
    back = spark.read.option("header", True).option("sep", "\t").csv(str(path))
    assert back.count() == 903 and [r["v"] for r in back.where("architecture = 'cold'").collect()] == ["7"]


def test_run_from_files_to_files(spark, fixtures, tmp_path):
    """Committed target tables as one directory a group, a graph over their terms, one result directory a group."""
    import glob
    import json

    from annospark.plans.run import enrichment_run
    from annospark.sources.sinks import write_table
    targets = rd.read_table(spark, os.path.join(fixtures, "golden", "go", "targets"), with_file=True)
    targets = targets.select(F.regexp_replace("file_name", "_arch[.]csv$", "").alias("architecture"), F.col("entry_ac").alias("entry"),
                             F.col("go_id").alias("term"))
    write_table(targets.drop("architecture"), str(tmp_path / "background"))
    write_partitioned(targets, str(tmp_path / "targets"), "architecture")
    terms = sorted(r[0] for r in targets.select("term").distinct().collect())
    nodes = [{"id": "x/GO_root", "lbl": "root"}, *({"id": f"x/GO_{t}", "lbl": f"term {t}"} for t in terms)]
    edges = [{"sub": f"x/GO_{t}", "pred": "is_a", "obj": "x/GO_root"} for t in terms]
    (tmp_path / "graph.json").write_text(json.dumps({"graphs": [{"nodes": nodes, "edges": edges}]}))
    rows = enrichment_run(spark, str(tmp_path / "background"), str(tmp_path / "targets"), str(tmp_path / "graph.json"),
                          str(tmp_path / "out"), bonferroni=False).collect()
    written = {r["architecture"] for r in rows}
    assert len(written) == 31 and len(glob.glob(str(tmp_path / "out" / "architecture=*"))) == 31
    # a flat graph propagates nothing: odds ratios and p-values are those of the committed results without propagation
    got = {(r["architecture"], r["term"]): r for r in rows}
    first = got["PF00397;PF00632", "0042391"]
    assert abs(first["odds_ratio"] - 9.111111111) < 1e-6 and abs(first["p_value"] - 0.041769477) < 1e-6
    back = rd.read_table(spark, str(tmp_path / "out"), types={"p_value": "double"})
    assert back.count() == len(rows) and back.where("p_value IS NULL").count() == 0
