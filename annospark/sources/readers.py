"""Bulk ingest of the reference's file formats into typed DataFrames.

Every reader takes a path (file, directory or glob) and returns a DataFrame;
parsing is done with column expressions, in functions of text records (column
``value``) that any source can feed.  Text formats with record separators are
read with ``lineSep`` so that large files stay splittable; formats that are
single documents (one JSON graph, one report per file) are parsed per file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAKED_INDEX_COLUMNS = ("_c0", "Unnamed: 0", "")

# Fixed column layouts of the external tools' outputs.
BLAST_TAB_COLUMNS = ("query_ac", "subj_ac", "perc_identity", "align_len", "mismatches", "gap_opens",
                     "q_start", "q_end", "s_start", "s_end", "e_value", "bit_score")
BLAST_TAB_TYPES = ("string", "string", "double", "int", "int", "int", "int", "int", "int", "int", "double", "double")
DOMTBL_COLUMNS = ("target_db", "target_name", "target_gene", "target_accession", "target_len",
                  "query_name", "query_accession", "query_len",
                  "full_seq_evalue", "full_seq_score", "full_seq_bias",
                  "dom_nr", "dom_of", "dom_c_evalue", "dom_i_evalue", "dom_score", "dom_bias",
                  "hmm_from", "hmm_to", "align_from", "align_to", "env_from", "env_to",
                  "acc", "description")


def read_table(spark: SparkSession, path: str, sep: str = "\t", types: dict[str, str] | None = None,
               with_file: bool = False) -> DataFrame:
    """A1: delimited table with header; every column is read as text (ids keep
    leading zeros), leaked pandas index columns are dropped, ``types`` casts
    selected columns.  ``with_file`` adds the source file name."""
    df = spark.read.option("header", True).option("sep", sep).option("inferSchema", False).csv(path)
    if with_file:
        df = df.withColumn("file_name", F.col("_metadata.file_name"))
    drop = [c for c in df.columns if c in LEAKED_INDEX_COLUMNS]
    df = df.drop(*drop)
    for c, t in (types or {}).items():
        df = df.withColumn(c, F.col(c).try_cast(t))
    return df


def read_commented_table(spark: SparkSession, path: str, names: Sequence[str], sep: str = "\t") -> DataFrame:
    """A2: first line is a comment, second the header; columns renamed to ``names``."""
    df = (spark.read.option("header", True).option("sep", sep).option("comment", "#")
          .option("inferSchema", False).csv(path))
    return df.toDF(*names)


def read_edges(spark: SparkSession, path: str, keep: DataFrame | None = None, sep: str = " ",
               partitions: int | None = None) -> DataFrame:
    """A3: space-separated edge list (gz read natively) with header
    protein1 protein2 combined_score; optional ``keep`` (column ``id``)
    keeps edges with either endpoint in it (C4).  A gzip file is one split, so
    its rows are spread after the read, over ``partitions`` or the session's
    default parallelism."""
    df = (spark.read.option("header", True).option("sep", sep).csv(path)
          .select("protein1", "protein2", F.col("combined_score").try_cast("int").alias("combined_score")))
    if partitions or any(f.endswith(".gz") for f in df.inputFiles()):
        df = df.repartition(partitions or spark.sparkContext.defaultParallelism)
    if keep is not None:
        from annospark.operators.setops import edge_keep
        df = edge_keep(df, keep)
    return df


OBOGRAPH = ("graphs array<struct<nodes:array<struct<id:string,lbl:string,meta:struct<deprecated:string>>>,"
            "edges:array<struct<sub:string,pred:string,obj:string>>>>")


def read_obograph(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """A4: OBO-graph JSON, one document per file (or per line) -> (nodes(term, label), edges(child, parent))."""
    return parse_obograph(spark.read.text(path, wholetext=not lines))


def parse_obograph(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A4 on JSON documents (column ``value``); a malformed one raises.

    Nodes: ids containing 'GO_' without a ``deprecated`` flag in ``meta``; the
    term id is the text after '_'.  Edges: ``pred == 'is_a'`` only.
    """
    graph = docs.select(F.explode(F.from_json("value", OBOGRAPH, {"mode": "FAILFAST"})["graphs"]).alias("g"))
    nodes = (graph.select(F.explode("g.nodes").alias("n"))
             .where(F.col("n.id").contains("GO_") & F.col("n.meta.deprecated").isNull())
             .select(F.get(F.split(F.col("n.id"), "_"), F.lit(1)).alias("term"), F.col("n.lbl").alias("label")))
    edges = (graph.select(F.explode("g.edges").alias("e"))
             .where(F.col("e.pred") == "is_a")
             .select(F.get(F.split(F.col("e.sub"), "_"), F.lit(1)).alias("child"),
                     F.get(F.split(F.col("e.obj"), "_"), F.lit(1)).alias("parent")))
    return nodes, edges


def read_obo(spark: SparkSession, path: str, prefix: str = "DOID") -> tuple[DataFrame, DataFrame]:
    """A5: OBO stanzas, separated by blank lines -> (nodes(term, label, descr, omim), edges(child, parent))."""
    return parse_obo(spark.read.option("lineSep", "\n\n").text(path), prefix)


def parse_obo(stanzas: DataFrame, prefix: str = "DOID") -> tuple[DataFrame, DataFrame]:
    """A5 on stanzas (column ``value``).

    Obsolete terms and stanzas without a ``prefix`` id are skipped; the last
    OMIM xref wins; ``is_a`` keeps the id part of its first token.
    """
    st = stanzas.select(F.col("value").alias("s"))
    term = F.regexp_extract("s", rf"(?m)^id: {prefix}:(\S+)", 1)
    omims = F.regexp_extract_all("s", F.lit(r"(?m)^xref: OMIM:(\S+)"), 1)
    parsed = st.select(
        term.alias("term"),
        F.regexp_extract("s", r"(?m)^name: (.*)$", 1).alias("label"),
        F.regexp_extract("s", r'(?m)^def: "([^"]*)"', 1).alias("descr"),
        F.when(F.size(omims) > 0, F.element_at(omims, -1)).alias("omim"),
        F.regexp_extract_all("s", F.lit(r"(?m)^is_a: [^:\s]+:(\S+)"), 1).alias("parents"),
        F.col("s").rlike(r"(?m)^is_obsolete: true").alias("obsolete"),
    ).where((F.col("term") != "") & ~F.col("obsolete"))
    nodes = parsed.select("term", F.nullif(F.col("label"), F.lit("")).alias("label"),
                          F.nullif(F.col("descr"), F.lit("")).alias("descr"), "omim")
    edges = parsed.select(F.col("term").alias("child"), F.explode("parents").alias("parent"))
    return nodes, edges


def read_entry_map(spark: SparkSession, path: str, key: str = "entry", value: str = "id") -> DataFrame:
    """JSON object {entry: [id, ...]} -> (entry, id) rows.

    Records end with the lists' closing brackets, so one large object (or many
    small ones) is read by many tasks.  Text that is no such object raises,
    cut-off files included; so does an id or entry with a closing bracket, which
    needs ``parse_entry_map`` on whole documents.
    """
    parts = spark.read.option("lineSep", "]").text(path)
    body = F.regexp_replace("value", r"^\s*([}]\s*)?[{,]?\s*", "")
    ends = F.col("value").rlike(r"^\s*([{]?\s*[}]\s*)*$")
    closed = F.max(ends & F.col("value").contains("}"))
    open_files = parts.groupBy(F.col("_metadata.file_path").alias("file")).agg(closed.alias("closed")).where("NOT closed")
    if cut_off := open_files.limit(3).collect():
        raise ValueError(f"malformed entry map, the object is not closed: {[r['file'] for r in cut_off]}")
    return parse_entry_map(parts.where(~ends).select(F.concat(F.lit("{"), body, F.lit("]}")).alias("value")), key, value)


def parse_entry_map(docs: DataFrame, key: str = "entry", value: str = "id") -> DataFrame:
    """A6 on JSON objects (column ``value``); a malformed one raises."""
    m = F.from_json(F.col("value"), T.MapType(T.StringType(), T.ArrayType(T.StringType())), {"mode": "FAILFAST"})
    return docs.select(F.explode(m).alias(key, "_ids")).select(key, F.explode("_ids").alias(value))


def read_blast_tab(spark: SparkSession, path: str, sep: str = ",", header: bool = False) -> DataFrame:
    """12-column tabular hits, typed; '#' rows, blank rows and trailers (other than 12 fields) skipped."""
    return parse_blast_tab(spark.read.text(path), sep, header)


def parse_blast_tab(lines: DataFrame, sep: str = ",", header: bool = False) -> DataFrame:
    """A7 on text lines (column ``value``); a header is the row whose last field is no number."""
    fields = lines.where(~F.col("value").startswith("#")).select(
        F.transform(F.split("value", "\\Q" + sep + "\\E"), lambda x: F.trim(x)).alias("f")).where(F.size("f") == len(BLAST_TAB_COLUMNS))
    if header:
        fields = fields.where(F.get("f", F.lit(len(BLAST_TAB_COLUMNS) - 1)).try_cast("double").isNotNull())
    return fields.select(*[F.get("f", F.lit(i)).try_cast(t).alias(c)
                           for i, (c, t) in enumerate(zip(BLAST_TAB_COLUMNS, BLAST_TAB_TYPES))])


def read_domtblout(spark: SparkSession, path: str, raw: bool = False) -> DataFrame:
    """Whitespace-separated domain table; first field 'db|name|gene';
    the description is every word from the 25th column on."""
    return parse_domtblout(spark.read.text(path), raw)


def parse_domtblout(lines: DataFrame, raw: bool = False) -> DataFrame:
    """A8 on text lines (column ``value``)."""
    lines = lines.where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    tok = F.split(F.trim(F.col("value")), r"\s+")
    head = F.split(F.get(tok, F.lit(0)), r"\|")
    fields = F.concat(head, F.slice(tok, 2, F.size(tok)))
    cols = [F.get(fields, F.lit(i)).alias(c) for i, c in enumerate(DOMTBL_COLUMNS[:-1])]
    desc = F.array_join(F.slice(fields, F.lit(len(DOMTBL_COLUMNS)), F.size(fields)), " ").alias("description")
    df = lines.select(*cols, desc)
    if raw:
        return df
    return df.select(F.col("target_name").alias("entry_ac"), F.col("align_from").alias("seq_start"),
                     F.col("align_to").alias("seq_end"), F.col("dom_i_evalue").alias("e_value"))


_ALIGNMENT = ("score:string,bits:string,expectation:string,identity:string,positives:string,gaps:string,strand:string,"
              "pattern:string,matchSeq:struct<_VALUE:string,_start:string,_end:string>")
HIT_XML = ("_database string, _id string, _ac string, _description string, "
           f"alignments struct<alignment:array<struct<{_ALIGNMENT}>>>")


def read_blast_xml(spark: SparkSession, path: str) -> DataFrame:
    """Search-result XML, one row per (hit, alignment) with 15 columns."""
    return _hit_rows(spark.read.format("xml").option("rowTag", "hit").schema(HIT_XML).load(path))


def parse_blast_xml(hits: DataFrame) -> DataFrame:
    """A9 on hit elements (column ``value``)."""
    return _hit_rows(hits.select(F.from_xml("value", HIT_XML, {"mode": "FAILFAST"}).alias("h")).select("h.*"))


def _hit_rows(hits: DataFrame) -> DataFrame:
    rows = hits.select(F.col("_database").alias("database"), F.col("_id").alias("id"),
                       F.col("_ac").alias("ac"), F.col("_description").alias("description"),
                       F.explode("alignments.alignment").alias("a"))
    return rows.select(
        F.col("a.score").try_cast("int").alias("score"), F.col("a.bits").try_cast("double").alias("bits"),
        F.col("a.expectation").try_cast("double").alias("expectation"),
        F.col("a.identity").try_cast("double").alias("identity"),
        F.col("a.positives").try_cast("double").alias("positives"),
        F.col("a.gaps").try_cast("int").alias("gaps"), F.col("a.strand").alias("strand"),
        F.col("a.pattern").alias("pattern_seq"), F.col("a.matchSeq._VALUE").alias("match_seq"),
        F.col("a.matchSeq._start").try_cast("int").alias("match_start"),
        F.col("a.matchSeq._end").try_cast("int").alias("match_end"),
        "database", "id", "ac", "description")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """A10: FASTA records -> (id, descr, seq); sequence lines are concatenated."""
    return parse_fasta(spark.read.option("lineSep", "\n>").text(path))


def parse_fasta(records: DataFrame) -> DataFrame:
    """A10 on records (column ``value``), with or without their '>'."""
    rec = records.select(F.regexp_replace("value", r"^>", "").alias("r")).where(F.trim("r") != "")
    header = F.substring_index(F.col("r"), "\n", 1)
    body = F.when(F.instr(F.col("r"), "\n") > 0, F.expr("substring(r, instr(r, '\n') + 1)")).otherwise(F.lit(""))
    return rec.select(F.regexp_extract(header, r"^(\S+)", 1).alias("id"),
                      F.trim(F.regexp_replace(header, r"^\S+", "")).alias("descr"),
                      F.regexp_replace(body, r"\s+", "").alias("seq"))


def read_alignment_reports(spark: SparkSession, path: str) -> DataFrame:
    """Structure-alignment text reports (one per file) -> one row each:
    name/len/TM-score per chain, normalised TM-score (3rd), aligned length,
    RMSD and sequence identity."""
    return parse_alignment_reports(spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file_name")))


def parse_alignment_reports(reports: DataFrame) -> DataFrame:
    """A11 on reports (columns ``value`` and ``file_name``); the patterns are fixed by the file format."""
    doc = reports.select(F.col("value").alias("t"), "file_name")
    tms = F.regexp_extract_all("t", F.lit(r"TM-score= ([\d.]+)"), 1)
    return doc.select(
        "file_name",
        F.trim(F.regexp_extract("t", r"Name of Chain_1:(.+?)\n", 1)).alias("name_1"),
        F.regexp_extract("t", r"Length of Chain_1: (\d+)", 1).try_cast("int").alias("len_1"),
        F.trim(F.regexp_extract("t", r"Name of Chain_2:(.+?)\n", 1)).alias("name_2"),
        F.regexp_extract("t", r"Length of Chain_2: (\d+)", 1).try_cast("int").alias("len_2"),
        F.get(tms, F.lit(0)).try_cast("double").alias("tm_1"),
        F.get(tms, F.lit(1)).try_cast("double").alias("tm_2"),
        F.get(tms, F.lit(2)).try_cast("double").alias("tm_score"),
        F.regexp_extract("t", r"Aligned length=\s+(\d+)", 1).try_cast("int").alias("align_len"),
        F.regexp_extract("t", r"RMSD=\s+([\d.]+)", 1).try_cast("double").alias("rmsd"),
        F.regexp_extract("t", r"Seq_ID=n_identical/n_aligned=\s+([\d.]+)", 1).try_cast("double").alias("seq_id"),
    )
