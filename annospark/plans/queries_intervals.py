"""Registered queries: interval ensemble (E), evaluation (I), matrices (K).

The oracle SQL for the ensemble is a brute-force formulation: the full
Jaccard-distance matrix per entry, row distances over all hits, components
by recursive reachability and votes over exploded positions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from annospark.operators import evaluation as ev
from annospark.operators import intervals as iv
from annospark.operators import matrix as mx
from annospark.operators import reshape as rs
from annospark.plans import bindings as V
from annospark.plans.catalog import register

ROUND6 = 6


def _r(df, cols, places=ROUND6):
    for c in cols:
        df = df.withColumn(c, F.round(F.col(c), places))
    return df


def _rs(cols, places=ROUND6):
    return ", ".join(f"round({c}, {places}) AS {c}" for c in cols)


# ------------------------------------------------------------------ E
_ENS_BASE = f"""
hits AS ({V.SQL_INT_HITS}),
h AS (SELECT entry, seq_start AS s, seq_end AS e,
             row_number() OVER (PARTITION BY entry ORDER BY model, seq_start, seq_end) AS id
      FROM hits WHERE seq_end > seq_start),
pd AS (SELECT a.entry, a.id AS i, b.id AS j,
              1 - greatest(0, least(a.e, b.e) - greatest(a.s, b.s))::DOUBLE
                  / ((a.e - a.s) + (b.e - b.s) - greatest(0, least(a.e, b.e) - greatest(a.s, b.s))) AS d
       FROM h a JOIN h b USING (entry))"""


def _ens_sql(metric: str) -> str:
    if metric == "rows":
        edges = """
rd AS (SELECT p1.entry, p1.i, p2.i AS j, sum((p1.d - p2.d) * (p1.d - p2.d)) AS d2
       FROM pd p1 JOIN pd p2 ON p1.entry = p2.entry AND p1.j = p2.j AND p1.i <> p2.i GROUP BY ALL),
ed AS (SELECT entry, i, j FROM rd WHERE d2 <= 0.16 + 1e-12)"""
    else:
        edges = """
ed AS (SELECT entry, i, j FROM pd WHERE i <> j AND d <= 0.4 + 1e-12)"""
    return f"""WITH RECURSIVE {_ENS_BASE.strip()},{edges},
reach AS (
  SELECT entry, id AS src, id AS dst FROM h
  UNION
  SELECT r.entry, r.src, ed.j FROM reach r JOIN ed ON r.entry = ed.entry AND r.dst = ed.i
),
lab AS (SELECT entry, src AS id, min(dst) AS cl FROM reach GROUP BY entry, src),
hl AS (SELECT h.*, lab.cl FROM h JOIN lab USING (entry, id)),
n AS (SELECT entry, cl, count(*) AS n FROM hl GROUP BY entry, cl),
votes AS (SELECT entry, cl, pos, count(*) AS v FROM (SELECT entry, cl, unnest(range(s, e)) AS pos FROM hl) GROUP BY ALL),
kept AS (SELECT votes.* FROM votes JOIN n USING (entry, cl) WHERE 2 * v >= n)
SELECT entry, min(pos)::INTEGER AS seq_start, max(pos)::INTEGER AS seq_end FROM kept GROUP BY entry, cl"""


def _models(hits) -> list[str]:
    """Names of the models in a hit table (one a prediction method)."""
    return [r["model"] for r in hits.select("model").distinct().orderBy("model").collect()]


@register("ensemble", _ens_sql("rows"))
def q_ensemble(spark, sf_dir):
    hits = V.int_hits(spark, sf_dir)
    models = [hits.where(F.col("model") == m).select("entry", "seq_start", "seq_end") for m in _models(hits)]
    return iv.ensemble(models, 0.4, "rows")


@register("ensemble_precomputed", _ens_sql("precomputed"))
def q_ensemble_precomputed(spark, sf_dir):
    hits = V.int_hits(spark, sf_dir)
    models = [hits.where(F.col("model") == m).select("entry", "seq_start", "seq_end") for m in _models(hits)]
    return iv.ensemble(models, 0.4, "precomputed")


@register("jaccard_pairs", f"WITH hits AS ({V.SQL_INT_HITS}), nodes AS (SELECT entry, seq_start AS s, seq_end AS e, count(*) AS w "
          "FROM hits WHERE seq_end > seq_start GROUP BY ALL) "
          "SELECT a.entry, a.s AS s1, a.e AS e1, b.s AS s2, b.e AS e2, "
          "round(1 - (least(a.e, b.e) - greatest(a.s, b.s))::DOUBLE / ((a.e - a.s) + (b.e - b.s) - (least(a.e, b.e) - greatest(a.s, b.s))), 6) AS dist "
          "FROM nodes a JOIN nodes b ON a.entry = b.entry AND least(a.e, b.e) > greatest(a.s, b.s) "
          "AND (a.s <> b.s OR a.e <> b.e)")
def q_jaccard_pairs(spark, sf_dir):
    nodes = iv.collapse_hits(V.int_hits(spark, sf_dir))
    jp = iv.jaccard_pairs(nodes).where((F.col("s1") != F.col("s2")) | (F.col("e1") != F.col("e2")))
    return _r(jp.select("entry", "s1", "e1", "s2", "e2", "dist"), ["dist"])


# ------------------------------------------------------------------ I
@register("confusion", "SELECT "
          "sum(CASE WHEN p AND pp THEN 1 ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN u AND NOT p AND pp THEN 1 ELSE 0 END)::BIGINT AS fp, "
          "sum(CASE WHEN u AND NOT p AND u AND NOT pp THEN 1 ELSE 0 END)::BIGINT AS tn, "
          "sum(CASE WHEN p AND u AND NOT pp THEN 1 ELSE 0 END)::BIGINT AS fn FROM ("
          "SELECT k, bool_or(u) AS u, bool_or(p) AS p, bool_or(pp) AS pp FROM ("
          "SELECT doc_id AS k, TRUE AS u, FALSE AS p, FALSE AS pp FROM labels UNION ALL "
          "SELECT doc_id, FALSE, TRUE, FALSE FROM labels WHERE quality = 1 UNION ALL "
          "SELECT doc_id, FALSE, FALSE, TRUE FROM documents WHERE n_chars >= 2000) GROUP BY k)")
def q_confusion(spark, sf_dir):
    return ev.confusion(V.doc_universe(spark, sf_dir), V.doc_truth(spark, sf_dir), V.doc_pred(spark, sf_dir), "doc_id")


_MET = ["precision", "recall", "accuracy", "weighted_accuracy"]
_MET_SQL = ("tp::DOUBLE / nullif(tp + fp, 0) AS precision, tp::DOUBLE / nullif(tp + fn, 0) AS recall, "
            "(tp + tn)::DOUBLE / nullif(tp + fp + tn + fn, 0) AS accuracy, "
            "(tp::DOUBLE / nullif(tp + fn, 0) + tn::DOUBLE / nullif(tn + fp, 0)) / 2 AS weighted_accuracy")


@register("metrics", f"SELECT tp, fp, tn, fn, {_rs(_MET)} FROM (SELECT *, {_MET_SQL} FROM (SELECT "
          "(SELECT count(*) FROM labels WHERE quality = 1 AND doc_id IN (SELECT doc_id FROM documents WHERE n_chars >= 2000)) AS tp, "
          "(SELECT count(*) FROM labels WHERE quality <> 1 AND doc_id IN (SELECT doc_id FROM documents WHERE n_chars >= 2000)) AS fp, "
          "(SELECT count(*) FROM labels WHERE quality <> 1 AND doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars >= 2000)) AS tn, "
          "(SELECT count(*) FROM labels WHERE quality = 1 AND doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars >= 2000)) AS fn))")
def q_metrics(spark, sf_dir):
    conf = ev.confusion(V.doc_universe(spark, sf_dir), V.doc_truth(spark, sf_dir), V.doc_pred(spark, sf_dir), "doc_id")
    return _r(ev.metrics(conf), _MET)


#: Model of the documents without a label: no prediction inside the labelled universe.
_OUTSIDE = "outside"
_PREDS_SQL = f"SELECT '{_OUTSIDE}' AS model, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL " + " UNION ALL ".join(f"SELECT 'len>={c}' AS model, doc_id FROM documents WHERE n_chars >= {c}" for c in V.DOC_CUTOFFS)


@register("compare_models", f"WITH pr AS ({_PREDS_SQL}), lab AS (SELECT DISTINCT doc_id, quality = 1 AS pos FROM labels), "
          "c AS (SELECT model, count(*) FILTER (WHERE pos)::BIGINT AS tp, count(*) FILTER (WHERE NOT pos)::BIGINT AS fp "
          "FROM (SELECT DISTINCT model, doc_id FROM pr) LEFT JOIN lab USING (doc_id) GROUP BY model), "
          "tot AS (SELECT count(*) FILTER (WHERE pos) AS np, count(*) FILTER (WHERE NOT pos) AS nn FROM lab) "
          f"SELECT model, tp, fp, (nn - fp)::BIGINT AS tn, (np - tp)::BIGINT AS fn, {_rs(_MET)} FROM "
          f"(SELECT model, tp, fp, nn, np, tp::DOUBLE / nullif(tp + fp, 0) AS precision, tp::DOUBLE / nullif(np, 0) AS recall, "
          "(tp + nn - fp)::DOUBLE / nullif(np + nn, 0) AS accuracy, "
          "(tp::DOUBLE / nullif(np, 0) + (nn - fp)::DOUBLE / nullif(nn, 0)) / 2 AS weighted_accuracy FROM c, tot)")
def q_compare_models(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents")
    labs = V.table(spark, sf_dir, "labels")
    preds = docs.join(labs, "doc_id", "left_anti").select(F.lit(_OUTSIDE).alias("model"), "doc_id")
    for c in V.DOC_CUTOFFS:
        preds = preds.unionByName(docs.where(F.col("n_chars") >= c).select(F.lit(f"len>={c}").alias("model"), "doc_id"))
    truth = labs.where(F.col("quality") == 1).select("doc_id")
    return _r(ev.compare_models(labs.select("doc_id"), truth, preds, "doc_id"), _MET)


_TRUTH_POS = f"""
tr AS ({V.SQL_INT_TRUTH}),
ents AS ({V.SQL_INT_ENTRIES}),
tpos AS (SELECT DISTINCT entry, unnest(range(seq_start, seq_end)) AS pos FROM tr),
uni AS (SELECT entry, unnest(range(1, len)) AS pos FROM ents),
tflags AS (SELECT entry, pos, max(p) AS is_pos FROM (SELECT entry, pos, 0 AS p FROM uni UNION ALL SELECT entry, pos, 1 FROM tpos) GROUP BY ALL)"""


@register("truth_summary", f"WITH {_TRUTH_POS.strip()} SELECT e.entry, coalesce(n_positive, 0)::BIGINT AS n_positive, "
          "coalesce(n_negative, 0)::BIGINT AS n_negative, coalesce(n_positive, 0) > 0 AS match FROM ents e LEFT JOIN "
          "(SELECT entry, sum(is_pos) AS n_positive, sum(1 - is_pos) AS n_negative FROM tflags GROUP BY entry) USING (entry)")
def q_truth_summary(spark, sf_dir):
    tr = V.int_truth(spark, sf_dir)
    matches = tr.groupBy("entry").agg(F.concat_ws(",", F.collect_list(
        F.concat(F.col("seq_start").cast("string"), F.lit(".."), F.col("seq_end").cast("string")))).alias("matches"))
    return ev.truth_summary(V.int_entries(spark, sf_dir), matches)


@register("position_confusion", f"""WITH {_TRUTH_POS.strip()},
hits AS ({V.SQL_INT_HITS}),
pp AS (SELECT DISTINCT model, entry, unnest(range(seq_start, seq_end)) AS pos FROM hits WHERE seq_end > seq_start),
ents_m AS (SELECT DISTINCT model, entry FROM hits),
fl AS (SELECT model, entry, pos, max(u) AS u, max(p) AS p, max(x) AS x FROM (
  SELECT model, entry, pos, 1 AS u, is_pos AS p, 0 AS x FROM ents_m JOIN tflags USING (entry)
  UNION ALL SELECT model, entry, pos, 0, 0, 1 FROM pp) GROUP BY ALL),
c AS (SELECT model, entry,
  sum(CASE WHEN p = 1 AND x = 1 THEN 1 ELSE 0 END)::BIGINT AS tp,
  sum(CASE WHEN u = 1 AND p = 0 AND x = 1 THEN 1 ELSE 0 END)::BIGINT AS fp,
  sum(CASE WHEN u = 1 AND p = 0 AND x = 0 THEN 1 ELSE 0 END)::BIGINT AS tn,
  sum(CASE WHEN p = 1 AND u = 1 AND x = 0 THEN 1 ELSE 0 END)::BIGINT AS fn FROM fl GROUP BY model, entry)
SELECT model, entry, tp, fp, tn, fn, {_rs(_MET)} FROM (SELECT *, {_MET_SQL} FROM c)""")
def q_position_confusion(spark, sf_dir):
    return _r(_pos_conf(spark, sf_dir), _MET)


def _pos_conf(spark, sf_dir):
    tr = V.int_truth(spark, sf_dir)
    matches = tr.groupBy("entry").agg(F.concat_ws(",", F.collect_list(
        F.concat(F.col("seq_start").cast("string"), F.lit(".."), F.col("seq_end").cast("string")))).alias("matches"))
    entries = V.int_entries(spark, sf_dir)
    truth = ev.truth_intervals(entries, matches)
    return ev.position_confusion_intervals(V.int_hits(spark, sf_dir), truth, entries, "entry", "len", ["model"])


@register("metric_distribution", f"""WITH {_TRUTH_POS.strip()},
hits AS ({V.SQL_INT_HITS}),
pp AS (SELECT DISTINCT model, entry, unnest(range(seq_start, seq_end)) AS pos FROM hits WHERE seq_end > seq_start),
ents_m AS (SELECT DISTINCT model, entry FROM hits),
fl AS (SELECT model, entry, pos, max(u) AS u, max(p) AS p, max(x) AS x FROM (
  SELECT model, entry, pos, 1 AS u, is_pos AS p, 0 AS x FROM ents_m JOIN tflags USING (entry)
  UNION ALL SELECT model, entry, pos, 0, 0, 1 FROM pp) GROUP BY ALL),
c AS (SELECT model, entry,
  sum(CASE WHEN p = 1 AND x = 1 THEN 1 ELSE 0 END) AS tp,
  sum(CASE WHEN u = 1 AND p = 0 AND x = 1 THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN u = 1 AND p = 0 AND x = 0 THEN 1 ELSE 0 END) AS tn,
  sum(CASE WHEN p = 1 AND u = 1 AND x = 0 THEN 1 ELSE 0 END) AS fn FROM fl GROUP BY model, entry),
m AS (SELECT model, {_MET_SQL} FROM c),
l AS (SELECT model, 'precision' AS metric, precision AS value FROM m UNION ALL
      SELECT model, 'recall', recall FROM m UNION ALL SELECT model, 'accuracy', accuracy FROM m UNION ALL
      SELECT model, 'weighted_accuracy', weighted_accuracy FROM m)
SELECT model, metric, {_rs(['min', 'q1', 'median', 'q3', 'max', 'mean'])}, n FROM (
  SELECT model, metric, min(value) AS min, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
         quantile_cont(value, 0.75) AS q3, max(value) AS max, avg(value) AS mean, count(*) AS n
  FROM l WHERE value IS NOT NULL GROUP BY model, metric)""")
def q_metric_distribution(spark, sf_dir):
    d = ev.metric_distribution(_pos_conf(spark, sf_dir), _MET, ["model"])
    return _r(d, ["min", "q1", "median", "q3", "max", "mean"])


_STRUCT_DEDUP = f"SELECT entry, s_start, s_end, min(struct_id) AS struct_id FROM ({V.SQL_INT_STRUCT}) GROUP BY entry, s_start, s_end"
_DOMS = f"SELECT DISTINCT model, entry, seq_start, seq_end FROM ({V.SQL_INT_HITS})"
_COV = f"""
st AS ({_STRUCT_DEDUP}),
dm AS ({_DOMS}),
pr AS (SELECT model, dm.entry, dm.seq_start, dm.seq_end, st.struct_id, st.s_start, st.s_end, 121 AS len FROM dm JOIN st USING (entry)),
ps AS (SELECT pr.*, (SELECT count(*) FROM range(seq_start, seq_end) d(x) WHERE x >= s_start AND x < s_end) AS tp,
              (SELECT count(*) FROM range(s_start, s_end) t(x) WHERE x < seq_start OR x >= seq_end) AS fp,
              (SELECT count(*) FROM range(seq_start, seq_end) d(x) WHERE x >= 1 AND x < len AND (x < s_start OR x >= s_end)) AS fn
       FROM pr),
cov AS (SELECT model, entry, seq_start, seq_end, struct_id, tp::DOUBLE / nullif(tp + fp, 0) AS precision,
               tp::DOUBLE / nullif(tp + fn, 0) AS recall FROM ps)"""


@register("first_per_group", _STRUCT_DEDUP)
def q_first_per_group(spark, sf_dir):
    return ev.first_per_group(V.int_struct(spark, sf_dir), ["entry", "s_start", "s_end"], "struct_id")


def _coverage(spark, sf_dir, coverage=ev.structure_coverage):
    st = ev.first_per_group(V.int_struct(spark, sf_dir), ["entry", "s_start", "s_end"], "struct_id")
    dm = V.int_hits(spark, sf_dir).select("model", "entry", "seq_start", "seq_end").distinct()
    return coverage(dm, st, V.int_entries(spark, sf_dir))


@register("structure_coverage", f"WITH {_COV.strip()} SELECT model, entry, seq_start, seq_end, struct_id, {_rs(['precision', 'recall', 'f1'])} "
          "FROM (SELECT *, 2 * precision * recall / nullif(precision + recall, 0) AS f1 FROM cov)")
def q_structure_coverage(spark, sf_dir):
    return _r(_coverage(spark, sf_dir), ["precision", "recall", "f1"])


@register("covering_structures", f"WITH {_COV.strip()} SELECT model, count(*) AS n_rows, count(DISTINCT entry) AS n_entries, "
          "count(DISTINCT struct_id) AS n_structures FROM cov WHERE recall IS NOT NULL AND recall >= 0.8 GROUP BY model")
def q_covering_structures(spark, sf_dir):
    return ev.covering_structures(_coverage(spark, sf_dir, ev.overlapping_coverage), 0.8, group=["model"])


@register("overlapping_coverage", f"WITH {_COV.strip()} SELECT model, entry, seq_start, seq_end, struct_id, {_rs(['precision', 'recall', 'f1'])} "
          "FROM (SELECT *, 2 * precision * recall / nullif(precision + recall, 0) AS f1 FROM cov) WHERE recall > 0")
def q_overlapping_coverage(spark, sf_dir):
    return _r(_coverage(spark, sf_dir, ev.overlapping_coverage), ["precision", "recall", "f1"])


@register("interval_join", f"WITH hits AS ({V.SQL_INT_HITS}), st AS ({V.SQL_INT_STRUCT}) "
          "SELECT entry, model, seq_start, seq_end, struct_id, s_start, s_end, "
          "least(seq_end, s_end) - greatest(seq_start, s_start) AS inter FROM hits JOIN st USING (entry) "
          "WHERE least(seq_end, s_end) > greatest(seq_start, s_start)")
def q_interval_join(spark, sf_dir):
    # buckets narrower than the entries, so that pairs meet in several of them
    pairs = iv.interval_join(V.int_hits(spark, sf_dir), V.int_struct(spark, sf_dir), bucket=32)
    return pairs.select("entry", "model", "seq_start", "seq_end", "struct_id", "s_start", "s_end", "inter")


# ------------------------------------------------------------------ D: positions
_HIT_POS = f"SELECT entry, model, unnest(range(seq_start, seq_end))::INTEGER AS pos FROM ({V.SQL_INT_HITS}) WHERE seq_end > seq_start"


@register("position_depth", f"SELECT model, pos, count(*) AS n FROM ({_HIT_POS}) GROUP BY model, pos")
def q_position_depth(spark, sf_dir):
    """How many hits of a model hold each position."""
    return rs.to_positions(V.int_hits(spark, sf_dir)).groupBy("model", "pos").agg(F.count(F.lit(1)).alias("n"))


@register("positions_to_range", f"SELECT entry, model, min(pos) AS seq_start, max(pos) AS seq_end FROM ({_HIT_POS}) GROUP BY entry, model")
def q_positions_to_range(spark, sf_dir):
    """First and last position that the hits of a model hold in an entry."""
    return rs.positions_to_range(rs.to_positions(V.int_hits(spark, sf_dir)), ["entry", "model"])


@register("negative_positions", f"WITH {_TRUTH_POS.strip()} SELECT e.entry, coalesce(n.negatives, '') AS negatives, "
          "e.entry IN (SELECT entry FROM tr) AS match FROM ents e LEFT JOIN (SELECT entry, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS negatives "
          "FROM tflags WHERE is_pos = 0 GROUP BY entry) n USING (entry)")
def q_negative_positions(spark, sf_dir):
    """Positions of an entry outside its positive ranges, and whether it has any such range."""
    tr = V.int_truth(spark, sf_dir)
    listed = F.concat(F.col("seq_start").cast("string"), F.lit(".."), F.col("seq_end").cast("string"))
    matches = tr.groupBy("entry").agg(F.concat_ws(",", F.collect_list(listed)).alias("matches"))
    ranges = rs.parse_ranges(F.col("matches"))
    # an entry's ranges lie inside its sequence, so its positions are bounded by the sequence length
    positives = F.array_distinct(F.flatten(F.transform(F.filter(ranges, lambda r: r["end"] > r["start"]),
                                                       lambda r: F.sequence(r["start"], r["end"] - 1))))
    negatives = rs.complement_positions(F.col("len"), positives)
    return (V.int_entries(spark, sf_dir).join(matches, "entry", "left")
            .select("entry", F.array_join(negatives.cast("array<string>"), ",").alias("negatives"),
                    rs.match_flag(ranges).alias("match")))


@register("set_union_positions", f"SELECT entry, count(*) AS n_positions, min(pos)::INTEGER AS min_pos, max(pos)::INTEGER AS max_pos FROM "
          f"(SELECT DISTINCT entry, unnest(range(seq_start, seq_end)) AS pos FROM ({V.SQL_INT_HITS}) WHERE seq_end > seq_start) "
          "GROUP BY entry")
def q_set_union_positions(spark, sf_dir):
    return ev.set_union_summary(V.int_hits(spark, sf_dir))


# ------------------------------------------------------------------ K
_DIST_SQL = ("sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), "
             "lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))))")


@register("distance_matrix", f"SELECT a.label, a.vec_id AS i, b.vec_id AS j, round(CASE WHEN a.vec_id = b.vec_id THEN 0 ELSE "
          f"{_DIST_SQL} END, 6) AS d FROM embeddings a JOIN embeddings b ON a.label = b.label")
def q_distance_matrix(spark, sf_dir):
    e = V.table(spark, sf_dir, "embeddings").select("label", "vec_id",
                                                    F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return _r(mx.distance_matrix(e, "label", "vec_id", "v"), ["d"])


@register("near_pairs", f"SELECT a.label, a.vec_id AS i, b.vec_id AS j, round({_DIST_SQL}, 6) AS d FROM embeddings a JOIN embeddings b "
          f"ON a.label = b.label AND a.vec_id < b.vec_id WHERE {_DIST_SQL} <= 1.25")
def q_near_pairs(spark, sf_dir):
    """K1 with a bound: the pairs of a label within a distance."""
    e = V.table(spark, sf_dir, "embeddings").select("label", "vec_id",
                                                    F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return _r(mx.near_pairs(e, "label", "vec_id", "v", 1.25), ["d"])


_TILE = 4


@register("centroid_matrix", "WITH c AS (SELECT label, list(v ORDER BY k) AS v FROM (SELECT label, k, avg(x::DOUBLE) AS v FROM "
          "(SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS k FROM embeddings) GROUP BY label, k) "
          "GROUP BY label), p AS (SELECT *, row_number() OVER (ORDER BY label) - 1 AS place FROM c), "
          "cells AS (SELECT r.place // 4 AS tile_row, q.place // 4 AS tile_col, (r.place % 4) * 4 + q.place % 4 AS cell, "
          "CASE WHEN r.label = q.label THEN 0 ELSE sqrt(list_sum(list_transform(list_zip(r.v, q.v), "
          "lambda p: (p[1] - p[2]) * (p[1] - p[2])))) END AS d FROM p r JOIN p q ON TRUE), "
          "tiles AS (SELECT DISTINCT tile_row, tile_col FROM cells) "
          "SELECT t.tile_row::BIGINT AS tile_row, t.tile_col::BIGINT AS tile_col, x.cell::INTEGER AS cell, round(c.d, 6) AS d "
          "FROM tiles t JOIN range(16) x(cell) ON TRUE LEFT JOIN cells c ON c.tile_row = t.tile_row AND c.tile_col = t.tile_col "
          "AND c.cell = x.cell")
def q_centroid_matrix(spark, sf_dir):
    """K2: the matrix of the distances between label centroids as dense tiles, each cell of a tile a row."""
    e = V.table(spark, sf_dir, "embeddings")
    dims = e.select("label", F.posexplode("embedding").alias("k", "x"))
    cent = (dims.groupBy("label", "k").agg(F.avg(F.col("x").cast("double")).alias("x"))
            .groupBy("label").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("kv"))
            .select("label", F.transform("kv", lambda s: s["x"]).alias("v")))
    long = mx.distance_matrix(cent.withColumn("g", F.lit(0)), "g", "label", "v", block=4)
    tiles = mx.matrix_tiles(long.select("i", "j", "d"), _TILE)
    return _r(tiles.select("tile_row", "tile_col", F.posexplode("cells").alias("cell", "d")), ["d"])


# ------------------------------------------------------------------ I3 on the interval models + ensemble
_ENS_CTE = _ens_sql("rows").replace("WITH RECURSIVE ", "", 1)
_ENS_BODY, _ENS_SELECT = _ENS_CTE.rsplit("\nSELECT entry, min(pos)", 1)


@register("compare_domain_models", f"""WITH RECURSIVE {_ENS_BODY},
ens AS (SELECT entry, min(pos)""" + _ENS_SELECT + f"""),
pr AS (SELECT DISTINCT model, entry FROM hits UNION ALL SELECT DISTINCT 'ensemble', entry FROM ens),
uni AS (SELECT o_orderkey AS entry FROM orders),
pos AS (SELECT DISTINCT entry FROM ({V.SQL_INT_TRUTH}) WHERE entry IN (SELECT entry FROM uni)),
c AS (SELECT model, count(*) FILTER (WHERE entry IN (SELECT entry FROM pos))::BIGINT AS tp,
             count(*) FILTER (WHERE entry NOT IN (SELECT entry FROM pos))::BIGINT AS fp
      FROM (SELECT DISTINCT model, entry FROM pr WHERE entry IN (SELECT entry FROM uni)) GROUP BY model),
tot AS (SELECT (SELECT count(*) FROM pos) AS np, (SELECT count(*) FROM uni) - (SELECT count(*) FROM pos) AS nn)
SELECT model, tp, fp, (nn - fp)::BIGINT AS tn, (np - tp)::BIGINT AS fn, {_rs(_MET)} FROM
(SELECT model, tp, fp, nn, np, tp::DOUBLE / nullif(tp + fp, 0) AS precision, tp::DOUBLE / nullif(np, 0) AS recall,
        (tp + nn - fp)::DOUBLE / nullif(np + nn, 0) AS accuracy,
        (tp::DOUBLE / nullif(np, 0) + (nn - fp)::DOUBLE / nullif(nn, 0)) / 2 AS weighted_accuracy FROM c, tot)""")
def q_compare_domain_models(spark, sf_dir):
    """Entity level: an entry is predicted positive by a model when it has a hit
    (for the ensemble: a voted range); truth = entries with a match."""
    hits = V.int_hits(spark, sf_dir)
    models = [hits.where(F.col("model") == m).select("entry", "seq_start", "seq_end") for m in _models(hits)]
    ens = iv.ensemble(models, 0.4, "rows").select(F.lit("ensemble").alias("model"), "entry")
    preds = hits.select("model", "entry").unionByName(ens)
    universe = V.int_entries(spark, sf_dir).select("entry")
    truth = V.int_truth(spark, sf_dir).select("entry")
    return _r(ev.compare_models(universe, truth, preds, "entry"), _MET)
