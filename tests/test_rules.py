"""Rules that single rows decide: bracketed items, models without hits, trailers, extreme counts."""

from __future__ import annotations

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from annospark.operators import enrichment as enr
from annospark.operators import evaluation as ev
from annospark.operators import intervals as iv
from annospark.plans import catalog


def test_bracketed_items_keep_their_descriptions(spark):
    from annospark.operators import reshape as rs
    df = spark.createDataFrame([("a", "kinase; type II [GO:0000001]; binding [GO:0000002]"), ("b", "nothing"), ("c", None)],
                               "entry string, go string")
    rows = {tuple(r) for r in rs.extract_bracketed(df, "go").collect()}
    assert rows == {("a", "0000001", "kinase; type II"), ("a", "0000002", "binding")}


def test_model_without_hits_keeps_its_row(spark):
    from annospark.operators import evaluation as ev
    u = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    truth = u.where("k = 1")
    preds = spark.createDataFrame([("m1", 1), ("m1", 2), ("m2", 99)], "model string, k long")
    rows = {r["model"]: (r["tp"], r["fp"], r["tn"], r["fn"]) for r in ev.compare_models(u, truth, preds, "k").collect()}
    assert rows == {"m1": (1, 1, 1, 0), "m2": (0, 0, 2, 1)}


def test_tabular_hits_skip_the_trailer(spark):
    from annospark.sources import readers
    lines = ["# comment", "q,s,90.5,10,1,0,1,10,2,11,1e-5,50.2", "", "Search has CONVERGED!"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    rows = readers.parse_blast_tab(df).collect()
    assert len(rows) == 1 and rows[0][0] == "q" and math.isclose(rows[0][10], 1e-5)


def test_domain_table_keeps_long_descriptions(spark):
    from annospark.sources import readers
    words = [f"w{i}" for i in range(30)]
    line = "db|name|gene " + " ".join(str(i) for i in range(1, 40)) + " " + " ".join(words)
    row = readers.parse_domtblout(spark.createDataFrame([(line,)], "value string"), raw=True).collect()[0]
    assert row["description"].endswith(" ".join(words))


def test_fisher_at_large_counts_and_below_the_least_double(spark):
    from annospark.operators import enrichment as enr
    big = 5 * 10 ** 15  # the product of two margins is beyond a long
    df = spark.createDataFrame([("large", 1000, 1000, big - 1000, big - 1000),
                                ("tiny", 4000, 10, 10, 4000)], "term string, tp long, tn long, fp long, fn long")
    res = enr.fisher_columns(df).persist()
    rows = {r["term"]: r for r in res.collect()}
    assert math.isclose(rows["large"]["p_value"], 1.0, abs_tol=1e-6)
    assert rows["tiny"]["p_value"] == 0.0 and -1e5 < rows["tiny"]["log_p"] < -745
    scored = enr.enrich_filter(res.where("term = 'tiny'").withColumn("depth", F.lit(1))).collect()
    res.unpersist()
    assert math.isfinite(scored[0]["score"]) and scored[0]["score"] > 745


def test_closure_of_a_deep_chain(spark):
    from annospark.operators import ontology as onto
    edges = spark.range(300).select((F.col("id") + 1).alias("child"), F.col("id").alias("parent"))
    closure = onto.closure_with_distance(edges)
    assert closure.count() == 300 * 301 // 2
    assert closure.agg(F.max("dist")).first()[0] == 300


def test_lists_of_ancestors_stay_off_the_driver(spark, monkeypatch):
    from annospark.operators import ontology as onto
    own = spark.range(8).select((F.col("id") + 8).alias("child"), F.col("id").alias("parent"))
    known = spark.range(8).select(F.col("id").alias("parent"), F.array(F.col("id") + 100).alias("ancestors"), F.array(F.lit(1)).alias("dists"))
    met = onto._handed_down(own, known, "bigint")
    assert "BroadcastHashJoin" not in met._jdf.queryExecution().executedPlan().toString()
    assert sorted(met.collect()) == [(i + 8, [i, i + 100], [1, 2]) for i in range(8)]
    # what the ranges are dealt by is sampled into the driver
    keys, dealt = [], type(own).repartitionByRange
    monkeypatch.setattr(type(own), "repartitionByRange", lambda self, *by: keys.extend(self.select(*by).dtypes) or dealt(self, *by))
    lists = spark.range(200).select(F.col("id").alias("term"), F.sequence(F.lit(0), F.col("id")).alias("ancestors"))
    blocks = onto.blocked_lists(spark.range(150).select(F.col("id").alias("term")), lists)
    assert keys and not [k for k in keys if "array" in k[1]]
    assert sorted(r["term"] for r in blocks.collect()) == list(range(150))
    assert blocks.groupBy("block").count().agg(F.max("count")).first()[0] <= onto.BLOCK_TERMS


def test_fisher_counts_the_mirror_tail(spark):
    # symmetric tables 5 to 60 standard deviations off the mode: both tails weigh the same
    def log_pmf(k, n1, n2, r):
        lf = lambda n: math.lgamma(n + 1)
        return (lf(n1) - lf(k) - lf(n1 - k) + lf(n2) - lf(r - k) - lf(n2 - r + k)
                - lf(n1 + n2) + lf(r) + lf(n1 + n2 - r))
    tables = [(10000 + 50 * s, 10000 - 50 * s, 10000 - 50 * s, 10000 + 50 * s) for s in (5, 21, 30, 45, 60)]
    got = {r.tp: r.log_p for r in enr.fisher_columns(spark.createDataFrame(tables, "tp long, tn long, fp long, fn long")).collect()}
    for a, *_ in tables:
        logs = [log_pmf(k, 20000, 20000, 20000) for k in range(a, 20001)]
        expected = math.log(2) + logs[0] + math.log(sum(math.exp(x - logs[0]) for x in logs))
        assert got[a] == pytest.approx(expected, abs=1e-5)


def test_metric_distribution_matches_brute_force(spark):
    rnd = random.Random(3)
    rows = [(m, rnd.choice([None, 0.0, 1.0, rnd.random()])) for m in ("a", "b") for _ in range(400)] + [("c", 0.25), ("d", None)]
    df = spark.createDataFrame(rows, "model string, recall double")
    got = {r.model: r for r in ev.metric_distribution(df, ["recall"]).collect()}
    assert set(got) == {"a", "b", "c"}
    for model, r in got.items():
        values = [v for m, v in rows if m == model and v is not None]
        expected = [*np.quantile(values, [0, 0.25, 0.5, 0.75, 1]), np.mean(values)]
        assert [r["min"], r.q1, r.median, r.q3, r["max"], r["mean"]] == pytest.approx(expected)
        assert r.n == len(values)


def test_no_cache_is_left_behind(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("driver tables not present")
    spark.catalog.clearCache()
    for name in ("enrich_gate", "enrich_by_architecture", "ensemble", "term_weights"):
        catalog.REGISTRY[name][0](spark, sf).count()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def test_interval_join_in_many_buckets(spark):
    rnd = random.Random(5)
    dom = [(rnd.randint(1, 2), s, s + rnd.randint(0, 90)) for s in (rnd.randint(0, 300) for _ in range(60))]
    struct = [(rnd.randint(1, 2), i, s, s + rnd.randint(0, 90)) for i, s in enumerate(rnd.randint(0, 300) for _ in range(60))]
    got = iv.interval_join(spark.createDataFrame(dom, "entry int, seq_start int, seq_end int"),
                           spark.createDataFrame(struct, "entry int, struct_id int, s_start int, s_end int"), bucket=16)
    got = sorted((r.entry, r.seq_start, r.seq_end, r.struct_id, r.inter) for r in got.collect())
    assert got == sorted((e, a, b, i, min(b, d) - max(a, c)) for e, a, b in dom for f, i, c, d in struct
                         if e == f and min(b, d) > max(a, c))


def test_fisher_at_counts_of_ten_to_the_twelfth(spark):
    # margins of 10^12: one cell off the mode, a few standard deviations off, and far off
    from annospark.functions import stats
    def spread(margin):   # of the hypergeometric with two such margins out of twice as many
        return math.sqrt(margin / 8)
    tables = [(margin // 2, int(z * spread(margin)), z) for margin, z in ((10 ** 9, 1.0), (10 ** 10, 4.0), (10 ** 12, 30.0))]
    frame = spark.createDataFrame([(h + x, h - x, h - x, h + x) for h, x, _ in tables], "tp long, tn long, fp long, fn long")
    got = {r.tp: r for r in enr.fisher_columns(frame).collect()}
    for h, off, z in tables:
        # the normal limit with half a cell of continuity holds to 1e-5 at this size
        x = (off - 0.5) / spread(2 * h)
        tail = (math.log(math.erfc(x / math.sqrt(2))) if z < 20 else
                -x * x / 2 - math.log(x * math.sqrt(math.pi / 2)) + math.log1p(-1 / x ** 2 + 3 / x ** 4))
        assert got[h + off].log_p == pytest.approx(tail, rel=1e-5)
    half, sd = 5 * 10 ** 11, spread(10 ** 12)
    small = spark.createDataFrame([(10 ** 12, 3 * 10 ** 12, 10 ** 9, 0)], "tp long, tn long, fp long, fn long")
    assert math.isfinite(enr.fisher_columns(small).first().log_p)
    row = float(stats.log_hypergeometric(half, 2 * half, 2 * half, 2 * half))
    assert row == pytest.approx(-0.5 * math.log(2 * math.pi * sd * sd), abs=1e-8)


def test_fisher_chunks_do_not_depend_on_their_width(spark):
    rnd = random.Random(11)
    tables = [tuple(rnd.choice([0, 1, rnd.randint(0, 40), rnd.randint(0, 4000)]) for _ in range(4)) for _ in range(80)]
    frame = spark.createDataFrame(tables, "tp long, tn long, fp long, fn long")
    runs = [{(r.tp, r.tn, r.fp, r.fn): r.log_p for r in enr.fisher_columns(frame, chunk).collect()} for chunk in (1, 7, 256)]
    for t in runs[0]:
        assert runs[0][t] == pytest.approx(runs[2][t], abs=1e-9) and runs[1][t] == pytest.approx(runs[2][t], abs=1e-9)


@pytest.mark.parametrize("rows", [3, 40, 10_000])
def test_sweep_join_over_many_ranges(spark, rows):
    rnd = random.Random(rows)
    # one entry holds most intervals, some as long as the entry
    pick = lambda i: 1 if rnd.random() < 0.7 else rnd.randint(2, 5)
    dom = [(rnd.choice("RS"), pick(i), s, s + rnd.choice([0, 1, 9, 60, 400])) for i, s in enumerate(rnd.randint(0, 400) for _ in range(150))]
    struct = [(pick(i), f"x{i}", s, s + rnd.choice([0, 1, 9, 60, 400])) for i, s in enumerate(rnd.randint(0, 400) for _ in range(150))]
    d = spark.createDataFrame(dom, "model string, entry int, seq_start int, seq_end int")
    t = spark.createDataFrame(struct, "entry int, struct_id string, s_start int, s_end int")
    got = sorted((r.model, r.entry, r.struct_id, r.seq_start, r.seq_end, r.s_start, r.s_end, r.inter) for r in iv.sweep_join(d, t, rows=rows).collect())
    assert got == sorted((m, e, i, a, b, x, y, min(b, y) - max(a, x)) for m, e, a, b in dom for f, i, x, y in struct
                         if e == f and min(b, y) > max(a, x))


def test_chunks_of_a_hot_key(spark):
    from annospark.operators import setops as so
    rows = [("hot", i % 700) for i in range(3000)] + [("cold", 5), ("cold", 5), ("cold", None), (None, 1), (None, 2)]
    got = so.collect_chunks_per_key(spark.createDataFrame(rows, "k string, v int").repartition(5), "k", "v", 50).collect()
    lists = {}
    for r in sorted(got, key=lambda r: (str(r.k), r.chunk)):
        assert len(r["values"]) <= 50 and r.chunk == len(lists.get(r.k, [])) // 50
        lists.setdefault(r.k, []).extend(r["values"])
    assert lists == {"hot": list(range(700)), "cold": [5], None: [1, 2]}


@pytest.mark.parametrize("tile", [1, 3, 64])
def test_matrix_tiles(spark, tile):
    from annospark.operators import matrix as mx
    names = [f"n{i:02d}" for i in range(11)]
    cells = {(a, b): float(abs(i - j)) for i, a in enumerate(names) for j, b in enumerate(names) if (i + j) % 5}
    long = spark.createDataFrame([(a, b, d) for (a, b), d in cells.items()], "i string, j string, d double").repartition(4)
    seen = {}
    for r in mx.matrix_tiles(long, tile).collect():
        assert len(r.cells) == tile * tile
        for k, d in enumerate(r.cells):
            i, j = r.tile_row * tile + k // tile, r.tile_col * tile + k % tile
            if d is not None:
                seen[names[i], names[j]] = d
    assert seen == cells


def test_network_cells_with_several_ids(spark):
    from annospark.operators import networks as net
    entries = spark.createDataFrame([(0, "A;B;"), (1, "C"), (2, None), (3, " D ; "), (4, ";"), (5, "E;A")], "entry long, net_id string")
    ann = spark.createDataFrame([(e, f"t{e}") for e in range(7)], "entry long, term string")
    seeds = spark.createDataFrame([("S;T;",), (None,)], "id string")
    edges = spark.createDataFrame([("S", "A", 800), ("T", "D", 701), ("S", "C", 700), ("A", "C", 900)], "protein1 string, protein2 string, combined_score int")
    target, background = net.interaction_sets(ann, entries, seeds, edges)
    assert sorted(r.entry for r in target.collect()) == [0, 3, 5]
    assert sorted(r.entry for r in background.collect()) == [0, 1, 3, 5]


@pytest.mark.parametrize("radius, block", [(0.5, 4), (1.0, 1000), (1.0, 7), (9.0, 30)])
def test_near_pairs(spark, radius, block):
    from annospark.operators import matrix as mx
    pick = np.random.default_rng(3)
    # one group holds most items, on a lattice so that many distances equal the radius, with repeated vectors
    rows = [("hot" if i % 4 else f"g{i % 5}", i, [float(x) / 2 for x in pick.integers(0, 4, 3)]) for i in range(160)]
    rows += [("one", 500, [0.0, 0.0, 0.0]), ("null", 501, None), ("null", 502, [1.0, 1.0, 1.0])]
    frame = spark.createDataFrame(rows, "label string, vec_id long, v array<double>").repartition(4)
    got = {(r.label, r.i, r.j): r.d for r in mx.near_pairs(frame, "label", "vec_id", "v", radius, block=block).collect()}
    expected = {(g, i, j): float(np.linalg.norm(np.array(a) - np.array(b))) for g, i, a in rows for h, j, b in rows
                if g == h and i < j and a and b and np.linalg.norm(np.array(a) - np.array(b)) <= radius}
    assert got.keys() == expected.keys() and all(got[k] == pytest.approx(expected[k]) for k in got)


def test_pair_self_join_blocks_follow_the_group(spark):
    rows = [("hot", i) for i in range(60)] + [("a", 1), ("a", 2), ("b", 3)]
    frame = spark.createDataFrame(rows, "g string, i long")
    expected = {(g, i, j) for g, i in rows for h, j in rows if g == h and i < j}
    for block in (5, 512):
        pairs = iv.pair_self_join(frame, "g", "i", block).collect()
        assert {(r.g, r.i, r.j) for r in pairs} == expected and len(pairs) == len(expected)


def test_distance_matrix_scores_block_pairs_as_arrays(spark):
    from annospark.operators import matrix as mx
    pick = np.random.default_rng(5)
    rows = [("hot" if i % 5 else None, f"n{i % 57}", [float(x) for x in pick.normal(size=3)]) for i in range(70)]
    rows += [("hot", "short", [1.0]), ("hot", "hole", [1.0, None, 2.0]), ("hot", "none", None), ("hot", "zero", [0.0] * 3), ("one", "x", [2.0])]
    frame = spark.createDataFrame(rows, "label string, name string, v array<double>")

    def d(kind, a, b):
        if a is None or b is None or None in a or None in b or len(a) != len(b):
            return None
        a, b = np.array(a), np.array(b)
        norms = np.linalg.norm(a) * np.linalg.norm(b)
        return round(float(np.linalg.norm(a - b)), 9) if kind == "euclidean" else round(1 - float(a @ b) / norms, 9) if norms else None
    for kind in ("euclidean", "cosine"):
        expected = [(g, i, j, d(kind, a, b)) for g, i, a in rows for h, j, b in rows if g and g == h and i != j] + [(g, i, i, 0.0) for g, i, _ in rows]
        for block in (7, 512):
            out = mx.distance_matrix(frame, "label", "name", "v", kind, block)
            assert "FlatMapGroupsInArrow" in out._jdf.queryExecution().toString() and "zip_with" not in out._jdf.queryExecution().toString()
            got = [(r.label, r.i, r.j, None if r.d is None else round(r.d, 9)) for r in out.collect()]
            assert sorted(got, key=str) == sorted(expected, key=str)


def test_near_pairs_deals_whole_blocks(spark):
    from annospark.operators import matrix as mx
    frame = spark.range(3000).select(F.lit("a").alias("label"), F.col("id").alias("vec_id"),
                                     F.array(F.col("id").cast("double"), F.lit(0.0)).alias("v"))
    out = mx.near_pairs(frame, "label", "vec_id", "v", 1.0)
    assert "FlatMapGroupsInArrow" in out._jdf.queryExecution().toString()
    assert sorted((r.i, r.j, r.d) for r in out.collect()) == [(i, i + 1, 1.0) for i in range(2999)]


def _seen(spark, df):
    """``df`` as the rows of a task that counts them, and the counter."""
    rows = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            rows.add(batch.num_rows)
            yield batch
    return df.mapInArrow(run, df.schema), rows


def test_compare_models_reads_the_predictions_once(spark):
    """models without a prediction in the universe, and null ones, keep a row without a second pass."""
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    made = [("a", 1), ("a", 3), ("a", 3), ("b", 9), ("b", None), (None, 1), ("c", 2)]
    preds, rows = _seen(spark, spark.createDataFrame(made, "model string, id long"))
    got = ev.compare_models(ids(1, 2, 3, 4), ids(1, 2, 8), preds, "id").collect()
    assert {r.model: (r.tp, r.fp, r.tn, r.fn) for r in got} == {"a": (1, 1, 1, 1), "b": (0, 0, 2, 2), "c": (1, 0, 2, 1), None: (0, 0, 2, 2)}
    assert rows.value == len(made)


def test_vote_reads_the_clusters_once(spark):
    """the size of a cluster comes from the weights that begin in the sweep."""
    from annospark.operators import intervals as iv
    made = [(1, 0, 10, 2, 0, 10), (1, 2, 12, 1, 0, 10), (1, 4, 9, 1, 0, 10), (1, 30, 40, 1, 30, 40), (None, 0, 5, 1, 0, 5)]
    clusters, rows = _seen(spark, spark.createDataFrame(made, "entry long, s int, e int, w long, cs int, ce int"))
    got = iv.majority_vote(clusters).collect()
    assert sorted((r.entry, r.seq_start, r.seq_end) for r in got) == [(1, 0, 9), (1, 30, 39)]
    assert rows.value == len(made)


def test_position_confusion_carries_the_length_once_a_key(spark):
    """hits are read for their keys and their events only; the length of an entry is no event of each key."""
    made = [("a", 1, 0, 5), ("a", 1, 3, 40), ("b", 1, 9, 9), ("b", 2, 1, 4), ("c", 7, 1, 3), (None, 1, 2, 3)]
    hits, rows = _seen(spark, spark.createDataFrame(made, "model string, entry long, seq_start int, seq_end int"))
    entries = spark.createDataFrame([(1, 20), (1, 30), (2, None), (3, 9)], "entry long, len int")
    truth = spark.createDataFrame([(1, 2, 6), (1, 28, 35), (2, 3, 8), (7, 1, 3)], "entry long, seq_start int, seq_end int")
    got = ev.position_confusion_intervals(hits, truth, entries, "entry", "len", ["model"]).collect()
    want = {}
    for key in {(m, e) for m, e, _s, _e in made}:
        lens = [n or 0 for e, n in [(1, 20), (1, 30), (2, None), (3, 9)] if e == key[1]]
        full = set(range(1, max(lens, default=0)))
        real = {x for e, a, b in [(1, 2, 6), (1, 28, 35), (2, 3, 8)] if e == key[1] for x in range(a, b)}
        pred = {x for m, e, a, b in made if (m, e) == key for x in range(a, b)}
        want[key] = (0,) * 4 if None in key else (len(pred & real), len(pred & full - real), len(full - real - pred), len(real - pred))
    assert {(r.model, r.entry): (r.tp, r.fp, r.tn, r.fn) for r in got} == want
    assert rows.value <= 2 * len(made)
