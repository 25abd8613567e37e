import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from annospark.operators import enrichment as enr
from annospark.operators import intervals as iv
from annospark.operators import islands
from annospark.operators import ontology as onto


def brute_fisher(a, b, c, d):
    """Two-sided Fisher p over the full support (independent of the Spark code)."""
    n1, n2, r = a + c, b + d, a + b
    if 0 in (a + b, c + d, a + c, b + d):
        return 1.0
    lf = lambda n: math.lgamma(n + 1)
    lp = lambda k: (lf(n1) - lf(k) - lf(n1 - k) + lf(n2) - lf(r - k) - lf(n2 - r + k)
                    - lf(n1 + n2) + lf(r) + lf(n1 + n2 - r))
    obs = lp(a)
    return min(1.0, sum(math.exp(lp(k)) for k in range(max(0, r - n2), min(r, n1) + 1) if lp(k) <= obs + 1e-7))


def test_fisher_matches_brute_force(spark):
    rnd = random.Random(7)
    tables = [(rnd.randint(0, 60), rnd.randint(0, 60), rnd.randint(0, 3000), rnd.randint(0, 3000)) for _ in range(300)]
    tables += [(500, 1, 10, 5000), (0, 900, 900, 0), (3, 3, 3, 3), (1, 0, 0, 1), (0, 0, 5, 5), (2000, 2100, 18000, 78000)]
    # far from the mode on either side (two windows + mirror cell), and a symmetric tie
    tables += [(9000, 1000, 11000, 79000), (100, 9000, 19900, 71000), (4000, 4000, 4000, 4000),
               (30000, 20000, 30000, 120000), (200, 20000, 60000, 150000)]
    df = spark.createDataFrame(tables, "tp long, tn long, fp long, fn long")
    got = {(r.tp, r.tn, r.fp, r.fn): r for r in enr.fisher_columns(df).collect()}
    for t in set(tables):
        exp = brute_fisher(*t)
        assert got[t].p_value == pytest.approx(exp, rel=1e-7, abs=1e-12), t
        a, b, c, d = t
        if 0 in (a + b, c + d, a + c, b + d):
            assert math.isnan(got[t].odds_ratio)
        elif b * c == 0:
            assert math.isinf(got[t].odds_ratio)
        else:
            assert got[t].odds_ratio == pytest.approx(a * d / (b * c))


def _graph(spark):
    # 1 root, 5 unreachable from a labelled root (parent 9 is unlabelled and parentless)
    nodes = spark.createDataFrame([(1, "r"), (2, "a"), (3, "b"), (4, "c"), (5, "orphan")], "term long, label string")
    edges = spark.createDataFrame([(2, 1), (3, 1), (4, 2), (4, 3), (3, 2), (5, 9)], "child long, parent long")
    return nodes, edges


def test_closure_depth_roots(spark):
    nodes, edges = _graph(spark)
    clo = onto.closure_with_distance(edges)
    pairs = {(r.descendant, r.ancestor): r.dist for r in clo.collect()}
    assert pairs[(4, 1)] == 2 and pairs[(3, 1)] == 1 and pairs[(4, 2)] == 1
    depth = {r.term: r.depth for r in onto.depth(nodes, edges, clo).collect()}
    assert depth == {1: 0, 2: 1, 3: 1, 4: 2}
    assert {r.term for r in onto.roots(nodes, edges).collect()} == {1}
    desc = {(r.term, r.descendant) for r in onto.descendants(nodes, clo).collect()}
    assert (1, 4) in desc and (9, 5) in desc


def test_cycle_detected(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "child long, parent long")
    with pytest.raises(onto.OntologyCycleError):
        onto.closure_with_distance(edges)


def test_propagation_and_gate(spark):
    res = spark.createDataFrame([(2, 0.2, 1), (3, 0.01, 1), (4, 0.001, 2)], "term long, p_value double, depth int")
    desc = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (2, 4), (3, 4)], "term long, descendant long")
    out = {r.term: r.p_value for r in enr.propagate_pvalue(res, desc).collect()}
    assert out == {2: 0.001, 3: 0.001, 4: 0.001}
    gated = enr.significance_gate(res, 0.05, 1, False).collect()
    assert sorted(r.term for r in gated) == [3]
    # nothing passes -> all rows, score -1
    fb = enr.significance_gate(res, 0.0001, 4, False).collect()
    assert len(fb) == 3 and all(r.score == -1.0 for r in fb)
    # p == threshold passes neither test -> empty
    eq = spark.createDataFrame([(2, 0.05, 1)], "term long, p_value double, depth int")
    assert enr.significance_gate(eq, 0.05, 4, False).count() == 0


def brute_ensemble(rows, eps=0.4, metric="rows"):
    """Per entry: Jaccard matrix, DBSCAN(min_samples=1) components, majority vote."""
    out = []
    by_entry = {}
    for e, s, t in rows:
        if t > s:
            by_entry.setdefault(e, []).append((s, t))
    for e, hits in by_entry.items():
        n = len(hits)
        sets = [set(range(s, t)) for s, t in hits]
        D = [[1 - len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for j in range(n)] for i in range(n)]
        if metric == "rows":
            dist = lambda i, j: math.sqrt(sum((D[i][k] - D[j][k]) ** 2 for k in range(n)))
        else:
            dist = lambda i, j: D[i][j]
        label = list(range(n))
        changed = True
        while changed:
            changed = False
            for i in range(n):
                for j in range(n):
                    if i != j and dist(i, j) <= eps + 1e-12 and label[j] < label[i]:
                        label[i] = label[j]
                        changed = True
        for lab in set(label):
            members = [sets[i] for i in range(n) if label[i] == lab]
            votes = {}
            for m in members:
                for p in m:
                    votes[p] = votes.get(p, 0) + 1
            kept = [p for p, v in votes.items() if v >= len(members) / 2]
            if kept:
                out.append((e, min(kept), max(kept)))
    return sorted(out)


@pytest.mark.parametrize("metric", ["rows", "precomputed"])
def test_ensemble_matches_brute_force(spark, metric):
    rnd = random.Random(3)
    rows = []
    for e in range(40):
        for _ in range(rnd.randint(1, 9)):
            s = rnd.randint(0, 60)
            rows.append((e, s, s + rnd.randint(0, 40)))
    rows += [(99, 10, 20), (99, 10, 20), (99, 10, 20), (99, 30, 40)]  # duplicates vote separately
    df = spark.createDataFrame(rows, "entry long, seq_start int, seq_end int")
    got = sorted(tuple(r) for r in iv.ensemble([df], 0.4, metric).collect())
    assert got == brute_ensemble(rows, 0.4, metric)


def test_overlap_pairs_exact(spark):
    rnd = random.Random(5)
    nodes = [(1, s, s + rnd.randint(1, 700), 1) for s in rnd.sample(range(0, 3000), 60)]
    df = spark.createDataFrame(nodes, "entry long, s int, e int, w long")
    got = sorted((r.s1, r.e1, r.s2, r.e2) for r in iv.overlap_pairs(df, bucket=64).collect())
    exp = sorted((a[1], a[2], b[1], b[2]) for a in nodes for b in nodes
                 if a != b and min(a[2], b[2]) > max(a[1], b[1]))
    assert got == exp


def test_top_k_per_group_salted(spark):
    from annospark.operators.setops import top_k_per_group
    rows = [("hot", f"p{i:04d}", float(i % 97)) for i in range(3000)] + [("cold", "x", 1.0)]
    df = spark.createDataFrame(rows, "g string, p string, s double")
    got = top_k_per_group(df, ["g"], [F.col("s").desc(), F.col("p")], 3, salt_buckets=16).collect()
    exp = sorted([r for r in rows if r[0] == "hot"], key=lambda r: (-r[2], r[1]))[:3] + [("cold", "x", 1.0)]
    assert sorted(tuple(r) for r in got) == sorted(exp)


def test_merge_intervals_and_interval_confusion(spark):
    from annospark.operators import evaluation as ev
    rnd = random.Random(11)
    hits = [(e, s, s + rnd.randint(0, 30)) for e in range(20) for s in rnd.sample(range(0, 150), rnd.randint(1, 8))]
    df = spark.createDataFrame(hits, "entry long, seq_start int, seq_end int")
    got = {}
    for r in iv.merge_intervals(df, ["entry"]).collect():
        got.setdefault(r.entry, set()).update(range(r.s, r.e))
    exp = {}
    for e, s, t in hits:
        if t > s:
            exp.setdefault(e, set()).update(range(s, t))
    assert got == exp
    truth = [(e, s, s + 20) for e in range(0, 25, 2) for s in (5, 60)]
    tdf = spark.createDataFrame(truth, "entry long, seq_start int, seq_end int")
    ents = spark.createDataFrame([(e, 120) for e in range(22)], "entry long, len int")
    conf = {r.entry: (r.tp, r.fp, r.tn, r.fn) for r in
            ev.position_confusion_intervals(df, tdf, ents, "entry", "len").collect()}
    for e, pp in exp.items():
        t = set()
        for te, s, x in truth:
            if te == e:
                t.update(range(s, x))
        u = set(range(1, 120)) | t
        neg = u - t
        pn = u - pp
        assert conf[e] == (len(t & pp), len(neg & pp), len(neg & pn), len(t & pn)), e


def test_closure_algorithms_agree(spark):
    rows = [(k, k // 2) for k in range(1, 300)] + [(k, k // 3) for k in range(1, 300)] + [(7, 1)]
    edges = spark.createDataFrame(rows, "child long, parent long").distinct()
    a = {(r.descendant, r.ancestor, r.dist) for r in onto.closure_with_distance(edges).collect()}
    b = {(r.descendant, r.ancestor, r.dist) for r in onto.closure_bfs(edges).collect()}
    assert a == b and len(a) > 1000


def test_position_and_interval_forms_agree(spark):
    from annospark.operators import evaluation as ev
    rnd = random.Random(17)
    hits = [(m, e, s, s + rnd.randint(0, 25)) for m in ("x", "y") for e in range(15)
            for s in rnd.sample(range(0, 110), rnd.randint(1, 5))]
    pred = spark.createDataFrame(hits, "model string, entry long, seq_start int, seq_end int")
    ents = spark.createDataFrame([(e, 100) for e in range(12)], "entry long, len int")
    matches = spark.createDataFrame([(e, f"{5 + e}..{30 + e},{60}..{70 + e}") for e in range(0, 12, 3)],
                                    "entry long, matches string")
    by_pos = ev.position_confusion(pred, ev.truth_positions(ents, matches), "entry", ["model"])
    by_iv = ev.position_confusion_intervals(pred, ev.truth_intervals(ents, matches), ents, "entry", "len", ["model"])
    key = lambda r: (r.model, r.entry)
    cols = ("tp", "fp", "tn", "fn")
    a = {key(r): tuple(r[c] for c in cols) for r in by_pos.collect()}
    b = {key(r): tuple(r[c] for c in cols) for r in by_iv.collect()}
    assert a == b
    pos = ev.set_union_positions(pred.select("entry", "seq_start", "seq_end"))
    n = {r.entry: r["count"] for r in pos.groupBy("entry").count().collect()}
    summ = {r.entry: r.n_positions for r in ev.set_union_summary(pred.select("entry", "seq_start", "seq_end")).collect()}
    assert n == summ
    tsum = {r.entry: (r.n_positive, r.n_negative) for r in ev.truth_summary(ents, matches).collect()}
    tp = ev.truth_positions(ents, matches).groupBy("entry").agg(F.sum("is_pos").alias("p"), F.sum(1 - F.col("is_pos")).alias("n"))
    assert tsum == {r.entry: (r.p, r.n) for r in tp.collect()}


def test_contingency_flagged_equals_two_table(spark):
    rnd = random.Random(23)
    rows = [(rnd.randint(0, 50), rnd.choice(["t1", "t2", "t3", "t4", None]), rnd.random() < 0.3) for _ in range(2000)]
    ann = spark.createDataFrame(rows, "entry long, term string, f boolean")
    a = {tuple(r) for r in enr.contingency_flagged(ann, F.col("f"), "term").select("term", "tp", "tn", "fp", "fn").collect()}
    b = {tuple(r) for r in enr.contingency(ann.where("f"), ann, "term").select("term", "tp", "tn", "fp", "fn").collect()}
    assert a == b


def test_contingency_partitioned_equals_general(spark):
    rnd = random.Random(29)
    rows = [(e, rnd.choice(["t1", "t2", "t3", None]), f"g{e % 4}") for e in range(300) for _ in range(rnd.randint(1, 4))]
    ann = spark.createDataFrame(rows, "entry long, term string, grp string")
    cols = ["grp", "term", "tp", "tn", "fp", "fn"]
    a = {tuple(r) for r in enr.contingency_partitioned(ann, "grp", "term").select(*cols).collect()}
    b = {tuple(r) for r in enr.contingency(ann, ann.drop("grp"), "term", ["grp"]).select(*cols).collect()}
    assert a == b


@pytest.mark.parametrize("small", [500, 2])
def test_long_chain_component(spark, small):
    # 400 hits shifted by one position: one long chain under 'precomputed' eps
    nodes = spark.createDataFrame([(1, i, i + 100, 1) for i in range(400)], "entry long, s int, e int, w long")
    got = {(r.cs, r.ce) for r in islands.island_clusters(nodes, 0.4, "precomputed", small, block=64).collect()}
    assert got == {(0, 100)}


@pytest.mark.parametrize("metric", ["rows", "precomputed"])
def test_large_islands_match_brute_force(spark, metric):
    rnd = random.Random(8)
    rows = [(e, s, s + rnd.choice([20, 21, 22, 40])) for e in range(4) for s in (rnd.randint(0, 50) for _ in range(30))]
    rows += [(9, 5, 5), (9, 7, 3), (10, 0, 4), (10, 4, 8), (10, 8, 9)]   # empty hits, and hits that only touch
    hits = spark.createDataFrame(rows, "entry long, seq_start int, seq_end int")
    kept = [r for r in rows if r[2] > r[1]]
    for small, block in ((1, 7), (10, 4)):
        clusters = iv.eps_clusters(hits, 0.4, metric, small=small, block=block)
        got = sorted((r.entry, r.seq_start, r.seq_end) for r in iv.majority_vote(clusters).collect())
        assert got == brute_ensemble(kept, 0.4, metric)


@pytest.mark.parametrize("metric", ["rows", "precomputed"])
def test_stacked_region(spark, metric):
    # 10^5 hits over one region: the blocks of its nodes give the clusters of the whole matrix
    hits = (spark.range(100_000).select(F.lit(1).alias("entry"), F.pmod(F.xxhash64("id"), F.lit(40)).cast("int").alias("seq_start"),
                                        F.pmod(F.xxhash64("id", F.lit(7)), F.lit(30)).alias("x"))
            .select("entry", "seq_start", (F.col("seq_start") + 30 + F.col("x")).cast("int").alias("seq_end")))
    nodes = iv.collapse_hits(hits).collect()
    assert len(nodes) == 1200 > islands.SMALL
    nodes.sort(key=lambda r: (r.s, r.e))
    s, e, w = (np.array([[r[c] for r in nodes]]) for c in ("s", "e", "w"))
    label = islands.solve(s, e, w.astype(float), 0.4, metric)[0]
    expected = {(r.s, r.e): (nodes[k].s, nodes[k].e) for r, k in zip(nodes, label, strict=True)}
    got = {(r.s, r.e): (r.cs, r.ce) for r in iv.eps_clusters(hits, 0.4, metric).collect()}
    assert got == expected


def test_ensemble_of_nothing(spark):
    empty = spark.createDataFrame([], "entry string, seq_start long, seq_end long")
    assert iv.ensemble([empty, empty]).count() == 0
    one = spark.createDataFrame([("x", 3, 9)], "entry string, seq_start long, seq_end long")
    assert [tuple(r) for r in iv.ensemble([one]).collect()] == [("x", 3, 8)]
    with pytest.raises(ValueError):
        iv.ensemble([one], eps=1.2)


def test_levels_and_depth_need_no_closure(spark):
    rnd = random.Random(31)
    # terms 0..80, parents always smaller; some terms have no label, some edges skip levels
    rows = {(k, rnd.randrange(max(0, k - 12), k)) for k in range(4, 81) for _ in range(rnd.randint(0, 3))}
    edges = spark.createDataFrame(sorted(rows), "child long, parent long")
    nodes = spark.createDataFrame([(k, f"n{k}") for k in range(81) if k % 9], "term long, label string")
    closure = onto.closure_with_distance(edges)
    expected = {(r.term, r.depth) for r in onto.depth(nodes, edges, closure).collect()}
    assert {(r.term, r.depth) for r in onto.depth_from_roots(nodes, edges).collect()} == expected
    levels = onto.edge_levels(edges)
    got = {(r.child, r.parent): r.level for r in levels.collect()}
    assert set(got) == rows
    for child, parent in rows:
        below = [got[c, p] for c, p in rows if p == child]
        assert got[child, parent] == (max(below) + 1 if below else 0)
    res = spark.createDataFrame([(g, k, rnd.random(), -rnd.random()) for g in "ab" for k in range(81) if k % 9 and rnd.random() < 0.6],
                                "grp string, term long, p_value double, log_p double")
    pushed = enr.propagate_along_edges(res, levels, "term", ["grp"])
    joined = enr.propagate_pvalue(res, onto.descendants(nodes, closure), "term", ["grp"])
    cols = ["grp", "term", "p_value", "log_p"]
    assert sorted(map(tuple, pushed.select(cols).collect())) == sorted(map(tuple, joined.select(cols).collect()))
    assert enr.propagate_along_edges(res, onto.edge_levels(edges.limit(0)), "term", ["grp"]).count() == res.count()


def test_levels_of_a_deep_chain_and_a_cycle(spark):
    chain = spark.range(40).select((F.col("id") + 1).alias("child"), F.col("id").alias("parent"))
    levels = onto.edge_levels(chain)
    assert levels.agg(F.max("level")).first()[0] == 39
    res = spark.createDataFrame([(k, 0.5 if k < 40 else 0.01) for k in range(0, 41, 5)], "term long, p_value double")
    assert {r.p_value for r in enr.propagate_along_edges(res, levels).collect()} == {0.01}
    for cycle in ([(1, 1)], [(1, 2), (2, 1)], [(3, 1), (1, 2), (2, 1)]):
        with pytest.raises(onto.OntologyCycleError):
            onto.edge_levels(spark.createDataFrame(cycle, "child long, parent long"))


def test_closure_is_handed_down_as_lists(spark):
    rows = [(7, 1), (9, 7), (9, 1), (12, 9), (12, 7), (3, None), (None, 1), (7, 1)]
    edges = spark.createDataFrame(rows, "child long, parent long")
    lists = {r.term: dict(zip(r.ancestors, r.dists)) for r in onto.closure_lists(edges).collect()}
    assert lists == {7: {1: 1}, 9: {7: 1, 1: 1}, 12: {9: 1, 7: 1, 1: 2}}
    nodes = spark.createDataFrame([(9, "n"), (12, "m"), (1, "r")], "term long, label string")
    rows_of = onto.ancestors(nodes, onto.closure_lists(edges)).collect()
    assert sorted((r.term, r.ancestor) for r in rows_of) == [(9, 1), (9, 7), (12, 1), (12, 7), (12, 9)]
    assert onto.closure_lists(edges.limit(0)).count() == 0


def test_swept_pairs_sweep_only_large_entries(spark):
    rnd = random.Random(8)
    dom = [(e, m, s, s + rnd.randint(-1, 12)) for e, n in ((1, 40), (2, 3), (None, 2)) for m in "ab" for s in (rnd.randint(0, 90) for _ in range(n))]
    struct = [(e, f"s{i}", s, s + rnd.randint(0, 9)) for i, (e, s) in enumerate((rnd.choice([1, 1, 1, 2, 3, None]), rnd.randint(0, 90)) for _ in range(60))]
    d = spark.createDataFrame(dom, "entry long, model string, seq_start int, seq_end int")
    s = spark.createDataFrame(struct, "entry long, struct_id string, s_start int, s_end int")
    cols = ["entry", "model", "struct_id", "seq_start", "seq_end", "s_start", "s_end", "inter"]
    expected = sorted((e, m, i, a, b, x, y, min(b, y) - max(a, x)) for e, m, a, b in dom for f, i, x, y in struct
                      if e == f and e and b > a and y > x and min(b, y) > max(a, x))
    for plain in (1000, 10, 1):
        assert sorted(map(tuple, iv.swept_pairs(d, s, plain=plain, rows=16).select(cols).collect())) == expected


def test_position_confusion_computes_each_input_once(spark):
    from annospark.operators import evaluation as ev
    hits = spark.createDataFrame([("x", 1, 5, 20), ("x", 2, 9, 9), ("y", 3, 1, 4), (None, 1, 2, 6)], "model string, entry long, seq_start int, seq_end int")
    truth = spark.createDataFrame([(1, 10, 30), (2, 3, 5)], "entry long, seq_start int, seq_end int")
    ents = spark.createDataFrame([(1, 40), (2, 10)], "entry long, len int")
    out = ev.position_confusion_intervals(hits, truth, ents, "entry", "len", ["model"])
    got = {(r.model, r.entry): (r.tp, r.fp, r.tn, r.fn) for r in out.collect()}
    assert got == {("x", 1): (10, 5, 14, 10), ("x", 2): (0, 0, 7, 2), ("y", 3): (0, 0, 0, 0), (None, 1): (0, 0, 0, 0)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 5   # keys are joined once, not four times


def test_values_reach_only_ancestors_of_their_group(spark, monkeypatch):
    """All ways of propagating agree; blocks of like terms meet only the rows of a group, levels move waiting rows only."""
    rnd = random.Random(21)
    pairs = sorted({(k, k // d) for k in range(1, 150) for d in (3, 5)})
    edges = spark.createDataFrame(pairs, "child long, parent long")
    nodes = spark.createDataFrame([(k, f"n{k}") for k in range(150)], "term long, label string")
    rows = [(g, t, rnd.random(), -rnd.random()) for g in range(40) for t in rnd.sample(range(150), 6)] + [(99, t, rnd.random(), -1.0) for t in range(150)]
    rows += [(99, 7, 0.0, -9.0), (None, 3, 0.5, -1.0)]
    res = spark.createDataFrame(rows, "grp long, term long, p_value double, log_p double")
    lists = onto.closure_lists(edges)
    want = sorted(map(tuple, enr.propagate_pvalue(res, onto.descendants(nodes, lists), "term", ["grp"]).collect()), key=repr)
    monkeypatch.setattr(onto, "BLOCK_TERMS", 8)
    blocks = onto.blocked_lists(nodes, lists)
    assert max(r["count"] for r in blocks.groupBy("block").count().collect()) <= 8
    assert blocks.count() == lists.count()
    got = enr.propagate_within_groups(res, blocks, "term", ["grp"])
    assert sorted(map(tuple, got.collect()), key=repr) == want
    one = res.where("grp = 3").drop("grp")
    assert (sorted(map(tuple, enr.propagate_within_groups(one, blocks).collect()))
            == sorted(map(tuple, enr.propagate_along_edges(one, onto.edge_levels(edges)).collect())))


def test_a_level_reads_only_rows_that_wait(spark, monkeypatch):
    """Rows of a term are done after its level, so what a level moves shrinks with the terms still waiting."""
    edges = spark.createDataFrame([(k, k // 2) for k in range(1, 256)], "child long, parent long")
    res = spark.createDataFrame([(k, (k * 37 % 256) / 256) for k in range(256)], "term long, p_value double")
    levels, sizes = onto.edge_levels(edges), []
    cut = enr.cut_lineage

    def counted(df):
        out = cut(df)
        if "_level" in out.columns and "level" not in out.columns:
            sizes.append(out.count())
        return out
    monkeypatch.setattr(enr, "cut_lineage", counted)
    got = {r.term: r.p_value for r in enr.propagate_along_edges(res, levels).collect()}
    below = {k: {k} for k in range(256)}
    for k in range(255, 0, -1):
        below[k // 2] |= below[k]
    assert got == {k: min((d * 37 % 256) / 256 for d in below[k]) for k in range(256)}
    assert sizes[0] == 256 and sizes[-1] == 1 and sum(sizes) < 3 * 256


def test_distance_matrix_blocks_do_not_grow_with_the_group(spark, monkeypatch):
    from annospark.operators import matrix as mx
    count = spark.createDataFrame([(1, ), (512, ), (2000, ), (60000, ), (600000, )], "c long")
    got = [r[0] for r in count.select(mx._block_number(F.col("c"), 512)).collect()]
    assert got == [1, 1, 4, 16, 74]   # not 118 and 1172
    monkeypatch.setattr(mx, "CELLS", 7)   # tiles of a row each, written one by one
    items = spark.createDataFrame([(i % 2, i, [float(i), float(i * i % 7)]) for i in range(50)], "g int, i long, v array<double>")
    rows = {(r["g"], r["i"], r["j"]): r["d"] for r in mx.distance_matrix(items, "g", "i", "v", block=3).collect()}
    assert len(rows) == 2 * 25 * 25
    assert all(d == pytest.approx(math.hypot(i - j, i * i % 7 - j * j % 7)) and g == i % 2 == j % 2 for (g, i, j), d in rows.items())
