"""Term enrichment (G1-G12): Fisher's exact test of target vs background
annotation counts, ontology filtering, p-value propagation and the
significance gate, for one target or for many target groups in one job.

Column conventions: annotation tables carry an entry column and a term column
(names are parameters); results carry ``term`` (same name as the input term
column), ``tp, tn, fp, fn, odds_ratio, p_value`` and after ``enrich`` also
``depth, label``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annospark.functions.stats import CHUNK, fisher_degenerate, odds_ratio, part_masses, support_parts
from annospark.operators import ontology as onto
from annospark.session import cut_lineage


def term_counts(ann: DataFrame, term: str = "term", group_cols: Sequence[str] = (),
                out: str = "n") -> DataFrame:
    """G1: annotation rows per term (rows, not distinct entries); null terms dropped."""
    return (ann.where(F.col(term).isNotNull())
            .groupBy(*group_cols, term).agg(F.count(F.lit(1)).alias(out)))


def _with_total(counts: DataFrame, col: str, keys: Sequence[str], out: str) -> DataFrame:
    """Attach the per-group sum of ``col`` (over all terms, shared or not)."""
    if keys:
        totals = counts.groupBy(*keys).agg(F.sum(col).alias(out))
        return totals
    return counts.select(F.sum(col)).scalar()


def shared_terms(t: DataFrame, b: DataFrame, term: str, keys: Sequence[str]) -> DataFrame:
    """Inner join of target and background counts on the term."""
    return t.join(b, on=[*keys, term], how="inner")


def contingency(target: DataFrame, background: DataFrame, term: str = "term",
                group_cols: Sequence[str] = ()) -> DataFrame:
    """Per shared term the 2x2 table ``[[tp, tn], [fp, fn]]``.

    ``tp``/``tn`` = target/background rows of the term; ``fp``/``fn`` = the
    remaining target/background rows over **all** terms.  Background may be
    shared by every group (it then has none of the group columns).
    """
    tkeys = list(group_cols)
    bkeys = [g for g in group_cols if g in background.columns]
    # The count tables are term-sized (groups x terms), not data-sized; each
    # is used by the shared-term join and by the totals, so it is checkpointed
    # to scan the annotation tables once.
    t = cut_lineage(term_counts(target, term, tkeys, "tp"))
    b = cut_lineage(term_counts(background, term, bkeys, "tn"))
    shared = shared_terms(t, b, term, bkeys)
    t_total = _with_total(t, "tp", tkeys, "t_total")
    b_total = _with_total(b, "tn", bkeys, "b_total")
    if tkeys:
        shared = shared.join(t_total, on=tkeys)
    else:
        shared = shared.withColumn("t_total", t_total)
    if bkeys:
        shared = shared.join(b_total, on=bkeys)
    else:
        shared = shared.withColumn("b_total", b_total)
    return (shared.withColumn("fp", F.col("t_total") - F.col("tp"))
            .withColumn("fn", F.col("b_total") - F.col("tn"))
            .drop("t_total", "b_total"))


CELLS = ["tp", "tn", "fp", "fn"]
#: Cells of the support summed in one task; wider parts are dealt in pieces.
PIECE = 1 << 20


def contingency_flagged(ann: DataFrame, flag: Column, term: str = "term") -> DataFrame:
    """G1-G3 when the target is the background rows satisfying ``flag``
    (e.g. annotations of accepted entries vs all annotations): one scan and
    one aggregation give both counts, tp = sum(flag), tn = count(*).
    Same result as ``contingency(ann.where(flag), ann, term)``."""
    counts = cut_lineage(ann.where(F.col(term).isNotNull())
                         .groupBy(term).agg(F.sum(F.when(flag, 1).otherwise(0)).cast("long").alias("tp"),
                                            F.count(F.lit(1)).alias("tn")))
    t_total = counts.select(F.sum("tp")).scalar()
    b_total = counts.select(F.sum("tn")).scalar()
    return (counts.where(F.col("tp") > 0)
            .withColumn("fp", t_total - F.col("tp")).withColumn("fn", b_total - F.col("tn")))


def contingency_partitioned(ann: DataFrame, group: str, term: str = "term") -> DataFrame:
    """G1-G3 for G9 when the target groups partition the background (every
    annotation row carries exactly one group, background = all rows): one
    aggregation per (group, term); the background counts are the per-term sums
    of that term-sized table, so the annotations are scanned once.
    Same result as ``contingency(ann, ann.drop(group), term, [group])``."""
    tp = cut_lineage(ann.where(F.col(term).isNotNull() & F.col(group).isNotNull())
                     .groupBy(group, term).agg(F.count(F.lit(1)).alias("tp")))
    tn = tp.groupBy(term).agg(F.sum("tp").alias("tn"))
    t_total = tp.groupBy(group).agg(F.sum("tp").alias("_t_total"))
    b_total = tp.select(F.sum("tp")).scalar()
    return (tp.join(tn, term).join(t_total, group)
            .withColumn("fp", F.col("_t_total") - F.col("tp")).withColumn("fn", b_total - F.col("tn"))
            .drop("_t_total"))


def _parts(chunk: int, piece: int):
    """Tables -> the parts of their supports, in pieces: tp, tn, fp, fn, lp, side, at, length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [batch.column(c).to_numpy() for c in CELLS]
            found = support_parts(*cells, chunk)
            times = -(-found["length"] // piece)
            part = np.repeat(np.arange(len(times)), times)
            offset = (np.arange(len(part)) - np.repeat(np.cumsum(times) - times, times)) * piece
            row, side = found["row"][part], found["side"][part]
            columns = [*(c[row] for c in cells), found["lp"][row], side, found["at"][part] + side * offset,
                       np.minimum(piece, found["length"][part] - offset)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [*CELLS, "lp", "side", "at", "length"])
    return run


def _masses(chunk: int):
    """Pieces -> tp, tn, fp, fn, lp, s: the mass of their cells relative to the observed one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tp, tn, fp, fn, lp, side, at, length = (batch.column(c).to_numpy() for c in (*CELLS, "lp", "side", "at", "length"))
            s = part_masses(at, side, length, lp, tp + fp, tn + fn, tp + tn, chunk)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*CELLS, "lp")), pa.array(s)], [*CELLS, "lp", "s"])
    return run


def fisher_columns(table: DataFrame, chunk: int = CHUNK, piece: int = PIECE) -> DataFrame:
    """G4 on a table with tp, tn, fp, fn: adds odds_ratio, log_p and p_value.

    The p-value is computed once per distinct table.  Its support is cut into
    chunks, each anchored by the exact log-probability of its likeliest cell
    and summed by the ratio recurrence, in Arrow batches; very wide supports
    (counts of 10^9 and more) are dealt in pieces over the tasks.  The pieces of
    a table are merged on the log scale, relative to the observed cell, in one
    aggregation.
    """
    a, b, c, d = (F.col(x) for x in CELLS)
    table = cut_lineage(table)   # term-sized; read by distinct and by the join
    cells = ", ".join(f"{x} long" for x in CELLS)
    parts = (table.select(*[F.col(x).cast("long").alias(x) for x in CELLS]).distinct()
             .mapInArrow(_parts(chunk, piece), f"{cells}, lp double, side long, at long, length long"))
    sums = (parts.repartition(*CELLS, "at").mapInArrow(_masses(chunk), f"{cells}, lp double, s double")
            .groupBy(*CELLS).agg(F.first("lp").alias("_lp"), F.sum("s").alias("_s")))
    # log_p stays finite where p itself is below the least double
    log_p = (F.when(fisher_degenerate(a, b, c, d), F.lit(0.0))
             .otherwise(F.least(F.lit(0.0), F.col("_lp") + F.log(F.col("_s")))))
    pvals = sums.select(*CELLS, log_p.alias("log_p")).withColumn("p_value", F.exp("log_p"))
    return (table.join(pvals, on=CELLS, how="inner")
            .withColumn("odds_ratio", odds_ratio(a, b, c, d)))


def fisher_test(target: DataFrame, background: DataFrame, term: str = "term",
                group_cols: Sequence[str] = ()) -> DataFrame:
    """G1-G4 composed."""
    return fisher_columns(contingency(target, background, term, group_cols))


def propagate_pvalue(res: DataFrame, desc_table: DataFrame, term: str = "term",
                     group_cols: Sequence[str] = ()) -> DataFrame:
    """p(t) <- min(p(t), min p(d) over descendants d of t present in ``res``).

    ``desc_table(term, descendant)`` comes from ``ontology.descendants``.  One
    join + grouped min; exact because descendants of descendants are
    descendants (the order of the in-place updates does not matter).
    """
    g = list(group_cols)
    ps = [c for c in ("p_value", "log_p") if c in res.columns]
    child_p = (res.select(*g, F.col(term).alias("descendant"), *[F.col(c).alias(f"_child_{c}") for c in ps])
               .join(desc_table.select(F.col("term").alias("ancestor"), "descendant"), "descendant")
               .groupBy(*g, F.col("ancestor").alias(term))
               .agg(*[F.min(f"_child_{c}").alias(f"_child_{c}") for c in ps]))
    return _with_child_values(res, child_p, [*g, term], ps)


def _with_child_values(res: DataFrame, child_p: DataFrame, keys: list[str], ps: list[str]) -> DataFrame:
    return (res.join(child_p, on=keys, how="left")
            .withColumns({c: F.least(F.col(c), F.coalesce(F.col(f"_child_{c}"), F.col(c))) for c in ps})
            .drop(*[f"_child_{c}" for c in ps]))


def propagate_within_groups(res: DataFrame, blocks: DataFrame, term: str = "term", group_cols: Sequence[str] = ()) -> DataFrame:
    """G5 as ``propagate_pvalue`` gives it, for many groups that hold few of the terms each.

    ``blocks`` comes from ``ontology.blocked_lists``.  Most ancestors of a term
    have no row in its group, so a value is not sent to all of them: a row is
    told the blocks that have its term among their ancestors, meets there the
    rows of its own group, and only these pairs are looked up in the lists.
    """
    g = list(group_cols)
    ps = [c for c in ("p_value", "log_p") if c in res.columns]
    # groups meet by their hash; another group's terms drop out in the last join, which compares the groups themselves
    group = F.xxhash64(*[F.col(c) for c in g]) if g else F.lit(0).cast("long")
    rows = res.select(*g, F.col(term).alias("_term"), *ps)
    needs = blocks.select("block", F.explode("ancestors").alias("_above")).distinct()
    above = rows.select(group.alias("_group"), F.col("_term").alias("_above")).distinct().join(needs, "_above")
    below = rows.withColumn("_group", group).join(blocks.select("block", F.col("term").alias("_term")), "_term")
    pairs = below.join(above, ["_group", "block"]).where(F.col("_term") != F.col("_above")).drop("_group", "block")
    child_p = (pairs.join(blocks.select(F.col("term").alias("_term"), "ancestors"), "_term")
               .where(F.array_contains("ancestors", F.col("_above")))
               .groupBy(*g, F.col("_above").alias(term)).agg(*[F.min(c).alias(f"_child_{c}") for c in ps]))
    return _with_child_values(res, child_p, [*g, term], ps)


def propagate_along_edges(res: DataFrame, levels: DataFrame, term: str = "term", group_cols: Sequence[str] = ()) -> DataFrame:
    """G5 without a closure: the least p-value is pushed along the is_a edges, level by level.

    ``levels(child, parent, level)`` comes from ``ontology.edge_levels``.  A
    row waits for the level of its term, meets each edge above it once and is
    then done, so a level moves the rows that wait, not the whole result.
    Terms without a row of their own pass values on.
    """
    g = list(group_cols)
    ps = [c for c in ("p_value", "log_p") if c in res.columns]
    own = levels.select(F.col("child").alias("_term"), F.col("level").alias("_level")).distinct()   # none for a term without parents
    up = cut_lineage(levels.select(F.col("child").alias("_child"), F.col("parent").alias("_term"), "level")
                     .join(own, "_term", "left").withColumnRenamed("_term", "_parent"))
    number = levels.agg(F.max("level")).first()[0]

    def least(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*g, "_term", "_level").agg(*[F.min(c).alias(c) for c in ps])
    waiting = cut_lineage(least(res.select(*g, F.col(term).alias("_term"), *ps).join(own, "_term", "left")))
    done: list[DataFrame] = []
    for level in range(0 if number is None else number + 1):
        now = waiting.where(F.col("_level") == level)
        done.append(now)
        moved = (now.drop("_level").join(up.where(F.col("level") == level), F.col("_term") == F.col("_child"))
                 .select(*g, F.col("_parent").alias("_term"), "_level", *ps))
        later = waiting.where(F.col("_level").isNull() | (F.col("_level") > level)).select(*moved.columns)
        waiting = cut_lineage(least(later.unionByName(moved)))
    best = waiting
    for part in done:
        best = best.unionByName(part)
    best = best.select(*g, F.col("_term").alias(term), *[F.col(c).alias(f"_best_{c}") for c in ps])
    return (res.join(best, on=[*g, term]).withColumns({c: F.col(f"_best_{c}") for c in ps})
            .drop(*[f"_best_{c}" for c in ps]))


def enrich(target: DataFrame | None, background: DataFrame | None, nodes: DataFrame, edges: DataFrame | None = None,
           term: str = "term", group_cols: Sequence[str] = (), propagate: bool = True,
           levels: DataFrame | None = None, depth_table: DataFrame | None = None,
           table: DataFrame | None = None, closure: DataFrame | None = None) -> DataFrame:
    """Fisher -> keep terms that are labelled and have depth > 0 (roots and
    terms without a path to a root are dropped) -> attach depth and label ->
    propagate p-values (G5) along the edges; no closure is computed.

    ``levels`` (from ``ontology.edge_levels``) and ``depth_table`` may be passed
    in to reuse them across calls; ``table`` may be a ready contingency table
    (e.g. from ``contingency_flagged``) instead of target/background.  With many
    groups of few terms, most terms that a value passes have no row in its
    group: then a given ``closure`` moves fewer rows, as lists (``ontology.closure_lists``) the fewest.
    """
    if edges is None and (depth_table is None or (propagate and levels is None and closure is None)):
        raise ValueError("edges are required when levels or depths are not given")
    depth_table = depth_table if depth_table is not None else onto.depth_from_roots(nodes, edges)
    known = (depth_table.where(F.col("depth") > 0)
             .join(nodes.select("term", "label"), "term")
             .withColumnRenamed("term", term))
    fis = fisher_columns(table) if table is not None else fisher_test(target, background, term, group_cols)
    res = fis.join(known, term)
    if propagate and closure is not None and "ancestors" in closure.columns:
        res = propagate_within_groups(cut_lineage(res), onto.blocked_lists(nodes, closure), term, group_cols)
    elif propagate and closure is not None:
        res = propagate_pvalue(cut_lineage(res), onto.descendants(nodes, closure), term, group_cols)
    elif propagate:
        levels = levels if levels is not None else onto.edge_levels(edges)
        res = propagate_along_edges(cut_lineage(res), levels, term, group_cols)
    # term-sized result, read twice by the gate (group statistics + rows)
    return cut_lineage(res)


def _score(res: DataFrame) -> Column:
    """ln(1/p), from log_p where the result has it (finite for the smallest p)."""
    if "log_p" in res.columns:
        return -F.col("log_p")
    p = F.col("p_value")
    return F.when(p == 0, F.lit(float("inf"))).otherwise(-F.log(p))


def significance_gate(res: DataFrame, max_p: float = 0.05, max_depth: int = 4,
                      bonferroni: bool = False, group_cols: Sequence[str] = ()) -> DataFrame:
    """G7/G8/B7 per group.

    Threshold = ``max_p`` or ``max_p / n`` (Bonferroni, n = result rows of the
    group).  If at least one row has ``p <= thr`` and ``depth <= max_depth`` the
    rows with ``p < thr`` and ``depth <= max_depth`` are kept with
    ``score = ln(1/p)``; otherwise every row is returned with ``score = -1``.
    """
    g = list(group_cols)
    pmin = F.min(F.when(F.col("depth") <= max_depth, F.col("p_value")))
    thr = F.lit(float(max_p)) / F.count(F.lit(1)) if bonferroni else F.lit(float(max_p))
    limit = F.when(pmin <= thr, thr)  # null: nothing passes
    if g:
        joined = res.join(res.groupBy(*g).agg(limit.alias("_limit")), on=g)
    else:
        joined = res.withColumn("_limit", res.agg(limit).scalar())
    limit = F.col("_limit")
    return (joined.where(limit.isNull() | ((F.col("p_value") < limit) & (F.col("depth") <= max_depth)))
            .withColumn("score", F.when(limit.isNotNull(), _score(res)).otherwise(F.lit(-1.0)))
            .drop("_limit"))


def enrich_filter(res: DataFrame, max_p: float = 0.05, max_depth: int = 5) -> DataFrame:
    """Rows with p < max_p and depth <= max_depth, score = ln(1/p)."""
    return (res.where((F.col("p_value") < max_p) & (F.col("depth") <= max_depth))
            .withColumn("score", _score(res)))


def enrich_many(target: DataFrame, background: DataFrame | None, nodes: DataFrame, edges: DataFrame | None,
                group_col: str, term: str = "term", max_p: float = 0.05, max_depth: int = 4,
                bonferroni: bool = True, levels: DataFrame | None = None,
                depth_table: DataFrame | None = None, closure: DataFrame | None = None) -> DataFrame:
    """``enrich`` + gate for every target group against one background,
    as one job (the ontology is walked once).  ``background=None`` means the
    groups partition the background (the architecture case): counted in one
    pass by ``contingency_partitioned``."""
    table = contingency_partitioned(target, group_col, term) if background is None else None
    res = enrich(target, background, nodes, edges, term, [group_col], True, levels, depth_table, table, closure)
    return significance_gate(res, max_p, max_depth, bonferroni, [group_col])


def term_weights(res: DataFrame, k: int, label: str = "label", group_cols: Sequence[str] = ()) -> DataFrame:
    """Label -> score / max(score) of its group, best ``k`` per group."""
    g = list(group_cols)
    if g:
        best = res.groupBy(*g).agg(F.max("score").alias("_max"))
        w = res.join(best, on=g).withColumn("weight", F.try_divide(F.col("score"), F.col("_max")))
    else:
        w = res.withColumn("weight", F.try_divide(F.col("score"), res.select(F.max("score")).scalar()))
    from annospark.operators.setops import top_k_per_group
    return top_k_per_group(w.select(*g, label, "score", "weight"), g, [F.col("score").desc(), F.col(label)], k)


def top_terms(res: DataFrame, k: int, by: str = "score", term: str = "term") -> DataFrame:
    """Best ``k`` rows by score (descending) or p_value (ascending), term as tie-breaker."""
    by = "log_p" if by == "p_value" and "log_p" in res.columns else by
    order = F.col(by).desc() if by == "score" else F.col(by).asc()
    return res.orderBy(order, F.col(term)).limit(k)


def target_background_original(ann: DataFrame, accepted: DataFrame, entry: str = "entry") -> tuple[DataFrame, DataFrame]:
    """target = annotations of accepted entries, background = all annotations."""
    return ann.join(accepted.select(entry).distinct(), entry, "left_semi"), ann
