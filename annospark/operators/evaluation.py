"""Evaluation of predictions against a truth table.

Confusion counts use the reference's set definitions: negative = universe -
positive, predicted negative = universe - predicted positive, and
tp=|P∩P'|, fp=|N∩P'|, tn=|N∩N'|, fn=|P∩N'|.  Keys are tagged and combined by
one ``groupBy`` (no outer joins); metrics use ``try_divide`` (null on a zero
denominator).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annospark.operators.intervals import swept_pairs
from annospark.operators.reshape import coverage_filter, parse_ranges, to_positions
from annospark.session import cut_lineage

PERCENTILES = (0.0, 0.25, 0.5, 0.75, 1.0)


def _flags(universe: DataFrame, truth: DataFrame, pred: DataFrame, keys: Sequence[str],
           group: Sequence[str] = ()) -> DataFrame:
    """One row per key with in_u / in_p / in_pp flags (one shuffle)."""
    k = list(keys)
    tagged = (universe.select(*k, F.lit(1).alias("u"), F.lit(0).alias("p"), F.lit(0).alias("pp"))
              .unionByName(truth.select(*k, F.lit(0).alias("u"), F.lit(1).alias("p"), F.lit(0).alias("pp")))
              .unionByName(pred.select(*k, F.lit(0).alias("u"), F.lit(0).alias("p"), F.lit(1).alias("pp"))))
    return tagged.groupBy(*k).agg(F.max("u").alias("in_u"), F.max("p").alias("in_p"), F.max("pp").alias("in_pp"))


def confusion_from_flags(flags: DataFrame, group: Sequence[str] = (), pred_universe: Column | None = None) -> DataFrame:
    """Conditional sums over flagged keys; ``pred_universe`` defaults to in_u."""
    pos = F.col("in_p") == 1
    neg = (F.col("in_u") == 1) & (F.col("in_p") == 0)
    pp = F.col("in_pp") == 1
    pu = pred_universe if pred_universe is not None else (F.col("in_u") == 1)
    pn = pu & (F.col("in_pp") == 0)
    def cnt(c: Column) -> Column:
        return F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return flags.groupBy(*group).agg(cnt(pos & pp).alias("tp"), cnt(neg & pp).alias("fp"),
                                     cnt(neg & pn).alias("tn"), cnt(pos & pn).alias("fn"))


def confusion(universe: DataFrame, truth: DataFrame, pred: DataFrame, key: str) -> DataFrame:
    """One row (tp, fp, tn, fn) at entity level."""
    return confusion_from_flags(_flags(universe, truth, pred, [key]))


def metrics(conf: DataFrame) -> DataFrame:
    """Precision, recall, accuracy, weighted accuracy ((tpr + tnr) / 2)."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    tpr = F.try_divide(tp, tp + fn)
    tnr = F.try_divide(tn, tn + fp)
    return conf.select("*",
                       F.try_divide(tp, tp + fp).alias("precision"),
                       tpr.alias("recall"),
                       F.try_divide(tp + tn, tp + fp + tn + fn).alias("accuracy"),
                       ((tpr + tnr) / 2.0).alias("weighted_accuracy"))


def compare_models(universe: DataFrame, truth: DataFrame, preds: DataFrame, key: str,
                   model: str = "model") -> DataFrame:
    """I1 + I2 per model; ``preds`` = (model, key).

    tp/fp come from joining the predictions with the truth flags; fn/tn
    follow from the totals |P| and |N| (scalar subqueries), so the universe is
    never replicated per model.
    """
    u = universe.select(key).distinct()
    t = truth.select(key).distinct().join(u, key, "left_semi")
    flagged = (u.join(t.withColumn("_pos", F.lit(1)), key, "left")
               .select(key, F.coalesce("_pos", F.lit(0)).alias("_pos")))
    n_pos = t.select(F.count(F.lit(1))).scalar()
    n_neg = u.select(F.count(F.lit(1))).scalar() - n_pos
    # the predictions are read once: those outside the universe keep the row of their model and count nowhere
    count = lambda c: F.coalesce(F.sum(F.when(F.col(model).isNotNull(), c)), F.lit(0)).cast("long")
    per_model = (preds.select(model, key).distinct().join(flagged, key, "left")
                 .groupBy(model).agg(count(F.col("_pos")).alias("tp"), count(1 - F.col("_pos")).alias("fp")))
    conf = per_model.select(model, "tp", "fp", (n_neg - F.col("fp")).alias("tn"),
                            (n_pos - F.col("tp")).alias("fn"))
    return metrics(conf)


def truth_positions(entries: DataFrame, matches: DataFrame, entry: str = "entry", length: str = "len",
                    ranges: str = "matches") -> DataFrame:
    """Entries left-joined with their match ranges -> positive positions
    (half-open ranges), negative = 1..len-1 minus positives, and match flag.

    Output rows: (entry, pos, is_pos) for every position in positive ∪ negative,
    plus (entry, match) available through ``truth_summary``.
    """
    m = matches.select(entry, parse_ranges(F.col(ranges)).alias("_r"))
    joined = entries.select(entry, length).join(m, entry, "left")
    pos = (joined.select(entry, F.explode("_r").alias("_iv"))
           .select(entry, F.col("_iv.start").alias("seq_start"), F.col("_iv.end").alias("seq_end")))
    positives = to_positions(pos, keep=[entry]).distinct()
    universe = (entries.where(F.col(length) > 1)
                .select(entry, F.explode(F.sequence(F.lit(1), F.col(length) - 1)).alias("pos")))
    return (universe.select(entry, "pos", F.lit(0).alias("p"))
            .unionByName(positives.select(entry, "pos", F.lit(1).alias("p")))
            .groupBy(entry, "pos").agg(F.max("p").alias("is_pos")))


def truth_summary(entries: DataFrame, matches: DataFrame, entry: str = "entry", length: str = "len",
                  ranges: str = "matches") -> DataFrame:
    """I6 per entry: numbers of positive / negative positions and the match flag.

    Interval arithmetic on the merged truth runs (no positions materialised):
    positive = |T|, negative = |[1, len)| - |T ∩ [1, len)|.
    """
    from annospark.operators.intervals import merge_intervals
    ents = entries.select(entry, F.col(length).alias("_len"))
    runs = merge_intervals(truth_intervals(entries, matches, entry, length, ranges), [entry]).join(ents, entry)
    inside = F.greatest(F.lit(0), F.least(F.col("e"), F.col("_len")) - F.greatest(F.col("s"), F.lit(1)))
    s = runs.groupBy(entry).agg(F.sum(F.col("e") - F.col("s")).cast("long").alias("_pos"),
                                F.sum(inside).cast("long").alias("_in"))
    full = F.greatest(F.col("_len") - 1, F.lit(0)).cast("long")
    zero = F.lit(0).cast("long")
    return (ents.join(s, entry, "left")
            .select(entry, F.coalesce("_pos", zero).alias("n_positive"),
                    (full - F.coalesce("_in", zero)).alias("n_negative"))
            .withColumn("match", F.col("n_positive") > 0))


def set_union_summary(hits: DataFrame, entry: str = "entry") -> DataFrame:
    """J3 per entry without materialising positions: size, first and last
    position of the union of the hits' position sets."""
    from annospark.operators.intervals import merge_intervals
    runs = merge_intervals(hits.select(entry, "seq_start", "seq_end"), [entry])
    return runs.groupBy(entry).agg(F.sum(F.col("e") - F.col("s")).cast("long").alias("n_positions"),
                                   F.min("s").alias("min_pos"), (F.max("e") - 1).alias("max_pos"))


def set_union_positions(hits: DataFrame, entry: str = "entry") -> DataFrame:
    """Union of the position sets of all hits of an entry -> (entry, pos)."""
    return to_positions(hits.select(entry, "seq_start", "seq_end"), keep=[entry]).distinct()


def position_confusion(pred_hits: DataFrame, truth_pos: DataFrame, entry: str = "entry",
                       group: Sequence[str] = ()) -> DataFrame:
    """I4: per entry (and group) position-level confusion + metrics.

    ``pred_hits``: (group..., entry, seq_start, seq_end); ``truth_pos``: output of
    ``truth_positions`` (entry, pos, is_pos).  Entries of the predictions
    without truth rows get zero counts and null metrics.
    """
    g = list(group)
    pp = to_positions(pred_hits.select(*g, entry, "seq_start", "seq_end"), keep=[*g, entry]).distinct()
    ents = pred_hits.select(*g, entry).distinct()
    tr = ents.join(truth_pos, entry)
    tagged = (tr.select(*g, entry, "pos", F.lit(1).alias("u"), F.col("is_pos").alias("p"), F.lit(0).alias("pp"))
              .unionByName(pp.select(*g, entry, "pos", F.lit(0).alias("u"), F.lit(0).alias("p"),
                                     F.lit(1).alias("pp"))))
    flags = (tagged.groupBy(*g, entry, "pos")
             .agg(F.max("u").alias("in_u"), F.max("p").alias("in_p"), F.max("pp").alias("in_pp")))
    conf = confusion_from_flags(flags, [*g, entry])
    return metrics(conf)


def truth_intervals(entries: DataFrame, matches: DataFrame, entry: str = "entry", length: str = "len",
                    ranges: str = "matches") -> DataFrame:
    """I6 as intervals: (entry, seq_start, seq_end) of the match ranges of known entries."""
    m = matches.select(entry, F.explode(parse_ranges(F.col(ranges))).alias("_iv"))
    return (m.join(entries.select(entry), entry, "left_semi")
            .select(entry, F.col("_iv.start").alias("seq_start"), F.col("_iv.end").alias("seq_end")))


def position_confusion_intervals(pred_hits: DataFrame, truth: DataFrame, entries: DataFrame, entry: str = "entry",
                                 length: str = "len", group: Sequence[str] = ()) -> DataFrame:
    """I4 without materialising positions (same result as ``position_confusion``).

    One coverage sweep per (group, entry) over two kinds of +/- events:
    predicted intervals P and truth intervals T.  Between consecutive event
    positions the membership is constant, so each segment adds its length to
    tp (P∩T) or fn (T−P), and its part inside the sequence range L = [1, len)
    to fp (P∩L−T); tn (L−T−P) is the rest of L — the reference's sets with
    U = L ∪ T.  Events are summed per position first, so the ordered window
    per key holds at most one row per distinct endpoint (bounded by the
    sequence length, whatever the number of hits), and one before them that
    carries the length.  Entries unknown to ``entries`` contribute no T and no
    L: zero counts, null metrics.
    """
    g = list(group)
    keys = pred_hits.select(*g, entry).distinct()

    def ends(s: Column, e: Column, kind: str) -> Column:
        event = lambda sign, pos: F.struct(pos.alias("p"), F.lit(sign if kind == "P" else 0).alias("dp"), F.lit(sign if kind == "T" else 0).alias("dt"))
        return F.when(e > s, F.array(event(1, s), event(-1, e)))
    known = entries.select(entry, F.col(length).alias("_len"))
    nothing = F.lit(None).cast(dict(entries.dtypes)[length]).alias("_len")
    held = truth.join(known.select(entry), entry, "left_semi")
    # the truth and the length of an entry, once for all of its groups
    given = (held.select(entry, F.inline(ends(F.col("seq_start"), F.col("seq_end"), "T")), nothing)
             .unionByName(known.select(entry, F.lit(None).cast("int").alias("p"), F.lit(0).alias("dp"), F.lit(0).alias("dt"), "_len")))
    zero = F.lit(0)
    # a key that is given nothing keeps its row
    events = (pred_hits.select(*g, entry, F.inline(ends(F.col("seq_start"), F.col("seq_end"), "P")), nothing)
              .unionByName(keys.join(given, entry, "left").select(*g, entry, "p", F.coalesce("dp", zero).alias("dp"),
                                                                  F.coalesce("dt", zero).alias("dt"), "_len"))
              .groupBy(*g, entry, "p").agg(F.sum("dp").alias("dp"), F.sum("dt").alias("dt"), F.max("_len").alias("_len")))
    w = Window.partitionBy(*g, entry).orderBy("p")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    # the row without a place comes first
    seg = events.select(*g, entry, "p", F.sum("dp").over(run).alias("cp"), F.sum("dt").over(run).alias("ct"),
                        F.first("_len").over(run).alias("_len"), F.lead("p").over(w).alias("np"))
    named = F.lit(True)
    for c in (*g, entry):   # keys that are null hold no positions
        named = named & F.col(c).isNotNull()
    in_p, in_t = F.col("cp") > 0, F.col("ct") > 0
    whole = (F.col("np") - F.col("p")).cast("long")
    inside = F.when(F.col("_len").isNotNull(), F.greatest(F.lit(0), F.least("np", "_len") - F.greatest(F.col("p"), F.lit(1)))).cast("long")
    part = lambda c, size: F.coalesce(F.sum(F.when(named & c, size)), F.lit(0).cast("long"))
    full = F.when(named, F.greatest(F.lit(0), F.col("_len") - 1).cast("long"))
    conf = seg.groupBy(*g, entry).agg(part(in_p & in_t, whole).alias("tp"), part(in_p & ~in_t, inside).alias("fp"),
                                      (F.coalesce(F.max(full), F.lit(0).cast("long")) - part(in_p | in_t, inside)).alias("tn"),
                                      part(in_t & ~in_p, whole).alias("fn"))
    return metrics(conf)


def metric_distribution(per_entry: DataFrame, metric_cols: Sequence[str] = ("precision", "recall", "accuracy",
                                                                            "weighted_accuracy"),
                        group: Sequence[str] = ("model",)) -> DataFrame:
    """Per group and metric: min, q1, median, q3, max, mean (nulls dropped).

    Exact without a buffer for each group: equal values are counted, the counts
    are dealt by range of (group, metric, value) and summed within each range
    and over the ranges before it, which gives the ranks that a value holds;
    the values at the ranks of a quantile are interpolated linearly.
    """
    g = [*group, "metric"]
    pairs = ", ".join(f"'{m}', CAST({m} AS DOUBLE)" for m in metric_cols)
    long = per_entry.select(*group, F.expr(f"stack({len(metric_cols)}, {pairs}) AS (metric, value)"))
    counts = long.where(F.col("value").isNotNull()).groupBy(*g, "value").agg(F.count(F.lit(1)).alias("_c"))
    # written, so that a row's range stays the same for all readers
    ranged = cut_lineage(counts.repartitionByRange(*g, "value").withColumn("_range", F.spark_partition_id()))
    earlier = Window.partitionBy(*g).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (ranged.groupBy(*g, "_range").agg(F.sum("_c").alias("_n"))
              .select(*g, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
                      F.sum("_n").over(Window.partitionBy(*g)).alias("_all")))
    inside = Window.partitionBy(*g, "_range").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (ranged.withColumn("_upto", F.sum("_c").over(inside)).join(ranges, [*g, "_range"])
              .withColumn("_end", F.col("_before") + F.col("_upto")))

    def at(rank: Column) -> Column:
        held = (F.col("_end") - F.col("_c") <= rank) & (rank < F.col("_end"))
        return F.max(F.when(held, F.col("value")))

    def quantile(q: float) -> Column:
        place = F.lit(q) * (F.col("_all") - 1)
        low, high = at(F.floor(place)), at(F.ceil(place))
        return low + F.max(place - F.floor(place)) * (high - low)
    names = ["min", "q1", "median", "q3", "max"]
    n = F.sum("_c")
    return ranked.groupBy(*g).agg(*[quantile(q).alias(name) for q, name in zip(PERCENTILES, names, strict=True)],
                                  (F.sum(F.col("value") * F.col("_c")) / n).alias("mean"), n.alias("n"))


def first_per_group(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One value per identical key tuple (the smallest, so the choice is deterministic)."""
    return df.groupBy(*keys).agg(F.min(value).alias(value))


def structure_coverage(dom: DataFrame, struct: DataFrame, lengths: DataFrame, entry: str = "entry") -> DataFrame:
    """Every (domain, structure) pair of an entry with precision, recall, F1.

    dom: (entry, seq_start, seq_end and any other keys, such as the model); struct: (entry, struct_id, s_start, s_end);
    lengths: (entry, len).  Interval arithmetic replaces the position sets:
    U = [1, len) ∪ S;  tp = |D ∩ S|;  fp = |S - D|;  fn = |D ∩ U| - tp;
    precision = tp / (tp + fp), recall = tp / (tp + fn), F1 = 2pr / (p + r).
    """
    return _pair_metrics(dom.join(struct, entry).join(lengths, entry), entry)


def overlapping_coverage(dom: DataFrame, struct: DataFrame, lengths: DataFrame, entry: str = "entry") -> DataFrame:
    """I7 for the pairs that share a position: all pairs with a recall above 0, by a distributed sweep where an
    entry has many, without the product of its domains and structures."""
    return _pair_metrics(swept_pairs(dom, struct, entry).drop("inter").join(lengths, entry), entry)


def _pair_metrics(pairs: DataFrame, entry: str) -> DataFrame:
    s_len = F.greatest(F.lit(0), F.col("s_end") - F.col("s_start"))
    inter = F.greatest(F.lit(0), F.least("seq_end", "s_end") - F.greatest("seq_start", "s_start"))
    # |D ∩ [1, len)|
    d_in_range = F.greatest(F.lit(0), F.least(F.col("seq_end"), F.col("len")) - F.greatest(F.col("seq_start"), F.lit(1)))
    # |D ∩ S ∩ [1, len)|
    ds_in_range = F.greatest(F.lit(0), F.least(F.col("seq_end"), F.col("s_end"), F.col("len"))
                             - F.greatest(F.col("seq_start"), F.col("s_start"), F.lit(1)))
    d_in_u = d_in_range + inter - ds_in_range
    tp = inter.cast("double")
    fp = (s_len - inter).cast("double")
    fn = (d_in_u - inter).cast("double")
    prc = F.try_divide(tp, tp + fp)
    rec = F.try_divide(tp, tp + fn)
    keys = [c for c in pairs.columns if c not in ("s_start", "s_end", "len")]
    out = pairs.select(*keys, prc.alias("precision"), rec.alias("recall"))
    f1 = F.try_divide(2.0 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.withColumn("f1", f1)


def covering_structures(cov: DataFrame, threshold: float = 0.8, entry: str = "entry", group: Sequence[str] = ()) -> DataFrame:
    """I8: structures covering at least ``threshold`` of a domain: counts of
    rows, distinct entries and distinct structure ids, for each ``group`` (such
    as the model).  Above 0, the pairs of ``overlapping_coverage`` are enough."""
    kept = coverage_filter(cov, threshold)
    return kept.groupBy(*group).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(entry).alias("n_entries"),
                                    F.count_distinct("struct_id").alias("n_structures"))
