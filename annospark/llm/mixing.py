"""Mixing sources to target weights: Efraimidis-Spirakis sampling.

Every document gets an exponential key -ln(u) / q, with u a hash of its id and
q its quality weight; within a source the documents in ascending key order are
a weighted sample without replacement of every length.  A source's budget is
first spent on complete epochs, the rest on the documents at the head of that order.

Defined results: a null text has size 0 and quality 1; a null source is a source
of its own, last in order; rows that repeat (same id and text) share a key, and
as many of them are taken as the budget holds; an empty table gives an empty mix; columns of the
input other than doc_id, text and source are carried, never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annospark.llm.common import prefix_sums, word_count, written

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the whole mix, as a share of all words; cap of a source's repetition.
SHARE, CAP = 1.5, 2
SEED = "mix-1"
SYMBOLS = "#*$%&|<>"


def quality(text: Column) -> Column:
    """Quality weight in (0, 1]: falls with the share of symbol characters."""
    n = F.length(text)
    symbols = n - F.length(F.translate(text, SYMBOLS, ""))
    plain = F.when(n > 0, 1.0 - symbols / n).otherwise(F.lit(1.0))
    return F.greatest(F.lit(0.05), F.coalesce(plain * plain, F.lit(1.0)))


def sampling_key(doc_id: Column, weight: Column, seed: str = SEED) -> Column:
    """-ln(u) / weight, u in (0, 1) from 52 bits of md5(id, seed)."""
    digest = F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(seed)).cast("binary"))
    bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double")
    return -F.log((bits + 0.5) / F.lit(float(1 << 52))) / weight


def sized(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    return docs.select("doc_id", "source", word_count(text).alias("size"),
                       sampling_key(F.col("doc_id"), quality(text)).alias("key"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("tie"),
                       F.xxhash64("text").alias("copy"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
                   cap: int = CAP) -> DataFrame:
    """source, source_size, target: shares by weight, capped, the excess reshared.

    Resharing until no target is above its cap ends at min(cap, weight * level)
    with one level for all; the level is read off prefix sums over the sources in
    the order in which they reach their caps.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("last", F.col("source").isNull()).withColumn("one", F.lit(1).cast("long"))
    per = prefix_sums(per, ["last", "source"], "one", "place", name="mix-sources")
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]),
                          (F.col("place") % len(weights) + 1).cast("int"))
    per = (per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * cap)
           .withColumn("full_at", F.col("cap") / F.col("weight")))
    order = ["full_at", "place"]
    per = prefix_sums(per, order, "cap", "caps", name="mix-caps")
    per = written(prefix_sums(per, order, "weight", "weights", name="mix-weights"), "mix-levels")
    total = per.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first()
    if total is None or total["w"] is None:
        return per.select("source", "source_size", F.lit(0.0).alias("target"))
    goal, all_weight = share * total["s"], total["w"]
    rest, open_weight = F.lit(goal) - F.col("caps"), F.lit(all_weight) - F.col("weights")
    level = (per.where(F.col("cap") * open_weight >= F.col("weight") * rest)
             .agg(F.min(F.struct(*order, (rest / open_weight).alias("level")))["level"]).first()[0])
    shared = F.col("weight") * F.lit(level) if level is not None else F.col("cap").cast("double")
    return per.select("source", "source_size",
                      F.least(F.col("cap").cast("double"), shared).alias("target"))


def mix_plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
             cap: int = CAP) -> DataFrame:
    """One row a source: target, whole epochs, the last (key, tie, copy) of the fractional epoch, the repeats of
    it (rows of the same id and text) and how many of them go in."""
    targets = written(source_targets(sizes, weights, share, cap)
                      .withColumn("epochs", F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))),
                                                       F.lit(0)).cast("long"))
                      .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-targets")
    order = ["key", "tie", "copy"]
    # repeats are one row, so that they do not fill one range
    grouped = (sizes.groupBy("source", *order).agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("repeats"))
               .withColumn("bulk", F.col("size") * F.col("repeats")))
    running = prefix_sums(grouped, order, "bulk", "before", ["source"], "mix-order")
    s, t = running.alias("s"), targets.alias("t")

    def fits(k: Column) -> Column:
        """A repeat with k before it goes in if more than half of it is below the budget."""
        return F.col("before") + k * F.col("size") + F.col("size") / 2.0 < F.col("rest")
    about = F.ceil((F.col("rest") - F.col("before")) / F.nullif(F.col("size"), F.lit(0)) - 0.5)
    # the quotient may be one off where it is rounded; all of no size fit if one does
    about = F.when(fits(about), about + 1).when(~fits(about - 1), about - 1).otherwise(about)
    going = F.least(F.col("repeats"), F.coalesce(about, F.col("repeats")))
    head = (s.join(t, F.col("s.source").eqNullSafe(F.col("t.source"))).where(fits(F.lit(0)))
            .groupBy("s.source").agg(F.max(F.struct(*order, going.cast("long").alias("going"), "repeats")).alias("last")))
    h = head.alias("h")
    plan = (t.join(h, F.col("t.source").eqNullSafe(F.col("h.source")), "left")
            .select("t.source", "source_size", "target", "epochs", F.when(F.col("last").isNotNull(), F.struct(
                *[F.col("last")[c].alias(c) for c in order])).alias("cut"), F.col("last.going"), F.col("last.repeats")))
    # written, so that its size is known when documents join it: a small plan is broadcast and no document is shuffled
    return written(plan, "mix-plan")


def with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds to ``rows`` (__source, __at: key, tie, copy) the columns of their source's plan and __copies, how often
    the mix repeats each row."""
    p = plan.withColumnRenamed("source", "__of")
    joined = rows.join(p, F.col("__source").eqNullSafe(F.col("__of"))).drop("__of")
    chosen = F.coalesce(F.col("__at") <= F.col("cut"), F.lit(False))
    done = joined.withColumn("__copies", F.col("epochs") + chosen.cast("long"))
    if plan.where("going < repeats").isEmpty():
        return done
    # a budget ends inside repeats: they are written with numbers of their own, and the first ones go in
    split = F.coalesce((F.col("__at") == F.col("cut")) & (F.col("going") < F.col("repeats")), F.lit(False))
    some = written(joined.where(split).withColumn("__id", F.monotonically_increasing_id()), "mix-repeats")
    numbers = prefix_sums(some.select("__source", "__id", "going", F.lit(1).cast("long").alias("__one")), ["__id"], "__one",
                          "__before", ["__source"], "mix-numbers")
    last = written(numbers.where("__before < going").groupBy(F.col("__source").alias("__of"))
                   .agg(F.max("__id").alias("__last")), "mix-last")
    some = (some.join(last, F.col("__source").eqNullSafe(F.col("__of")), "left")
            .withColumn("__copies", F.col("epochs") + F.coalesce(F.col("__id") <= F.col("__last"), F.lit(False)).cast("long")))
    return done.where(~split).unionByName(some.select(*done.columns))


def mixed_sizes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: how often the mix repeats each document."""
    sizes = written(sized(docs), "mix-sizes")
    keyed = sizes.select("doc_id", F.col("source").alias("__source"), "size", F.struct("key", "tie", "copy").alias("__at"))
    return (with_copies(keyed, mix_plan(sizes, **options))
            .select("doc_id", F.col("__source").alias("source"), "size", "source_size", "target", F.col("__copies").alias("copies"),
                    (F.col("__copies") * F.col("size")).alias("taken")))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as its source's plan says.

    The plan holds one row a source, so no text is shuffled unless the plan is
    too large to broadcast, when Spark splits hot sources of the join.
    """
    sizes = written(sized(docs), "mix-sizes")
    columns = docs.columns
    keyed = docs.select(F.struct(*columns).alias("__row"), F.col("source").alias("__source"),
                        F.struct(sampling_key(F.col("doc_id"), quality(F.col("text"))).alias("key"),
                                 F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("tie"),
                                 F.xxhash64("text").alias("copy")).alias("__at"))
    return (with_copies(keyed, mix_plan(sizes, **options))
            .withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("__copies").cast("int"))))
            .select(*[F.col("__row")[c].alias(c) for c in columns]))
