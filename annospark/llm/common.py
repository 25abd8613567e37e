"""Helpers shared by the operators: tables, written intermediates, distributed
prefix sums and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annospark.session import ensure_checkpoint_dir

#: Word pattern of the whole subpackage: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    Cuts lineage so that it survives lost executors, and keeps columns prunable.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unsized(df: DataFrame) -> DataFrame:
    """``df`` for a join that must not broadcast either side.

    Spark takes exploded rows to be as many as there were before, and columns of a
    file to be as large as they are compressed, so a table that outgrows the driver
    may pass for a small one.
    """
    return df.hint("merge")


def word_count(text: Column) -> Column:
    """Number of words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def prefix_sums(df: DataFrame, order: list[str], value: str, out: str, group: list[str] | None = None,
                name: str = "prefix") -> DataFrame:
    """Exclusive running sum ``out`` of ``value`` in ``order``, within ``group`` if given.

    Rows are dealt by range of (group, order), so that a hot group spans many
    tasks; each range is summed on its own and the sums of earlier ranges (one
    row for each range and group in it) are added.
    """
    group = group or []
    ranged = written(df.repartitionByRange(*group, *order).withColumn("__range", F.spark_partition_id()), name)
    near = Window.partitionBy("__range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (ranged.groupBy("__range", *group).agg(F.sum(value).alias("__part"))
               .withColumn("__offset", F.coalesce(F.sum("__part").over(before), F.lit(0))).drop("__part"))
    local = ranged.withColumn("__local", F.coalesce(F.sum(value).over(near), F.lit(0))).alias("l")
    same = F.col("l.__range") == F.col("o.__range")
    for g in group:
        same = same & F.col(f"l.{g}").eqNullSafe(F.col(f"o.{g}"))
    return (local.join(offsets.alias("o"), same)
            .select(*[F.col(f"l.{c}") for c in df.columns], (F.col("l.__local") + F.col("o.__offset")).alias(out)))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of undirected ``edges`` (a, b: long).

    Output: one row (node, root) for every node with an edge, root being the
    smallest node of its component.  Every round each node hooks onto its smallest
    neighbour, hooks are shortened once, and the graph is contracted; at least
    half of the nodes with edges vanish each round, so the rounds are
    logarithmic in the number of nodes.  All state is in written tables.
    """
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                    .distinct(), f"{name}-edges")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("low")).select(
            F.col("a").alias("node"), F.least("a", "low").alias("up"))
        hook = written(hook, f"{name}-hook")
        jump = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
        step = written(hook.join(jump, "up").select("node", F.col("top").alias("root")), f"{name}-step")
        maps.append(step)
        left = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = written(edges.join(left, "a").join(right, "b").where("ra <> rb")
                        .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(),
                        f"{name}-edges")
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # nodes absent from a later round keep the root they had
    out = maps[-1]
    for earlier in reversed(maps[:-1]):
        later = out.select(F.col("node").alias("root"), F.col("root").alias("top"))
        out = earlier.join(later, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return out
