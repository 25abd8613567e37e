"""Session construction and lineage-cutting helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "annospark") -> SparkSession:
    """Session with AQE (coalescing + skew join) on.

    Under a launcher (spark-submit) its master, memory and partitions hold;
    ``master`` defaults to ``local[$BENCH_CPUS or *]`` only without one.
    """
    builder = SparkSession.builder.appName(app_name)
    launched = "PYSPARK_GATEWAY_PORT" in os.environ
    if master is None and not launched and not os.environ.get("SPARK_MASTER"):
        master = f"local[{os.environ.get('BENCH_CPUS', '*')}]"
    if master:
        builder = builder.master(master)
    parts = shuffle_partitions or os.environ.get("ANNOSPARK_SHUFFLE_PARTITIONS")
    if parts:
        builder = builder.config("spark.sql.shuffle.partitions", str(parts))
    if not launched:
        builder = builder.config("spark.driver.memory", os.environ.get("ANNOSPARK_DRIVER_MEMORY", "16g"))
    builder = (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``.

    A private folder, removed at exit, is made only when nothing is configured
    and all runs in one process (tests); on a cluster an unset directory is an
    error, because a machine-local folder does not survive executor loss.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder for iterative jobs")
    folder = tempfile.mkdtemp(prefix="annospark-ckpt-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (written to the shared checkpoint folder)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
