"""Result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "csv", sep: str = "\t", mode: str = "overwrite") -> None:
    """Tab-separated text with header (or parquet)."""
    w = df.write.mode(mode)
    if fmt == "parquet":
        w.parquet(path)
    else:
        w.option("sep", sep).option("header", True).csv(path)


def write_partitioned(df: DataFrame, path: str, by: str, fmt: str = "csv", sep: str = "\t",
                      mode: str = "overwrite", rows_per_file: int = 1_000_000) -> None:
    """One directory per value of ``by`` (e.g. per architecture), with one file for up to ``rows_per_file`` rows.

    The rows of each value are counted first; only a value with more rows is
    salted (by content, so a retried task sees the same rows) and written by
    several tasks.  Only the values that ``df`` holds are replaced.
    """
    files = df.groupBy(F.col(by).alias("_by")).agg(F.ceil(F.count(F.lit(1)) / rows_per_file).alias("_files"))
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.col("_files"))
    dealt = df.join(files, F.col(by).eqNullSafe(F.col("_by"))).withColumn("_salt", salt)
    w = (dealt.repartition(F.col(by), F.col("_salt")).select(*df.columns).write.mode(mode)
         .option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_per_file).partitionBy(by))
    if fmt == "parquet":
        w.parquet(path)
    else:
        w.option("sep", sep).option("header", True).csv(path)
