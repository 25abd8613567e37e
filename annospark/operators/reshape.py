"""Projections, filters, predicates and array reshaping.

All are column expressions or explode/inline generators: no Python per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIT_COLUMNS = ("entry_ac", "seq_start", "seq_end", "e_value")


# ----------------------------------------------------------------- B
def project_hits(df: DataFrame, entry: str, start: str, end: str, evalue: str) -> DataFrame:
    """B1: subset + rename to (entry_ac, seq_start, seq_end, e_value), typed."""
    return df.select(F.col(entry).cast("string").alias("entry_ac"),
                     F.col(start).try_cast("int").alias("seq_start"),
                     F.col(end).try_cast("int").alias("seq_end"),
                     F.col(evalue).try_cast("double").alias("e_value"))


def evalue_filter(df: DataFrame, threshold: float = 0.001, col: str = "e_value") -> DataFrame:
    """B2: keep rows with e-value strictly below ``threshold`` (unparseable -> dropped)."""
    return df.where(F.col(col).try_cast("double") < F.lit(float(threshold)))


def membership_flag(col: str | Column, member: str, sep: str = ";") -> Column:
    """True when ``member`` is an item of the ``sep``-terminated list; null -> False."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.array_contains(F.split(c, sep), F.lit(member)), F.lit(False))


def split_by_flag(df: DataFrame, flag: str) -> tuple[DataFrame, DataFrame]:
    """(rows with flag, rows without)."""
    return df.where(F.col(flag)), df.where(~F.col(flag))


def not_null_filter(df: DataFrame, col: str) -> DataFrame:
    """Rows having a value in ``col``."""
    return df.where(F.col(col).isNotNull())


def strip_list_terminator(c: Column, sep: str = ";") -> Column:
    """Drop separators and surrounding blanks ('9606.ENSP1;' -> '9606.ENSP1')."""
    return F.trim(F.regexp_replace(c, F.lit(sep), F.lit("")))


def drop_last_char(c: Column) -> Column:
    """Remove the trailing character (e.g. a list terminator)."""
    return F.when(F.length(c) > 0, c.substr(F.lit(1), F.length(c) - 1)).otherwise(c)


def strip_db_prefix(c: Column, sep: str = ":") -> Column:
    """B6: 'DOID:1234' -> '1234' (the field after the first ``sep`` up to the
    next one; the value is unchanged when ``sep`` is absent)."""
    return F.when(F.instr(c, sep) > 0, F.split_part(c, F.lit(sep), F.lit(2))).otherwise(c)


def normalise_id(c: Column) -> Column:
    """Trimmed, lower-cased identifier."""
    return F.lower(F.trim(c))


def coverage_filter(df: DataFrame, threshold: float = 0.8, col: str = "recall") -> DataFrame:
    """Rows with ``col`` not null and >= threshold."""
    return df.where(F.col(col).isNotNull() & (F.col(col) >= threshold))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Distinct values of a column (nulls dropped)."""
    return df.select(col).where(F.col(col).isNotNull()).distinct()


# ----------------------------------------------------------------- D
def explode_list(df: DataFrame, col: str, sep: str = ";", out: str | None = None,
                 keep: Sequence[str] = ()) -> DataFrame:
    """``sep``-separated list -> one row per non-empty, trimmed item."""
    items = F.filter(F.transform(F.split(F.col(col), sep), lambda x: F.trim(x)), lambda x: x != "")
    return df.select(*keep, F.explode(items).alias(out or col))


def extract_bracketed(df: DataFrame, col: str, entry: str = "entry", prefix: str = "GO:",
                      id_out: str = "go_id", descr_out: str = "go_descr") -> DataFrame:
    """D2: 'descr A [GO:1]; descr B [GO:2]' -> rows (entry, 1, descr A), (entry, 2, descr B).

    An item ends at its bracket, so a description may hold the separator; ids
    come without the prefix; text without a bracketed id gives no row.
    """
    item = rf"(?:^|;)\s*((?:(?!\[{prefix}).)*?)\s*\[{prefix}(.+?)\]"
    descr = F.regexp_extract_all(F.col(col), F.lit(item), 1)
    ids = F.regexp_extract_all(F.col(col), F.lit(item), 2)
    return df.select(entry, F.inline(F.arrays_zip(ids.alias(id_out), descr.alias(descr_out))))


def architecture_key(c: Column, sep: str = ";") -> Column:
    """D3: family list -> sorted, de-duplicated, ``sep``-joined key (null when empty)."""
    items = F.filter(F.transform(F.split(c, sep), lambda x: F.trim(x)), lambda x: x != "")
    key = F.array_join(F.array_sort(F.array_distinct(items)), sep)
    return F.when(F.size(items) > 0, key)


def parse_ranges(c: Column) -> Column:
    """D4: 'a..b,c..d' -> array<struct<start:int,end:int>> of half-open ranges [a, b).

    Empty or null text gives an empty array.
    """
    parts = F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x) != "")
    return F.transform(parts, lambda x: F.struct(
        F.get(F.split(F.trim(x), r"\.\."), F.lit(0)).try_cast("int").alias("start"),
        F.get(F.split(F.trim(x), r"\.\."), F.lit(1)).try_cast("int").alias("end")))


def to_positions(df: DataFrame, start: str = "seq_start", end: str = "seq_end", out: str = "pos",
                 keep: Sequence[str] | None = None) -> DataFrame:
    """Interval [start, end) -> one row per position start..end-1; empty intervals vanish."""
    cols = list(keep) if keep is not None else [c for c in df.columns if c not in (start, end)]
    return (df.where(F.col(end) > F.col(start))
            .select(*cols, F.explode(F.sequence(F.col(start), F.col(end) - 1)).alias(out)))


def complement_positions(universe_len: Column, positives: Column) -> Column:
    """Positions 1..len-1 not in ``positives`` (array column; null: none); a length below 2 has no positions."""
    none = F.array().cast("array<int>")
    universe = F.when(universe_len > 1, F.sequence(F.lit(1), universe_len - 1)).otherwise(none)
    return F.array_except(universe, F.coalesce(positives, none))


def positions_to_range(df: DataFrame, keys: Sequence[str], pos: str = "pos") -> DataFrame:
    """(keys, pos) -> seq_start = min, seq_end = max of the kept positions."""
    return df.groupBy(*keys).agg(F.min(pos).alias("seq_start"), F.max(pos).alias("seq_end"))


def code_prefixes(c: Column, names: Sequence[str] = ("class", "architecture", "topology", "homologous"),
                  sep: str = ".") -> list[Column]:
    """D8: 'c.a.t.h' -> [c, c.a, c.a.t, c.a.t.h] (one column per level)."""
    return [F.when(c.isNotNull(), F.substring_index(c, sep, i + 1)).alias(n) for i, n in enumerate(names)]


def join_list(c: Column, sep: str = "; ") -> Column:
    """List -> ``sep``-joined text; null stays null."""
    return F.when(c.isNotNull(), F.array_join(c.cast("array<string>"), sep))


def match_flag(ranges: Column) -> Column:
    """At least one positive range."""
    return F.coalesce(F.size(ranges) > 0, F.lit(False))
