"""Repeated rows at the end of a source's budget."""

from __future__ import annotations

import pytest

from annospark.llm import mixing
from annospark.llm.queries import MIX_SQL


def _rows() -> list[tuple]:
    rows = [(i, "abc"[i % 3], "word " * (3 + i % 5)) for i in range(60)]
    rows += [(k, "abc"[k % 3], "word " * (3 + k % 5)) for k in range(0, 60, 2) for _ in range(40)]
    return [*rows, *[(100, None, "x y z")] * 25, (101, None, None), (101, None, None), (102, "d", ""), (102, "d", "")]


def _sorted(rows) -> list[tuple]:
    return sorted((tuple(r) for r in rows), key=str)


def test_repeats_are_taken_one_by_one_as_in_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    documents = duckdb.connect()
    documents.execute("CREATE TABLE documents(doc_id BIGINT, source VARCHAR, text VARCHAR)")
    documents.executemany("INSERT INTO documents VALUES (?, ?, ?)", _rows())
    df = spark.createDataFrame(_rows(), "doc_id long, source string, text string").repartition(5)
    out = mixing.mixed_sizes(df).selectExpr("doc_id", "source", "size", "source_size", "round(target, 6) target", "taken").collect()
    assert _sorted(out) == _sorted(documents.execute(MIX_SQL).fetchall())


def test_mix_misses_its_target_by_half_a_document(spark):
    df = spark.createDataFrame(_rows(), "doc_id long, source string, text string").repartition(5)
    sizes = mixing.mixed_sizes(df).groupBy("source").agg({"taken": "sum", "target": "max", "size": "max"}).collect()
    own = {}
    for r in mixing.mix(df).collect():
        own[r["source"]] = own.get(r["source"], 0) + len((r["text"] or "").split())
    for r in sizes:
        assert own.get(r["source"], 0) == r["sum(taken)"]
        assert abs(r["sum(taken)"] - r["max(target)"]) <= r["max(size)"] / 2
