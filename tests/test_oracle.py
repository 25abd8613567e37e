"""Every registered query against its DuckDB oracle SQL on the sf0.001 tables."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))
SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")

import __spark_entry__ as E  # noqa: E402
from annospark.plans import catalog  # noqa: E402
from check_oracle import TABLES, canon  # noqa: E402

NAMES = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF)
    cols = df.columns
    rows = [tuple(r) for r in df.collect()]
    cur = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(cols) == sorted(dcols)
    types = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}
    stypes = dict(df.dtypes)
    for d in cur.description:
        assert types.get(str(d[1]), str(d[1])) == stypes[d[0]], (d[0], d[1], stypes[d[0]])
    assert len(rows) == len(drows)
    assert canon(rows, cols) == canon(drows, dcols)


def test_every_query_has_oracle():
    # of the library; training-data operators without SQL have tests of their own
    assert set(catalog.REGISTRY) <= set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="driver tables not present")
def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "p_value" in df.columns and "score" in df.columns
