"""The driver contract on the smallest tables: every query runs and gives the rows of its SQL twin.

All queries take a quarter of an hour, so a run takes the first of six parts
unless ``QUERY_SHARD`` names another, such as ``4/6``, or all: ``1/1``.
"""

import os
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from threadloom.plans.registry import ORACLE, QUERIES

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
import compare  # noqa: E402

DATA = Path("/root/testdata/sf0.001")
tables = pytest.mark.skipif(not DATA.exists(), reason="no driver tables")
PART, PARTS = map(int, os.environ.get("QUERY_SHARD", "1/6").split("/"))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@tables
def test_flagship_query(spark):
    df = contract.entry(spark)
    assert df.count() > 0 and "total_activity" in df.columns


@tables
@pytest.mark.parametrize("name", sorted(QUERIES)[PART - 1 :: PARTS])
def test_query_gives_the_rows_of_its_twin(spark, con, name):
    df = QUERIES[name](spark, str(DATA))
    assert len(set(df.columns)) == len(df.columns)
    got = compare.sorted_rows(df.columns, df.collect())
    if name not in ORACLE:
        return
    cursor = con.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == compare.sorted_rows(columns, cursor.fetchall())
