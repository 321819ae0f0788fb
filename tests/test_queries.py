"""Every registered query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from citeflow.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    out = [tuple(tuple(r[k]) if isinstance(r[k], list) else r[k] for k in order) for r in found]
    return sorted(out, key=lambda x: tuple((v is None, str(v)) for v in x))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, duck, name):
    frame, answer = catalog.QUERIES[name](spark, SF), duck.sql(catalog.ORACLES[name])
    assert sorted(frame.columns) == sorted(answer.columns)
    assert rows(frame.columns, frame.collect()) == rows(answer.columns, answer.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["sender_community", "target_community", "n", "proportion"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
