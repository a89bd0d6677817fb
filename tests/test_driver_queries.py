"""Every driver query against its SQL in DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from dexlake.plans import built, driver, roundtrip  # noqa: F401


@pytest.fixture(scope="module")
def oracle(sf_dir):
    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(driver.QUERIES))
def test_query_equals_sql(spark, oracle, sf_dir, name):
    found = driver.QUERIES[name](spark, sf_dir)
    said = oracle.sql(driver.SQL[name])
    assert sorted(found.columns) == sorted(said.columns)
    names = sorted(found.columns)
    mine = sorted(tuple(map(repr, (r[c] for c in names))) for r in found.collect())
    places = [said.columns.index(c) for c in names]
    assert mine == sorted(tuple(repr(r[i]) for i in places) for r in said.fetchall())


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
