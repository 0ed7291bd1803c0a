"""Every query with SQL against DuckDB over the smallest tables, where they are."""

from pathlib import Path

import duckdb
import pytest

from bandweave.queries import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "lineitem", "orders"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    ours, theirs = QUERIES[name](spark, str(DATA)).toPandas(), con.execute(ORACLES[name]).df()
    columns = sorted(ours)
    assert columns == sorted(theirs)
    ours, theirs = (d[columns].sort_values(columns).reset_index(drop=True) for d in (ours, theirs))
    assert ours.equals(theirs)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    if DATA.exists():
        assert entry.entry(spark).columns == ["r_id", "s_id", "r_key", "s_key", "probe_ts"]
