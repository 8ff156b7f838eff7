from pathlib import Path

import __spark_entry__ as entry
import duckdb
import pytest

SF = "/root/testdata/sf0.001"


def test_names_are_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for t in sorted(p.stem for p in Path(SF).glob("*.parquet")):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    cols = list(want.columns)
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    assert order(entry.queries()[name](spark, SF).select(*cols).collect()) == order(want.fetchall())
