"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from conftest import SF


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_equals_sql(spark, tmp_path, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    __spark_entry__.queries()[name](spark, SF).write.parquet(str(tmp_path / "got"))
    con.sql(f"create table want as {__spark_entry__.oracle_sql()[name]}")
    columns = sorted(x[0] for x in con.sql("select column_name from (describe want)").fetchall())
    assert columns == sorted(x[0] for x in con.sql(f"select column_name from (describe select * from '{tmp_path}/got/*.parquet')").fetchall())
    names = ", ".join(f'"{c}"' for c in columns)
    for a, b in (("want", f"'{tmp_path}/got/*.parquet'"), (f"'{tmp_path}/got/*.parquet'", "want")):
        assert con.sql(f"select count(*) from (select {names} from {a} except all select {names} from {b})").fetchall() == [(0,)]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
