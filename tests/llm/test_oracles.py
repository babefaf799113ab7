import duckdb
import pytest

from tidelag.llm import entry

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in got.description]
    df = entry.queries()[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(names)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, df.select(*names).collect())) == sorted(map(key, got.fetchall()))
