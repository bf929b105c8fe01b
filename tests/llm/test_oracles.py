import duckdb
import pandas as pd
import pytest

from critpath.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want, got = con.execute(registry.ORACLE_SQL[name]).df(), registry.QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda df: sorted(tuple("-" if pd.isna(x) else x if isinstance(x, str) else round(float(x), 9) for x in r) for r in df[columns].itertuples(index=False))
    assert rows(got) == rows(want)
