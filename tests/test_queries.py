"""Every registered query of the engine against DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from critpath.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
SLOW = {"mcsp_multi_pass", "mcsp_overlay_bi", "mcsp_overlay_uni", "mcsp_bucketed", "mcsp_bidirectional"}  # tests/test_search.py has smaller cases


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("lineitem", "part", "events"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(df, columns):
    return sorted(tuple("-" if pd.isna(x) else x if isinstance(x, str) else round(float(x), 6) for x in r) for r in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(set(ORACLE_SQL) - SLOW))
def test_query(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(want, columns)


def test_partitions_of_the_grid(spark):
    got = QUERIES["graph_partition"](spark, SF).collect()
    assert len({r.v for r in got}) == len(got) == 200 and sorted(r.pos for r in got) == list(range(200))
    assert [r.pid for r in sorted(got, key=lambda r: r.pos)] == sorted(r.pid for r in got)
    order = {r.v: r.pos for r in QUERIES["preorder"](spark, SF).collect()}
    assert {r.v: r.pos for r in QUERIES["euler_ranks"](spark, SF).collect()} == order


def test_entry_module():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(QUERIES) <= set(e.queries())
