"""Driver queries of the tidying operators against their SQL."""

import duckdb
import pytest

from lathe.plans import catalog, more_queries  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    rows = duck.sql(catalog.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(rows.columns)
    want = rows.select(*(f'"{c}"' for c in columns)).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.select(*columns).collect())
