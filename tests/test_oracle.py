"""Every registered query with SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

from listwright import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(rows, columns):
    order = sorted(columns)

    def value(v):
        if isinstance(v, float):
            return None if v != v else round(v, 6)
        return str(v) if v is not None and not isinstance(v, (int, bool)) else v

    return sorted(repr([value(r[columns.index(c)]) for c in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    found = duck.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain(got, df.columns) == plain(found.fetchall(), columns)
