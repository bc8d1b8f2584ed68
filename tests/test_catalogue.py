"""Every query with SQL against DuckDB, on the driver's smallest tables."""

from pathlib import Path

import pytest

from siftrock.plans import catalogue

DATA = Path("/root/testdata/sf0.001")
SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def same(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


def test_every_query_has_sql():
    assert set(SQL) == set(catalogue.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, str(DATA))
    want = duck.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert same(map(tuple, got.select(*names).collect())) == same(want.fetchall())
