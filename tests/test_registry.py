"""Every registered query against its DuckDB oracle, on the smallest tables."""

import os

import duckdb
import pytest

from sparquill.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


def canon(rows):
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(repr(tuple(map(plain, r))) for r in rows)


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    cursor = duck.execute(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({ORACLES[name]})")
    assert canon(df.select(*[f"`{c}`" for c in columns]).collect()) == canon(cursor.fetchall())
    assert sorted(duck.execute(f"describe ({ORACLES[name]})").df()["column_name"]) == columns


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).collect()
