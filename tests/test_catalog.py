"""Every registered query against its SQL twin, on the smallest tables."""

import os

import duckdb
import pytest

from quillwork.plans import catalog, catalog_extras, catalog_fixes, catalog_flows, catalog_grammar, catalog_more, catalog_reports, catalog_sources  # noqa: F401

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from read_parquet('{SF}/{t}')")
    return con


def norm(row):
    return tuple(round(x, 6) if isinstance(x, float) else x for x in row)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_matches_sql(spark, tables, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(map(norm, df.select(columns).collect()), key=str)
    listed = ", ".join(f'"{c}"' for c in columns)
    want = sorted(map(norm, tables.sql(f"select {listed} from ({catalog.ORACLE[name]}) z").fetchall()), key=str)
    assert got == want
    assert got
