"""Every registered query that has SQL gives the rows that DuckDB gives for it."""

from pathlib import Path

import duckdb
import pytest

from matrixlake.plans import queries

TABLES = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="the given tables are absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in TABLES.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(value):
    return float(value) if isinstance(value, (int, float)) else value


@pytest.mark.parametrize("name", queries.ORACLES)
def test_query_matches_its_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, str(TABLES))
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    want = duck.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == cols
    assert got == sorted(repr([plain(dict(zip(names, r, strict=True))[c]) for c in cols]) for r in want.fetchall())
