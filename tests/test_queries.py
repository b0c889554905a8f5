"""Every query that has SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def tidy(rows):
    clean = [tuple(0.0 if isinstance(v, float) and v == 0 else v for v in r) for r in rows]
    return sorted(clean, key=lambda r: tuple((v is None, 0 if v is None else v) for v in r))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_every_lattice_query_has_sql():
    missing = {q for q in entry.queries() if q not in entry.oracle_sql()}
    assert not {q for q in missing if not q.startswith("op") and q != "pipeline"}


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.execute(entry.oracle_sql()[name])
    order = [[c[0] for c in found.description].index(c) for c in columns]
    expected = tidy(tuple(r[i] for i in order) for r in found.fetchall())
    rows = tidy(map(tuple, df.select(columns).collect()))
    assert len(rows) == len(expected)
    for a, b in zip(rows, expected, strict=True):
        assert a == b or all(math.isclose(x, y, abs_tol=1e-6) if isinstance(x, float) and isinstance(y, float) else x == y for x, y in zip(a, b, strict=True))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
