"""Every registered query with a SQL twin gives the same rows on both engines at the smallest scale."""

import math
from pathlib import Path

import duckdb
import pytest

from ledgerloom import catalog

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")
TWINS = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def rows(names, got):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in got), key=repr)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_equals_twin(spark, duck, name):
    df = catalog.queries()[name](spark, str(DATA))
    want = duck.sql(TWINS[name])
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(TWINS)))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, str(DATA)).count() >= 0
