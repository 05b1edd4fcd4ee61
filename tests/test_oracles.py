"""Every query with SQL equals it on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from gaugefleet.plans import catalog

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, str(DATA))
    cursor = db.execute(catalog.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(map(plain, r)) for r in cursor.fetchall())
