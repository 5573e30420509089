"""Every query with SQL gives the same rows in DuckDB; the others run."""

import math
from pathlib import Path

import duckdb
import pytest

from quillspan.plans import suite

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no input tables")


def norm(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else round(v, 4) + 0.0
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(suite.ORACLES))
def test_same_rows(spark, duck, name):
    df = suite.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr([norm(r[c]) for c in columns]) for r in df.collect())
    cursor = duck.execute(suite.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    want = sorted(repr([norm(r[i]) for i in place]) for r in cursor.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(suite.QUERIES) - set(suite.ORACLES) - {"cv_summary"}))
def test_runs(spark, name):
    assert suite.QUERIES[name](spark, DATA).count() > 0
