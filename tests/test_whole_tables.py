"""Queries read whole tables: no id subset in a query or its SQL, and scaling has all components."""

import re
from pathlib import Path

import duckdb
import numpy as np
import pytest

from quillspan.plans import suite

from test_queries import DATA

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no input tables")

#: Subsets that are the feature: every twentieth vector as a query, and rows played as orphans or empty segments.
FEATURES = {"knn_graph", "align_stats"}


@pytest.mark.parametrize("name", sorted(set(suite.ORACLES) - FEATURES))
def test_sql_has_no_id_subset(name):
    assert not re.search(r"WHERE[^()]*_id % (?!11 <> 0)", suite.ORACLES[name])


def test_standard_scale_has_all_components(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{DATA}/embeddings.parquet' ORDER BY vec_id").fetchall()
    x = np.array([r[1] for r in rows], float)
    want = (x - x.mean(axis=0)) / x.std(axis=0)
    got = suite.QUERIES["standard_scale"](spark, DATA).orderBy("vec_id").collect()
    assert [r["vec_id"] for r in got] == [r[0] for r in rows]
    assert np.allclose([[r[f"x{i}"] for i in range(64)] for r in got], want, atol=1e-5)
