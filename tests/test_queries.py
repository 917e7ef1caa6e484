"""Every registered query with SQL gives what DuckDB gives on the same tables."""

import datetime
import decimal
from pathlib import Path

import duckdb
import numpy as np
import pytest

from provspark.plans import adapt, q_functions, q_graph, q_metrics, q_scoring, q_serving, q_streaming, registry  # noqa: F401

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the test tables are not here")


def plain(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(map(plain, x))
    if hasattr(x, "item"):
        x = x.item()
    if x is None or (isinstance(x, float) and x != x) or str(x) in ("NaT", "<NA>"):
        return None
    if isinstance(x, (bool, decimal.Decimal)):
        x = float(x)
    if isinstance(x, datetime.datetime):
        return str(x)  # to the microsecond
    return round(float(x), 6) if isinstance(x, (int, float)) and abs(x) < 1e15 else x


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in adapt.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(name, spark, db):
    ours, theirs = registry.QUERIES[name](spark, SF).toPandas(), db.execute(registry.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
