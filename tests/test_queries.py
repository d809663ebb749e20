"""Every query runs on the smallest tables; those with SQL give what DuckDB gives."""

import datetime
import decimal
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from quillstat import queries


def plain(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((k, plain(y)) for k, y in x.items()))
    if x is None or x is pd.NaT or x is pd.NA:
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (int, float, np.integer, np.floating, decimal.Decimal)):
        return None if x != x else float(f"{float(x):.7g}")
    return str(pd.Timestamp(x)) if isinstance(x, (datetime.date, datetime.datetime)) else str(x)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted((tuple(plain(v) for v in r) for r in frame.itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    own = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        own.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return own


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    if name in queries.ORACLE_SQL:
        (names, mine), (columns, theirs) = rows(got), rows(duck.execute(queries.ORACLE_SQL[name]).df())
        assert names == columns and len(mine) == len(theirs)
        for a, b in zip(mine, theirs, strict=True):  # the engines round halves of inexact means apart
            assert all(x == y or (isinstance(x, float) and x == pytest.approx(y, rel=1e-6, abs=1.1e-4)) for x, y in zip(a, b, strict=True)), (a, b)


def test_every_sql_has_a_query():
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
