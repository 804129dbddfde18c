"""The driver's contract, and every registered query against its SQL on the smallest tables."""

import importlib
import sys

import duckdb
import numpy as np
import pytest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DIR = "/root/testdata/sf0.001"

import __spark_entry__ as entry  # noqa: E402
from loomtrace.plans import ORACLES, QUERIES  # noqa: E402


def cell(v):
    if isinstance(v, (list, np.ndarray)):
        return str([cell(x) for x in v])
    if v is None or str(v) in ("NaT", "<NA>", "nan"):
        return None
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    return repr(round(float(v), 6)) if isinstance(v, (int, float, np.number)) else str(v)


def rows(frame):
    return sorted((tuple(cell(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, db, name):
    got, want = QUERIES[name](spark, DIR).toPandas(), db.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_give_rows(spark, name):
    assert QUERIES[name](spark, DIR).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_without_the_optional_parts(monkeypatch):
    monkeypatch.setattr(entry, "find_spec", lambda name: None)
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLES)
    monkeypatch.undo()
    assert importlib.reload(sys.modules["__spark_entry__"]).queries().keys() >= QUERIES.keys()
