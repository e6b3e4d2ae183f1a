"""Every registered query of the core with a SQL twin gives the twin's rows on the smallest tables."""

import importlib
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_points

FAMILIES = [importlib.import_module(f"draftloom.plans.{name}") for name in entry_points._FAMILIES]
QUERIES = {n: f for m in FAMILIES for n, f in m.QUERIES.items()}
ORACLE = {n: s for m in FAMILIES for n, s in m.ORACLE.items()}


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA:
        return ""
    if isinstance(x, bool) or type(x).__name__ == "bool_":
        return str(bool(x))
    try:
        return "" if x != x else repr(round(float(x), 5) + 0.0)
    except (TypeError, ValueError):
        return str(x)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(plain(x) for x in r) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{sf_dir}/{file}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf_dir, duck, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns
    df.count()
