"""Every registered query that has SQL gives the same rows as DuckDB."""

import os

import duckdb
import pytest

from graphloom.plans.oracles import ORACLE_SQL
from graphloom.plans.queries import QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    d = duckdb.connect()
    for name in os.listdir(sf_dir):
        d.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return d


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(map(repr, frame[columns].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    ours, theirs = QUERIES[name](spark, sf_dir).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    for frame in (ours, theirs):
        for c in frame.columns:
            if str(frame[c].dtype).startswith("datetime"):
                frame[c] = frame[c].astype("datetime64[us]")
            elif c in ("ratio_bin", "edges"):
                frame[c] = frame[c].astype("float64")
    assert rows(ours) == rows(theirs)


def test_every_oracle_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)
