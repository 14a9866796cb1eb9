"""Every query with SQL against DuckDB on the smallest tables, column by column."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from histlens.plans import bindings


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    return float(f"{value:.9g}") if isinstance(value, float) else value


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(v[i]) for i in order) for v in values), key=repr)


@pytest.fixture(scope="module")
def duck(small):
    connection = duckdb.connect()
    for file in Path(small).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


@pytest.mark.parametrize("name", sorted(bindings.ORACLES))
def test_matches_sql(spark, duck, small, name):
    ours = bindings.QUERIES[name](spark, small)
    theirs = duck.execute(bindings.ORACLES[name])
    columns = [d[0] for d in theirs.description]
    assert sorted(ours.columns) == sorted(columns)
    assert rows(ours.columns, [tuple(r) for r in ours.collect()]) == rows(columns, theirs.fetchall())


def test_every_query_has_an_oracle():
    assert set(bindings.QUERIES) == set(bindings.ORACLES)


def test_entry_gives_one_bundle(spark, small):
    found = entry.entry(spark).collect()
    assert len(found) == 1 and found[0]["json"].startswith("{") and len(found[0]["content_hash"]) == 64
