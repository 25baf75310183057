"""Every named query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from votescore import oracles
from votescore.functions import score
from votescore.oracles import ORACLES
from votescore.queries import QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in os.listdir(sf_dir):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS FROM '{sf_dir}/{name}'")
    return connection


def ordered(rows):
    return sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = [tuple(row[names.index(c)] for c in columns) for row in found.fetchall()]
    assert ordered(map(tuple, frame.select(*columns).collect())) == ordered(want)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_thresholds_of_the_sql_are_those_of_the_score():
    assert oracles.THRESHOLDS == score.THRESHOLDS
