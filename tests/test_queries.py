"""Every registered query against plain SQL on the same tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from conftest import TESTDATA
from treeledger.catalog import expected
from treeledger.catalog import queries as catalog

SF = os.path.join(TESTDATA, os.environ.get("TEST_SF", "sf0.001"))


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return connection


def test_each_query_has_its_check():
    assert catalog.queries().keys() == expected.oracle_sql().keys()
    assert entry_points.oracle_sql().keys() <= entry_points.queries().keys()


def test_entry_gives_rows(spark):
    assert entry_points.entry(spark).count() > 0


@pytest.mark.parametrize("name", entry_points.oracle_sql())
def test_query(spark, database, name):
    frame = entry_points.queries()[name](spark, SF)
    found = [tuple(row) for row in frame.select(*sorted(frame.columns)).collect()]
    relation = database.sql(entry_points.oracle_sql()[name])
    types = {"VARCHAR": "string", "INTEGER": "int"}
    wanted_types = {c: types.get(str(t), str(t).lower()) for c, t in zip(relation.columns, relation.types)}
    assert wanted_types == dict(frame.dtypes)
    places = [relation.columns.index(column) for column in sorted(frame.columns)]
    wanted = [tuple(row[place] for place in places) for row in relation.fetchall()]
    key = lambda row: [(value is None, str(value)) for value in row]
    assert sorted(found, key=key) == sorted(wanted, key=key)
    assert found
