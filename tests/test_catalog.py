"""Every query with a SQL twin gives the same rows in DuckDB."""

import os

import duckdb
import pytest

from marginalia import catalog

QUERIES, ORACLES = catalog.QUERIES | catalog.HAND_QUERIES, catalog.ORACLES | catalog.HAND_ORACLES
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    connection = duckdb.connect()
    connection.execute("SET timezone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, db, name):
    found = QUERIES[name](spark, FOLDER)
    columns = sorted(found.columns)
    rows = sorted(tuple(map(repr, r)) for r in found.select(*columns).collect())
    wanted = db.execute(ORACLES[name])
    names = [d[0] for d in wanted.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows == sorted(tuple(repr(r[i]) for i in order) for r in wanted.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_what_only_tests_run_has_a_twin_over_the_tables():
    assert set(catalog.TWINS.values()) <= set(catalog.QUERIES) and not set(catalog.TWINS) & set(catalog.QUERIES)
