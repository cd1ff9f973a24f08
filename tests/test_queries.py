import os

import duckdb
import pytest

import __spark_entry__ as entry
from likeness import queries as library


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    connection.execute("SET timezone = 'UTC'")
    for name in os.listdir(sf_dir):
        connection.execute(f"CREATE VIEW {name.split('.')[0]} AS FROM '{sf_dir}/{name}'")
    return connection


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n in library.QUERIES or n.startswith("op")])
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    df = entry.queries()[name](spark, sf_dir)
    result = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(repr([row[columns.index(c)] for c in sorted(columns)]) for row in result.fetchall())
    assert sorted(repr([row[c] for c in sorted(columns)]) for row in df.collect()) == want


@pytest.mark.parametrize("name", [n for n in library.QUERIES if n not in library.ORACLE_SQL])
def test_queries_without_sql_run(spark, sf_dir, name):
    assert library.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_combined_duplicates_drop_near_groups_that_exact_ones_cover(spark, sf_dir):
    rows = library.QUERIES["combined_duplicates"](spark, sf_dir).collect()
    exact = {p for r in rows if r.kind == "exact" for p in r.paths.split("|")}
    assert exact and [r.kind for r in rows].count("near") > 0 and all(set(r.paths.split("|")) - exact for r in rows if r.kind == "near")
