"""Every registered query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as contract

SF_DIR = "/root/testdata/sf0.001"
ORACLE, QUERIES = contract.oracle_sql(), contract.queries()


@pytest.fixture(scope="module")
def database():
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables")
    connection = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def table(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    clean = [tuple(None if isinstance(r[i], float) and math.isnan(r[i]) else r[i] for i in order) for r in rows]
    return sorted(columns), sorted(clean, key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, database, name):
    result = database.execute(ORACLE[name])
    expected = table(result.fetchall(), [c[0] for c in result.description])
    df = QUERIES[name](spark, SF_DIR)
    assert table(map(tuple, df.collect()), df.columns) == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_runs(spark, database, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark, database):
    assert contract.entry(spark).columns == ["article_id", "section_idx", "section_id", "document", "summary", "abstract"]
