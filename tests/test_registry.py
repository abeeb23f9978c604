"""Every registered query against its SQL on the smallest tables, and the shape of its plan."""

import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from tidetally.registry.queries import QUERIES
from tidetally.registry.sql import SQL
from tidetally.session import discard, keep

SF_DIR = Path("/root/testdata/sf0.001")
TYPES = {
    "string": "VARCHAR",
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
}
# What must not be in a plan: Python per row, pairs without a key, a window over everything.
UNWANTED = r"EvalPython|InPandas|CartesianProduct|BroadcastNestedLoopJoin|Window \[[^]]*\], \[\]"


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for file in SF_DIR.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def test_every_query_has_its_sql():
    assert QUERIES.keys() == SQL.keys()
    assert QUERIES.items() <= contract.queries().items()
    assert SQL.items() <= contract.oracle_sql().items()


def comparable(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([row[i] for i in order]) for row in rows)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, database, name):
    df = QUERIES[name](spark, str(SF_DIR))
    rows = df.collect()
    result = database.execute(SQL[name])
    columns = {d[0]: str(d[1]) for d in result.description}
    assert {n: TYPES[t] for n, t in df.dtypes} == columns
    assert comparable(rows, df.columns) == comparable(result.fetchall(), list(columns))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(UNWANTED, plan)


def test_entry(spark):
    assert contract.entry(spark).columns == ["section", "key", "measure", "value"]


def test_kept_tables_can_be_discarded(spark):
    table = keep(spark.range(10).toDF("n"), "some")
    other = keep(table.where("n > 3"), "other")
    assert Path(table.kept_at).exists()
    discard(table)
    assert not Path(table.kept_at).exists() and other.count() == 6
    discard()
