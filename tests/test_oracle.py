"""Every registered query against its SQL in DuckDB, row by row."""

import math
from collections import Counter
from datetime import date, datetime

import duckdb
import pytest

from tables import DATA
from hackney.plans.oracle import oracle_sql
from hackney.plans.registry import queries

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"create view {table} as select * from '{DATA}/sf0.01/{table}.parquet'")
    return connection


def comparable(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    return value


def bag(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(comparable(row[i]) for i in order) for row in rows)


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("name", sorted(queries()))
def test_same_rows(name, spark, duck):
    frame = queries()[name](spark, f"{DATA}/sf0.01")
    result = duck.sql(oracle_sql()[name])
    assert sorted(frame.columns) == sorted(result.columns)
    ours, theirs = bag(frame.columns, frame.collect()), bag(result.columns, result.fetchall())
    assert sum(ours.values()) > 0
    assert not (ours - theirs), f"only in Spark: {list((ours - theirs).items())[:3]}; only in SQL: {list((theirs - ours).items())[:3]}"
    assert not (theirs - ours), f"only in SQL: {list((theirs - ours).items())[:3]}"


INTEGERS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
            "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


@pytest.mark.parametrize("name", sorted(queries()))
def test_same_types(name, spark, duck):
    frame = queries()[name](spark, f"{DATA}/sf0.001")
    result = duck.sql(oracle_sql()[name])
    ours = {column: INTEGERS[kind] for column, kind in frame.dtypes}
    assert ours == dict(zip(result.columns, map(str, result.types)))
