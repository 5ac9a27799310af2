"""Every query that has SQL, against DuckDB over the same tables."""

import decimal
import math
from pathlib import Path

import duckdb
import pytest

from marlstone.plans import audit_queries, operator_queries  # noqa: F401  they register queries
from marlstone.plans import queries as plans


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return [plain(x) for x in value]
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([[plain(r[i]) for i in order] for r in rows], key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def test_sql_names_are_queries():
    assert set(plans.ORACLE) <= set(plans.QUERIES)


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_equals_sql(spark, sf_dir, duck, name):
    out = plans.QUERIES[name](spark, sf_dir)
    want = duck.execute(plans.ORACLE[name])
    names = [d[0] for d in want.description]
    assert table(out.columns, [tuple(r) for r in out.collect()]) == table(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE)))
def test_query_without_sql_runs(spark, sf_dir, name):
    out = plans.QUERIES[name](spark, sf_dir)
    assert len(out.columns) == len(set(out.columns)) and out.count() >= 0
