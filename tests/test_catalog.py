"""Every registered query against its SQL twin, and its shape."""

from __future__ import annotations

import math

import duckdb
import pytest

from lodestrata.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return repr(value)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_twin(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    rows = got.collect()
    sql = catalog.oracle_sql().get(name)
    if not sql:
        assert got.columns
        return
    cursor = duck.execute(sql)
    names = [x[0] for x in cursor.description]
    kinds = {x[0]: str(x[1]).upper() for x in cursor.description}
    want = cursor.fetchall()
    assert sorted(names) == sorted(got.columns)
    assert {k: TYPES[v] for k, v in got.dtypes} == {k: v.split("(")[0] for k, v in kinds.items()}
    order = sorted(names)
    have = sorted([plain(r[c]) for c in order] for r in rows)
    assert have == sorted([plain(r[names.index(c)]) for c in order] for r in want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(catalog.queries()) <= set(e.queries())
