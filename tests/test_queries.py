"""Every registered query runs at sf0.001 and, where it has one, equals its DuckDB oracle."""
from __future__ import annotations

import math
from collections import Counter

import duckdb
import pytest

from conftest import SF_SMOKE
from facetspark.plans.catalog import TABLES
from facetspark.plans.queries import ORACLES, QUERIES


_DUCK = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "FLOAT": "float",
         "BOOLEAN": "boolean"}


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _bag(cols, rs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(cols), Counter(tuple(_norm(r[i]) for i in order) for r in rs)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMOKE}/{t}.parquet')")
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMOKE)
    srows = df.collect()
    if name not in ORACLES:
        assert len(srows) > 0
        return
    rel = duck.sql(ORACLES[name])
    dtypes = {c: _DUCK.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types)}
    assert {f.name: f.dataType.simpleString() for f in df.schema.fields} == dtypes
    assert _bag(df.columns, srows) == _bag(rel.columns, rel.fetchall())


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["id", "supergroup", "group", "module", "brand"]
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
