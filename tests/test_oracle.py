"""Every registered query with an oracle equals its DuckDB SQL at sf0.001.

The same comparison as ``scripts/check_oracle.py`` (the driver's gate runs it
at sf0.01): column names, row count and order-insensitive values (doubles to
6 places).
"""

import functools

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF001
from scripts.check_oracle import rows_of
from semdex.plans import registry
from semdex.sources.testdata import TABLES

SQL = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module", autouse=True)
def shared_inputs():
    """Vocabulary, index and candidates are built once for all queries of this module."""
    kept = registry.Inputs, registry.WeightInputs
    registry.Inputs, registry.WeightInputs = map(functools.lru_cache(maxsize=None), kept)
    yield
    registry.Inputs, registry.WeightInputs = kept


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF001)
    plan = plan_of(df)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
    got = df.toPandas()
    want = con.execute(SQL[name]).df()
    cs, rs = rows_of(got)
    cd, rd = rows_of(want)
    assert cs == cd
    assert len(rs) == len(rd)
    assert rs == rd
