"""Every registered query: runs on sf0.001 and equals its DuckDB oracle (rows, columns, values)."""

import pytest

import __spark_entry__ as E
from outreach_spark.plans.registry import REGISTRY
from tests.conftest import SF_SMALL
from tests.oracle import compare, duck

KEYS = sorted(REGISTRY)
SQL = {k: sql for k, (_, sql) in REGISTRY.items() if sql is not None}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(SQL) == set(KEYS) <= set(E.queries())


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    df = REGISTRY[key][0](spark, SF_SMALL)
    compare(df, con, SQL[key])


def test_entry_flagship(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["id", "full_name", "email", "lead_score", "reply_sentiment", "channel", "rank_score"]
    assert len(rows) == 10
    scores = [r.rank_score for r in rows]
    assert scores == sorted(scores, reverse=True)


SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
                 "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


@pytest.mark.parametrize("key", KEYS)
def test_query_types_match_oracle(spark, con, key):
    sdf = REGISTRY[key][0](spark, SF_SMALL)
    s_types = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in sdf.schema.fields}
    rel = con.sql(SQL[key])
    assert s_types == {n: str(t) for n, t in zip(rel.columns, rel.types)}
