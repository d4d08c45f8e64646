import re

import __spark_entry__ as E
from outreach_spark.llm.queries import ORACLE_SQL, QUERIES


def test_all_operators_and_the_pipeline_are_registered():
    assert [int(re.match(r"op(\d+)_", k)[1]) for k in QUERIES] == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(E.queries())


def test_oracles_are_statements_of_registered_queries():
    assert set(ORACLE_SQL) <= set(QUERIES) and all(isinstance(s, str) for s in E.oracle_sql().values())
