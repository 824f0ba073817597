"""The queries that SQL can express, against it, over whole tables."""

import pytest

from quire.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import oracle_rows, rows_of, types_of

SAME = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, sf_dir, name):
    found = QUERIES[name](spark, sf_dir)
    assert rows_of(found) == oracle_rows(ORACLE_SQL[name], sf_dir)
    assert {c: SAME.get(t, t) for c, t in found.dtypes} == types_of(ORACLE_SQL[name], sf_dir)
