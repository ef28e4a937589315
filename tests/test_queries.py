"""Every registered query of the library against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from plantlists import catalog
from tests.oracle import FOLDER, rows_of_spark, rows_of_sql

_QUERIES, _SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(_SQL))
def test_query_equals_sql(spark, name: str) -> None:
    df = _QUERIES[name](spark, FOLDER)
    names, expected = rows_of_sql(_SQL[name])
    assert sorted(df.columns) == names
    assert rows_of_spark(df) == expected


@pytest.mark.parametrize("name", sorted(set(_QUERIES) - set(_SQL)))
def test_query_runs(spark, name: str) -> None:
    assert _QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark) -> None:
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(__spark_entry__.queries())
