"""Every query with SQL gives the rows of its SQL; the others give rows."""

from __future__ import annotations

import pytest
from compare import same

from readloom import queries as Q

SQL = Q.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, data, name):
    same(Q.queries()[name](spark, data), SQL[name], data)


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(SQL)))
def test_gives_rows(spark, data, name):
    assert Q.queries()[name](spark, data).limit(1).count() == 1


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 4
    assert set(entry.oracle_sql()) <= set(entry.queries())
