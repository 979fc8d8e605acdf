"""Every query with an SQL twin gives the twin's rows; the others give rows."""

import pytest
from conftest import SF, plain

from mutalake.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    assert rows
    if name in ORACLES:
        found = duck.sql(ORACLES[name])
        assert sorted(found.columns) == columns
        order = [found.columns.index(c) for c in columns]
        assert plain(rows) == plain([tuple(r[i] for i in order) for r in found.fetchall()])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["file", "function", "cyclomatic", "coverage", "crap"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
