"""Every registered query against the SQL that says the same, or for its rows alone."""

from __future__ import annotations

import pytest

import __spark_entry__
from inkwarden import assurance, evaluations, queries

assert assurance and evaluations


def rows(names, table):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(float(r[i]) if isinstance(r[i], float) else r[i] for i in order)) for r in table)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, duck, name):
    found = queries.QUERIES[name](spark, sf_dir)
    got = [tuple(r) for r in found.collect()]
    assert got
    if name in queries.ORACLE:
        cursor = duck.execute(queries.ORACLE[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == sorted(found.columns)
        assert rows(found.columns, got) == rows(names, cursor.fetchall())


def test_entry(spark):
    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_gives_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0
