"""Every query with SQL gives the SQL's rows."""

import math

import pytest

from tidemark.plans import catalog


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 8)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v.isoformat() if hasattr(v, "isoformat") else v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, sf, oracle, name):
    df = catalog.queries()[name](spark, sf)
    said = oracle.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(said.columns)
    assert rows(df.columns, df.collect()) == rows(said.columns, said.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, sf, name):
    catalog.queries()[name](spark, sf).collect()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
