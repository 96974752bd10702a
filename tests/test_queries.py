"""Every registered query of the library against its SQL twin over the smallest tables, and literal vectors of single functions."""

import os

import duckdb
import pytest

from hazardspark import plans


def cell(x):
    if isinstance(x, float):
        return f"{x:.6g}" if x == x else "nan"
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(cell, x)) + "]"
    if hasattr(x, "isoformat") and hasattr(x, "hour"):
        return x.replace(tzinfo=None).isoformat()
    return cell(float(x)) if type(x).__name__ == "Decimal" else str(x)


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in found)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    df = plans.queries()[name](spark, sf_dir)
    got = duck.execute(plans.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(got.fetchall(), columns)


def test_entry():
    import __spark_entry__

    assert set(plans.oracle_sql()) <= set(plans.queries()) <= set(__spark_entry__.queries())
