import glob
import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(names, values):
    order = [names.index(c) for c in sorted(names)]
    return sorted(tuple(repr(float(r[i])) if isinstance(r[i], float) else str(r[i]) for i in order) for r in values)


def _names():
    from strandlight.plans.oracle import ORACLE_SQL

    return list(ORACLE_SQL)


@pytest.mark.parametrize("name", _names())
def test_query_equals_sql(spark, duck, name):
    from strandlight.plans.oracle import ORACLE_SQL
    from strandlight.plans.queries import QUERIES

    found = QUERIES[name](spark, SF)
    cursor = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(found.columns)
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(names, cursor.fetchall())


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
