"""Every query with SQL gives what its SQL gives, on the smallest tables; branches aren't vacuous."""

import os

import duckdb
import pytest

from quarrycast.plans import registry


def norm(v):
    if v is None or str(v) in ("NaT", "<NA>", "None", "nan"):
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return str(int(v)) if v == int(v) else repr(round(v, 6))
    return str(v)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in sorted(os.listdir(data)):
        con.execute(f"create view {f[:-8]} as select * from '{data}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, data, duck, name):
    mine = registry.QUERIES[name](spark, data).toPandas()
    theirs = duck.execute(registry.SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    cols = sorted(mine.columns)
    table = lambda d: sorted([tuple(map(norm, r)) for r in d[cols].itertuples(index=False, name=None)], key=str)
    assert table(mine) == table(theirs)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs_without_sql(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() > 0


@pytest.mark.parametrize("name,least", [("X1_round_stage", 5), ("F16_gate", 2), ("M1_kind", 2), ("X2_currency", 2), ("W2_diagnosis", 1), ("R4_domain_matches", 2)])
def test_branches_are_met(spark, data, name, least):
    df = registry.QUERIES[name](spark, data)
    assert df.select(df.columns[-1]).distinct().count() >= least


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
