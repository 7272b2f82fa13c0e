"""The subpackage's queries run on the smallest tables and match their SQL; nothing else imports the subpackage."""

import os
import re

import duckdb
import pytest

from quarrycast.llm import queries
from tests.test_oracle import norm


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, data, name):
    mine = queries.QUERIES[name](spark, data).toPandas()
    assert len(mine)
    if name in queries.SQL:
        con = duckdb.connect()
        for f in os.listdir(data):
            con.execute(f"create view {f[:-8]} as select * from '{data}/{f}'")
        theirs = con.execute(queries.SQL[name]).df()
        cols = sorted(theirs.columns)
        table = lambda d: sorted([tuple(map(norm, r)) for r in d[cols].itertuples(index=False, name=None)], key=str)
        assert table(mine) == table(theirs)


def test_nothing_else_imports_it():
    import quarrycast

    root = os.path.dirname(quarrycast.__file__)
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f), encoding="utf-8") as x:
                    assert not re.search(r"(?:from|import)\s+quarrycast\.llm|from\s+quarrycast\s+import\s+.*\bllm\b", x.read()), f
