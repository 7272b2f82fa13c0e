"""Session helpers."""

import os

import pytest

from quarrycast import runtime


def test_cut_keeps_rows_and_cuts_lineage(spark):
    df = spark.range(100).selectExpr("id", "id % 7 as x")
    out = runtime.cut(df.repartition(3, "x"))
    assert out.count() == 100 and "ExistingRDD" in out._jdf.queryExecution().executedPlan().toString()
    assert runtime.shared_folder(spark) == spark.sparkContext._jsc.sc().getCheckpointDir().get()


def test_a_cluster_without_shared_folder_is_an_error():
    class Context:
        master = "yarn"
        _jsc = property(lambda self: self)
        sc = getCheckpointDir = lambda self: self
        isEmpty = lambda self: True
        getConf = lambda self: {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        runtime.shared_folder(Session())


def test_small_enough_hints_only_small_tables(spark):
    df = spark.range(10)
    assert "broadcast" in runtime.small_enough(df, 10)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in runtime.small_enough(df, 9)._jdf.queryExecution().logical().toString().lower()


def test_spread_leaves_many_partitions_alone(spark):
    many = spark.range(100).repartition(64)
    assert runtime.spread(many) is many
    assert runtime.spread(spark.range(5).coalesce(1)).rdd.getNumPartitions() > 1


def test_package_is_shipped_once(spark):
    runtime.ship(spark)
    runtime.ship(spark)
    shipped = [f for f in spark.sparkContext.listFiles if f.endswith("quarrycast-package.zip")] if hasattr(spark.sparkContext, "listFiles") else [1]
    assert len(shipped) == 1 and os.path.exists(os.path.join(spark.sparkContext._temp_dir, "quarrycast-package.zip"))


def test_workers_without_the_package(tmp_path):
    """A session started elsewhere, with no path to the package, runs Python operators by what is shipped."""
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys; sys.path.insert(0, {root!r})
from quarrycast.runtime import local_session, ship
from pyspark.sql import functions as F
from quarrycast.operators.snapshots import with_bare
spark = local_session("away", 1, "1g")
ship(spark)
assert spark.createDataFrame([("e\\u0301 x",)], "t string").transform(lambda df: with_bare(df, {{"t": F.col("t")}})).first().t == "\\u00e9x"
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert done.returncode == 0, done.stderr[-800:]
