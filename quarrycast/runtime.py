"""Session, table and lineage helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings the operators rely on; cluster settings given elsewhere stay as they are.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",  # checkpoints go with the DataFrames that hold them
}


def local_session(name: str = "quarrycast", cpus: int | str = "*", memory: str = "8g") -> SparkSession:
    """A session for one machine, as used by tests and bench."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName(name).config(map=DEFAULTS)
    b = b.config("spark.driver.memory", memory).config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8")
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session, once, so that they need no copy of their own."""
    sc = spark.sparkContext
    if getattr(sc, "_quarrycast_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(sc._temp_dir, "quarrycast-package.zip")  # the driver's own folder, served to all executors
    with zipfile.ZipFile(path, "w") as z:
        for at, _, files in sorted(os.walk(root)):
            for f in sorted(files):
                if f.endswith(".py"):
                    z.write(os.path.join(at, f), os.path.relpath(os.path.join(at, f), os.path.dirname(root)))
    sc.addPyFile(path)
    sc._quarrycast_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The columns of one table of the data folder; other columns never reach the scan."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns) if columns else spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A folder that all executors share: the one of spark.checkpoint.dir.

    Where that is unset, one of this machine is set if all executors run on it; elsewhere that is an error, since
    other machines could not read what is written there.
    """
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not where and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not where:
            where = f"{tempfile.gettempdir()}/quarrycast-{uuid.uuid4().hex}"
            atexit.register(shutil.rmtree, where, ignore_errors=True)
        sc.setCheckpointDir(where)
        held = sc._jsc.sc().getCheckpointDir()
    return held.get()


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """df in enough partitions to keep all cores busy with work that is heavy for each row.

    Large inputs arrive in more splits than that and are left as they are, without a shuffle.
    """
    n = df.sparkSession.sparkContext.defaultParallelism * per_core
    return df if df.rdd.getNumPartitions() * 2 >= n else df.repartition(n)


def small_enough(df: DataFrame, max_rows: int) -> DataFrame:
    """df with a broadcast hint if it really has at most max_rows rows, else df for a shuffled join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
