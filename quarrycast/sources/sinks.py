"""Where results go: sheets, allow-listed tables, logs that are only appended to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tables that may be pushed to a shared place.
SHARED = ("applications", "pipeline")


def cells(df: DataFrame) -> DataFrame:
    """All values as texts, null as the empty one."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])


def workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """One folder of CSV files with a header for each sheet."""
    for name, df in sheets.items():
        cells(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/{name}")


def push(tables: dict[str, DataFrame], path: str) -> list[str]:
    """Replace the shared tables by those given; others are refused."""
    refused = [t for t in tables if t not in SHARED]
    if refused:
        raise ValueError(f"not to be shared: {', '.join(refused)}")
    for name, df in tables.items():
        cells(df).write.mode("overwrite").parquet(f"{path}/{name}")
    return list(tables)


def append_log(df: DataFrame, path: str) -> None:
    """Add dead letters, notices or notifications; rows of such a log are never changed."""
    df.write.mode("append").parquet(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
