"""Incremental runs: scheduled micro-batches, idempotent inserts, alerts as keyed state, and windowed counts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from quarrycast.operators import state
from quarrycast.operators.health import EMPTY_STREAK, FAIL_STREAK, KEPT


def read_table(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A parquet table, one file or a folder of files, as a stream."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern may name a file, a plain path must be a folder


def insert_new(stream: DataFrame, table: str, keys: list[str], order: str, checkpoint: str):
    """Start a run that appends rows with new keys to a table of versions and ends when the input is read.

    Every batch is anti-joined with the keys of the published version; its new rows become a part of their own, named
    by the run's checkpoint and the batch's number, and no stored row is written again. A batch that is replayed after
    a failure finds its part in the table and adds nothing, or replaces the part that it left unpublished.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        part = f"{run}-{number:010d}"
        if part in state.parts_of(spark, table, state.current_version(spark, table)):
            return
        old = state.read_current(spark, table)
        old = batch.where("false") if old is None else old
        state.append(state.insert_or_ignore(batch, old, keys, order), table, part)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, at: str, keys: list[str], window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts by event-time window and keys; rows later than `late` behind the newest are left out."""
    timed = stream.withColumn("at", F.col(at).cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


ALERT = "target string, id long, change string, reason string"


def diagnose(trail: str) -> str | None:
    """'failing', 'empty' or None for polls as letters, newest first: failed, unchanged, empty, produced."""
    fails = len(trail) - len(trail.lstrip("f"))
    if fails >= FAIL_STREAK:
        return "failing"
    head = trail.replace("u", "")
    empties = len(head) - len(head.lstrip("e"))
    return "empty" if empties >= EMPTY_STREAK and head[empties : empties + 1] == "p" and "f" not in trail[: trail.find("p")] else None


def alert_changes(polls: DataFrame) -> DataFrame:
    """(target, id, change, reason): when an alert is raised or resolved, from a stream of polls.

    polls has target string, id, ok, status, item_count. The state of a target is its last KEPT polls as letters
    and whether an alert is open, so it is bounded. Polls of one batch are taken in the order of id.
    """

    def step(key, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        trail, opened = held.get if held.exists else ("", "")
        out = []
        rows = pd.concat(list(batches)).sort_values("id")
        for r in rows.itertuples():
            letter = "f" if not r.ok else "u" if r.status == 304 else "e" if r.item_count == 0 else "p"
            trail = (letter + trail)[:KEPT]
            reason = diagnose(trail)
            if reason and not opened:
                opened = reason
                out.append((key[0], int(r.id), "raised", reason))
            elif not reason and opened:
                out.append((key[0], int(r.id), "resolved", opened))
                opened = ""
        held.update((trail, opened))
        yield pd.DataFrame(out, columns=["target", "id", "change", "reason"])

    return polls.groupBy("target").applyInPandasWithState(step, ALERT, "trail string, opened string", "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append what is there to read to a parquet folder, and stop: what a timer starts."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
