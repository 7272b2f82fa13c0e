"""Queries that run a stream over a whole table and return what it left."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarrycast.operators import state
from quarrycast.plans.base import Registry
from quarrycast.plans.states import W3
from quarrycast.runtime import shared_folder
from quarrycast.streaming import ingest

q = Registry()


@q("T1_T3_alert_stream", f"WITH {W3} SELECT target::VARCHAR AS target, raised_at AS id, 'raised' AS change, reason FROM al UNION ALL SELECT target::VARCHAR, resolved_at, 'resolved', reason FROM al WHERE resolved_at IS NOT NULL")
def _alerts(spark, d):
    """Alerts by keyed state: the same changes as the batch history has."""
    folder = f"{shared_folder(spark)}/alerts-{uuid.uuid4().hex}"
    e, t = ingest.read_table(spark, f"{d}/events.parquet"), F.col("event_type")
    items = F.when(t.isin("error", "signup"), None).when(t == "view", 0).otherwise(F.floor("value").cast("int") + 1)
    polls = e.select(F.col("user_id").cast("string").alias("target"), F.col("event_id").alias("id"), (t != "error").alias("ok"), F.when(t == "error", 404).when(t == "signup", 304).otherwise(200).alias("status"), items.alias("item_count"))
    ingest.run_once(ingest.alert_changes(polls), f"{folder}/out", f"{folder}/state")
    return spark.read.schema(ingest.ALERT).parquet(f"{folder}/out")


@q("T2_insert_stream", "SELECT url, min(item_id) AS item_id FROM feed_items WHERE url IS NOT NULL GROUP BY url")
def _insert(spark, d):
    """Feed items by url, inserted once each, then replayed: the second run adds nothing."""
    folder = f"{shared_folder(spark)}/items-{uuid.uuid4().hex}"
    for run in ("first", "again"):
        items = ingest.read_table(spark, f"{d}/feed_items.parquet").select("url", "item_id")
        ingest.insert_new(items, f"{folder}/table", ["url"], "item_id", f"{folder}/{run}").awaitTermination()
    return state.read_current(spark, f"{folder}/table").select("url", "item_id")
