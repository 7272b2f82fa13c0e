"""Queries of the general data problems: amounts in units, changes of snapshots, instants."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrycast.operators import instants, snapshots, units
from quarrycast.runtime import spread, table


def p1_found(spark, sf_dir):
    pays = units.read_pays(spread(table(spark, sf_dir, "jobs", "id", "pay_min", "pay_max", "pay_currency", "jd_text")), "id", ["pay_min", "pay_max"], "pay_currency", "jd_text")
    sums = units.read_amounts(spread(table(spark, sf_dir, "funding_items", "id", "amount_raw", "currency", "raw_text")), "id", "amount_raw", "currency", "raw_text")
    factors = table(spark, sf_dir, "unit_factors", "kind", "unit_code", "factor")
    found = units.canonical(pays, factors, units.PAY_DIMS).withColumn("tab", F.lit("jobs"))
    found = found.unionByName(units.canonical(sums, factors, units.SUM_DIMS).withColumn("tab", F.lit("funding_items")))
    return found.withColumn("usd", F.rint("canonical").cast("bigint")).where("usd is not null and row_id is not null").select("tab", "row_id", "field_name", "usd").distinct()


def p2_found(spark, sf_dir):
    rows = table(spark, sf_dir, "job_snapshots", "snapshot_no", "source", "board", "poll_ok", "external_id", "title", "jd_text", "loaded_at")
    found = snapshots.changes(spread(rows), "snapshot_no", ["source", "board"], "external_id", ["title", "jd_text"], ["jd_text"], "poll_ok", "loaded_at")
    return found.select("source", "external_id", "snapshot_no", "change_kind").distinct()


def p4_found(spark, sf_dir):
    one = lambda tab, key, value, source: table(spark, sf_dir, tab, key, value, *([source] if tab in ("jobs", "feed_items") else [])).select(F.lit(tab).alias("tab"), F.col(key).cast("string").alias("row_key"), F.col(value).alias("value"), (F.col(source) if tab in ("jobs", "feed_items") else F.lit(source)).alias("source"))
    values = one("jobs", "id", "posted_at", "source")
    for tab, key, value, source in (("lever_postings", "id", "created_at", "lever"), ("ashby_postings", "id", "published_at", "ashby"), ("feed_items", "item_id", "published_at", "source")):
        values = values.unionByName(one(tab, key, value, source))
    found = instants.utc_seconds(values, "value", "source", table(spark, sf_dir, "zone_hints", "source", "tz_name", "day_order"), table(spark, sf_dir, "zone_names", "abbr", "offset_minutes"))
    return found.where("utc_second is not null and row_key is not null").select("tab", "row_key", "utc_second").distinct()


QUERIES = {"p1_found": p1_found, "p4_found": p4_found, "p2_found": p2_found}

SQL = {
    "p2_found": r"""
WITH s AS (SELECT *, regexp_replace(external_id, '^[\s\pZ\x0b]+|[\s\pZ\x0b]+$', '', 'g') AS e FROM job_snapshots WHERE snapshot_no IS NOT NULL),
     w AS (SELECT source, board, e, snapshot_no, loaded_at, nullif(nfc_normalize(regexp_replace(title, '[\s\pZ\x0b]+', '', 'g')), '') AS t,
                  nullif(nfc_normalize(regexp_replace(jd_text, '[\s\pZ\x0b]+', '', 'g')), '') AS j FROM s WHERE coalesce(poll_ok, 1) <> 0 AND e <> ''),
     r AS (SELECT source, board, e, snapshot_no, first(t ORDER BY loaded_at DESC NULLS LAST, t DESC NULLS LAST) AS t,
                  first(j ORDER BY loaded_at DESC NULLS LAST, j DESC) FILTER (j IS NOT NULL) AS j FROM w GROUP BY ALL),
     failed AS (SELECT DISTINCT source, board, snapshot_no FROM s WHERE poll_ok = 0),
     d AS (SELECT b.source, b.board, n.snapshot_no,
                  lag(n.snapshot_no) OVER (PARTITION BY b.source, b.board ORDER BY n.snapshot_no) AS before,
                  lead(n.snapshot_no) OVER (PARTITION BY b.source, b.board ORDER BY n.snapshot_no) AS after
           FROM (SELECT DISTINCT source, board FROM s) b, (SELECT DISTINCT snapshot_no FROM s) n
           ANTI JOIN failed f ON f.source IS NOT DISTINCT FROM b.source AND f.board IS NOT DISTINCT FROM b.board AND f.snapshot_no = n.snapshot_no),
     v AS (SELECT r.source, r.board, r.e, r.snapshot_no, r.t, before, after,
                  last_value(r.j IGNORE NULLS) OVER (PARTITION BY r.source, r.board, r.e ORDER BY r.snapshot_no) AS j
           FROM r JOIN d ON d.source = r.source AND d.board = r.board AND d.snapshot_no = r.snapshot_no)
SELECT a.source, a.e AS external_id, a.snapshot_no, CASE WHEN b.e IS NULL THEN 'added' ELSE 'changed' END AS change_kind
FROM v a LEFT JOIN v b ON a.source = b.source AND a.board = b.board AND a.e = b.e AND b.snapshot_no = a.before
WHERE a.before IS NOT NULL AND (b.e IS NULL OR a.t IS DISTINCT FROM b.t OR a.j IS DISTINCT FROM b.j)
UNION
SELECT b.source, b.e, b.after, 'removed' FROM v b LEFT JOIN v a ON a.source = b.source AND a.board = b.board AND a.e = b.e AND a.snapshot_no = b.after
WHERE b.after IS NOT NULL AND a.e IS NULL""",
}
