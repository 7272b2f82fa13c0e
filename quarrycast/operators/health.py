"""Silent feeds: the last polls of each target, their diagnosis, and the history of alerts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrycast.runtime import cut

FAIL_STREAK, EMPTY_STREAK, KEPT = 3, 3, 30  #: failed polls in a row, empty polls in a row, polls looked back on


def last_polls(polls: DataFrame, keys: list[str], order: str, kept: int = KEPT) -> DataFrame:
    """The last `kept` polls of each target, newest first by rn. The rank filter is pushed below the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return polls.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= kept)


def diagnose(polls: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, reason, streak) of each target: 'failing', 'empty' or null.

    polls has ok boolean, status int, item_count int. Failing: at least FAIL_STREAK failures since the last good poll.
    Empty: at least EMPTY_STREAK polls without items since one with items, no failure among them; 304 counts as
    neither. A null count is a poll that produced.
    """
    recent = last_polls(polls, keys, order)
    unchanged = F.coalesce(F.col("status") == 304, F.lit(False))
    no_items = F.coalesce(F.col("item_count") == 0, F.lit(False))
    far = F.lit(KEPT + 1)
    firsts = recent.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(F.col("ok"), F.col("rn"))), far).alias("rn_ok"),
        F.coalesce(F.min(F.when(~F.col("ok"), F.col("rn"))), far).alias("rn_bad"),
        F.coalesce(F.min(F.when(F.col("ok") & ~unchanged & ~no_items, F.col("rn"))), far).alias("rn_prod"),
        F.count("*").alias("n"),
        F.sort_array(F.collect_list(F.when(F.col("ok") & ~unchanged & no_items, F.col("rn")))).alias("empty_at"),
    )
    fails = F.least(F.col("rn_ok") - 1, F.col("n"))
    empties = F.size(F.filter("empty_at", lambda r: r < F.col("rn_prod")))
    empty = (F.col("rn_prod") < F.col("rn_bad")) & (F.col("rn_prod") < far) & (empties >= EMPTY_STREAK)
    return firsts.select(*keys, F.when(fails >= FAIL_STREAK, "failing").when(empty, "empty").alias("reason"), F.when(fails >= FAIL_STREAK, fails).when(empty, empties).cast("bigint").alias("streak"))


def _ranges(polls: DataFrame, keys: list[str], order: str) -> DataFrame:
    """polls with a letter for each, and the letters of the last KEPT polls of the target up to it in its range of order.

    A target with most of the polls is spread over as many tasks as there are ranges. Their bounds come from a sample,
    so they are written down before they are used.
    """
    n = max(8, int(polls.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kind = F.when(~F.col("ok"), "f").when(F.coalesce(F.col("status") == 304, F.lit(False)), "u").when(F.coalesce(F.col("item_count") == 0, F.lit(False)), "e").otherwise("p")
    ranged = cut(polls.withColumn("q__kind", kind).repartitionByRange(n, order).withColumn("q__range", F.spark_partition_id()))
    last = Window.partitionBy(*keys, "q__range").orderBy(order).rowsBetween(1 - KEPT, 0)
    return ranged.withColumn("q__own", F.array_join(F.collect_list("q__kind").over(last), "")).drop("q__kind")


def _carried(rows: DataFrame, ranges: DataFrame, keys: list[str], name: str, start: Column, fold: Callable[[Column, Column], Column], later: bool = False) -> DataFrame:
    """rows with name: what fold makes of start and the column name of ranges in all earlier ranges of a target, or in
    all later ones from the last on. ranges has one row for each range of a target, so few for any."""
    values = F.array_sort(F.collect_list(F.struct("q__range", name)))
    listed = ranges.groupBy(*keys).agg((F.reverse(values) if later else values).alias("q__all"))
    none = F.slice(F.transform("q__all", lambda x: F.struct(x["q__range"].alias("r"), start.alias("v"))), 1, 0)
    step = lambda s, x: F.struct(fold(s["now"], x[name]).alias("now"), F.concat(s["out"], F.array(F.struct(x["q__range"].alias("r"), s["now"].alias("v")))).alias("out"))
    each = listed.select(*[F.col(k).alias(f"q__{k}") for k in keys], F.explode(F.aggregate("q__all", F.struct(start.alias("now"), none.alias("out")), step, lambda s: s["out"])).alias("c"))
    each = each.select(*[f"q__{k}" for k in keys], F.col("c.r").alias("q__r"), F.col("c.v").alias(name))
    on = F.col("q__range") == F.col("q__r")
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"q__{k}"))
    return rows.join(each, on).drop("q__r", *[f"q__{k}" for k in keys])


def _reasons(polls: DataFrame, keys: list[str], order: str) -> DataFrame:
    """polls with reason and q__range."""
    ranged = _ranges(polls, keys, order)
    tails = ranged.groupBy(*keys, "q__range").agg(F.max_by("q__own", order).alias("q__before"))
    whole = _carried(ranged, tails, keys, "q__before", F.lit(""), lambda now, own: F.right(F.concat(now, own), F.lit(KEPT)))
    # the last polls as letters, newest first
    trail = F.reverse(F.right(F.concat("q__before", "q__own"), F.lit(KEPT)))
    reason = F.when(trail.rlike(f"^f{{{FAIL_STREAK},}}"), "failing").when(trail.rlike(f"^u*(eu*){{{EMPTY_STREAK},}}p"), "empty")
    return whole.select(*polls.columns, reason.alias("reason"), "q__range")


def poll_reasons(polls: DataFrame, keys: list[str], order: str) -> DataFrame:
    """polls with the reason that held right after each of them, over its last KEPT polls. order is unique in a target."""
    return _reasons(polls, keys, order).drop("q__range")


def alerts(polls: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, raised_at, reason, resolved_at): one row for each time that an alert was open; resolved_at is null while
    it is. The reason is that of the first poll that raised it. order is unique in a target."""
    marked = cut(_reasons(polls, keys, order).select(*keys, order, "reason", "q__range", F.col("reason").isNotNull().alias("bad")))
    w = Window.partitionBy(*keys, "q__range").orderBy(order)
    ends = marked.groupBy(*keys, "q__range").agg(F.max_by("bad", order).alias("q__was"))
    known = _carried(marked, ends, keys, "q__was", F.lit(False), lambda now, bad: bad).withColumn("q__was", F.coalesce(F.lag("bad").over(w), "q__was"))
    known = known.withColumn("q__down", F.when(~F.col("bad") & F.col("q__was"), F.col(order)))
    known = known.withColumn("q__next", F.min("q__down").over(w.rowsBetween(1, Window.unboundedFollowing)))
    downs = known.groupBy(*keys, "q__range").agg(F.min("q__down").alias("q__later"))
    raised = known.where(F.col("bad") & ~F.col("q__was"))
    none = F.lit(None).cast(marked.schema[order].dataType)
    out = _carried(raised, downs, keys, "q__later", none, lambda now, down: F.coalesce(down, now), later=True)
    return out.select(*keys, F.col(order).alias("raised_at"), "reason", F.coalesce("q__next", "q__later").alias("resolved_at"))


def message(label: Column, reason: Column) -> Column:
    return F.concat(label, F.when(reason == "failing", ": board is returning errors").otherwise(": board went empty"))
