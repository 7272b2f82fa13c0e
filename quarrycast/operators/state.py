"""Stateful rules as joins of a batch with a snapshot: upsert, insert-or-ignore, duplicate links, latest by key.

A table of versions is a folder of parts, written once and never changed, and of manifests, one for each version,
that list its parts. A version begins to exist when its manifest is renamed into place, which nothing undoes: readers
see whole versions, and a job that is lost at any time leaves the last one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrycast.functions.text import dedupe_key, empty_to_null


def first_per_key(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key by order, columns kept; aggregated before the shuffle, so hot keys are no task's load."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order, *[c for c in rest if _orderable(df, c)])).alias("r")).select(*keys, "r.*").select(*df.columns)


def last_per_key(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key by order; of rows that tie in it the one with the greatest values. Nulls come first."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order, *[c for c in rest if _orderable(df, c)])).alias("r")).select(*keys, "r.*").select(*df.columns)


def _orderable(df: DataFrame, c: str) -> bool:
    return not df.schema[c].dataType.simpleString().startswith(("map", "variant"))


def insert_or_ignore(batch: DataFrame, state: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows of batch whose key is new: the first of each in the batch, none that state has. Null keys stay out."""
    some = batch
    for k in keys:
        some = some.where(F.col(k).isNotNull())
    return first_per_key(some, keys, order).join(state.select(*keys).distinct(), keys, "left_anti")


def upsert(state: DataFrame, batch: DataFrame, keys: list[str], now: str, kept_if_empty: list[str], arrived: list[str], url: str = "url", stamp: str = "seen_at", first_stamp: str = "first_seen_at", urls: str = "source_urls") -> DataFrame:
    """state after batch, with outcome 'new', 'updated' or 'kept'.

    state has the columns of batch but those of arrived, both stamps and the list of urls. A key in both takes the
    batch's values, but keeps the first stamp, and keeps a column of kept_if_empty where the batch's is null or
    empty; the batch's url joins the list unless it has it. Of rows of the batch with one key the last to arrive, by
    the columns of arrived, counts. Rows of the batch with a null key come as new rows each. One full outer join on
    the key.
    """
    values = [c for c in batch.columns if c not in keys and c not in arrived]
    null_key = F.lit(False)
    for k in keys:
        null_key |= F.col(k).isNull()
    one = last_per_key(batch.where(~null_key), keys, *arrived).drop(*arrived)
    s, b = state.withColumn("in_s", F.lit(True)).alias("s"), one.withColumn("in_b", F.lit(True)).alias("b")
    on = F.lit(True)
    for k in keys:
        on &= F.col(f"s.{k}") == F.col(f"b.{k}")
    joined = s.join(b, on, "full_outer")
    has_b, has_s = F.col("in_b").isNotNull(), F.col("in_s").isNotNull()
    pick = lambda c: F.coalesce(empty_to_null(F.col(f"b.{c}")), F.col(f"s.{c}")) if c in kept_if_empty else F.when(has_b, F.col(f"b.{c}")).otherwise(F.col(f"s.{c}"))
    added = F.when(has_b & F.col(f"b.{url}").isNotNull() & (F.col(f"b.{url}") != ""), F.array(F.col(f"b.{url}")))
    none = F.expr("cast(array() as array<string>)")
    out = joined.select(
        *[F.coalesce(F.col(f"b.{k}"), F.col(f"s.{k}")).alias(k) for k in keys],
        *[pick(c).alias(c) for c in values],
        F.when(has_b, F.lit(now)).otherwise(F.col(f"s.{stamp}")).alias(stamp),
        F.when(has_s, F.col(f"s.{first_stamp}")).otherwise(F.lit(now)).alias(first_stamp),
        F.array_distinct(F.concat(F.coalesce(F.col(f"s.{urls}"), none), F.coalesce(added, none))).alias(urls),
        F.when(has_b & has_s, "updated").when(has_b, "new").otherwise("kept").alias("outcome"),
    )
    loose = batch.where(null_key).select(*keys, *values, F.lit(now).alias(stamp), F.lit(now).alias(first_stamp), F.when(F.coalesce(F.col(url), F.lit("")) != "", F.array(url)).otherwise(none).alias(urls), F.lit("new").alias("outcome"))
    return out.unionByName(loose)


def canonical_of(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """jobs with dedupe_key and canonical_id: the oldest row of another source with the same key, as rows arrive by id.

    From an empty state a key's first row is its base, and a later row links to it iff its source differs. Keys
    without any part link nothing. One aggregation by key finds the bases; hot keys are combined before the shuffle.
    """
    named = jobs.join(companies.select(F.col("id").alias("company_id"), F.col("name").alias("q__name")), "company_id", "left")
    keyed = named.withColumn("dedupe_key", dedupe_key(F.col("q__name"), F.col("title"), F.col("posted_at"))).drop("q__name")
    base = keyed.where("dedupe_key <> '||'").groupBy("dedupe_key").agg(F.min(F.struct("id", F.coalesce("source", F.lit("")).alias("source"))).alias("q__base"))
    linked = keyed.join(base, "dedupe_key", "left")
    other = (F.coalesce("source", F.lit("")) != F.col("q__base.source")) & (F.col("id") > F.col("q__base.id"))
    return linked.withColumn("canonical_id", F.when(other, F.col("q__base.id"))).select(*jobs.columns, "dedupe_key", "canonical_id")


def link_new(new: DataFrame, old: DataFrame) -> DataFrame:
    """new with canonical_id against rows already stored: both have id, dedupe_key and source; old only unlinked rows.

    Per key the oldest stored row is the base, and the oldest of another source the second; a new row links to the
    base unless they share the source, then to the second. Without stored rows the first new row is the base.
    """
    source = F.coalesce("source", F.lit("")).alias("source")
    o = old.where("dedupe_key <> '||'").select("dedupe_key", "id", source)
    base = o.groupBy("dedupe_key").agg(F.min(F.struct("id", "source")).alias("base"))
    second = o.join(base, "dedupe_key").where("source <> base.source").groupBy("dedupe_key").agg(F.min("id").alias("second"))
    n = new.withColumn("q__source", F.coalesce("source", F.lit("")))
    first = n.where("dedupe_key <> '||'").groupBy("dedupe_key").agg(F.min(F.struct("id", F.col("q__source").alias("source"))).alias("first"))
    out = n.join(base, "dedupe_key", "left").join(second, "dedupe_key", "left").join(first, "dedupe_key", "left")
    b = F.coalesce("base", "first")
    link = F.when(F.col("q__source") != b["source"], b["id"]).otherwise(F.col("second"))
    return out.withColumn("canonical_id", F.when(link < F.col("id"), link)).select(*new.columns, "canonical_id")


def split_valid(df: DataFrame, valid: Column, rule_id: str, reason: str, payload: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that are valid, dead letters of the rest): no row is lost without a record."""
    ok = F.coalesce(valid, F.lit(False))
    dead = df.where(~ok).select(F.to_json(F.struct(*payload)).alias("raw_payload"), F.lit(reason).alias("reason"), F.lit(rule_id).alias("rule_id"))
    return df.where(ok), dead


def lookup_company(df: DataFrame, companies: DataFrame, domain: str, name: str) -> DataFrame:
    """df with company_id by domain, else by name, whatever the case; the least id where several fit."""
    c = companies.select("id", F.lower(F.trim("domain")).alias("d"), F.lower("name").alias("n"))
    by_domain = c.where("d is not null").groupBy(F.col("d").alias("q__d")).agg(F.min("id").alias("q__by_domain"))
    by_name = c.where("n is not null").groupBy(F.col("n").alias("q__n")).agg(F.min("id").alias("q__by_name"))
    out = df.join(by_domain, F.lower(F.trim(domain)) == F.col("q__d"), "left").join(by_name, F.lower(name) == F.col("q__n"), "left")
    return out.select(*df.columns, F.coalesce("q__by_domain", "q__by_name").alias("company_id"))


def backfill(companies: DataFrame, items: DataFrame, domain: str, name: str, order: str) -> DataFrame:
    """companies with a null domain filled from the first item, by order, that is theirs by name and has a domain which
    leads to no company. One aggregation by company, combined before the shuffle."""
    c = companies.select("id", F.lower(F.trim("domain")).alias("d"), F.lower("name").alias("n"))
    known = c.where("d is not null").select(F.col("d").alias("q__d")).distinct()
    by_name = c.where("n is not null").groupBy(F.col("n").alias("q__n")).agg(F.min("id").alias("q__id"))
    new = items.where(F.trim(domain) != "").join(known, F.lower(F.trim(domain)) == F.col("q__d"), "left_anti")
    own = new.join(by_name, F.lower(name) == F.col("q__n")).groupBy("q__id").agg(F.min_by(F.trim(domain), order).alias("q__domain"))
    out = companies.join(own, F.col("id") == F.col("q__id"), "left")
    return out.select(*[F.coalesce("domain", "q__domain").alias("domain") if x == "domain" else F.col(x) for x in companies.columns])


def apply_funding(companies: DataFrame, raises: DataFrame, days: int) -> DataFrame:
    """companies with the columns of their last raise, by order: recently_funded_at, funding_stage, funding_amount_raw and
    priority_until, which is `days` after the announcement; empty texts are null, an unreadable date opens no window.

    raises has company_id, order, announced_at, round_stage and amount_raw. Companies without a raise stay as they are.
    """
    last = raises.where("company_id is not null").groupBy("company_id").agg(F.max_by(F.struct("announced_at", "round_stage", "amount_raw"), "order").alias("q__r"))
    until = F.date_format(F.date_add(F.substring("q__r.announced_at", 1, 10).try_cast("date"), days), "yyyy-MM-dd")
    new = {"recently_funded_at": empty_to_null(F.col("q__r.announced_at")), "funding_stage": empty_to_null(F.col("q__r.round_stage")), "funding_amount_raw": empty_to_null(F.col("q__r.amount_raw")), "priority_until": until}
    j = companies.join(last, F.col("id") == F.col("company_id"), "left")
    old = lambda x: F.col(x) if x in companies.columns else F.lit(None).cast("string")
    return j.select(*[x for x in companies.columns if x not in new], *[F.when(F.col("q__r").isNotNull(), v).otherwise(old(x)).alias(x) for x, v in new.items()])


def new_ids(df: DataFrame, state: DataFrame, order: list[str], id_name: str = "id") -> DataFrame:
    """df with ids after the greatest of state, in the order given, without one task for all rows."""
    from quarrycast.operators.listing import rank

    top = state.agg(F.coalesce(F.max(id_name), F.lit(0)).alias("q__top"))
    return rank(df, [F.col(c) for c in order], "q__rank").select((top.scalar() + F.col("q__rank")).alias(id_name), *df.columns)


def sync_members(companies: DataFrame, members: DataFrame, optional: list[str], owned: list[str]) -> DataFrame:
    """companies after a membership list, with outcome 'added', 'updated' or 'kept'.

    members are keyed by lower-case name. Optional columns are filled only where null in companies; owned ones are
    overwritten, with null too; all others stay.
    """
    m = first_per_key(members.withColumn("k", F.lower("name")).where("k is not null"), ["k"], "name").withColumn("in_m", F.lit(True)).alias("m")
    c = companies.withColumn("k", F.lower("name")).withColumn("in_c", F.lit(True)).alias("c")
    j = c.join(m, F.col("c.k") == F.col("m.k"), "full_outer")
    has_m, has_c = F.col("in_m").isNotNull(), F.col("in_c").isNotNull()
    cols = []
    for x in companies.columns:
        if x in owned:
            cols.append(F.when(has_m, F.col(f"m.{x}")).otherwise(F.col(f"c.{x}")).alias(x))
        elif x in optional or x == "name":
            cols.append(F.coalesce(F.col(f"c.{x}"), F.col(f"m.{x}")).alias(x))
        else:
            cols.append(F.col(f"c.{x}").alias(x))
    return j.select(*cols, F.when(has_m & has_c, "updated").when(has_m, "added").otherwise("kept").alias("outcome"))


def mark_polled(companies: DataFrame, outcomes: DataFrame, now: str) -> DataFrame:
    """companies after polls: outcomes has company_id, at, status and validators etag, last_modified; success replaces
    the validators, 304 and failure keep them. Of several polls of one company the latest counts."""
    o = outcomes.groupBy("company_id").agg(F.max_by(F.struct("status", "etag", "last_modified"), F.struct("at", "status", "etag", "last_modified")).alias("o"))
    j = companies.join(o, companies["id"] == o["company_id"], "left").drop("company_id")
    ok = F.col("o.status").between(200, 299)
    keep = lambda c, new: F.when(ok, empty_to_null(F.col(f"o.{new}"))).otherwise(F.col(c)).alias(c)
    same = [c for c in companies.columns if c not in ("last_polled_at", "poll_etag", "poll_last_modified")]
    return j.select(*same, F.when(F.col("o").isNotNull(), F.lit(now)).otherwise(F.col("last_polled_at")).alias("last_polled_at"), keep("poll_etag", "etag"), keep("poll_last_modified", "last_modified"))


# --- versions -------------------------------------------------------------------------------------------------
MANIFESTS, PARTS = "_versions", "parts"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _children(spark: SparkSession, path: str) -> list[str]:
    p, fs = _fs(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []


def current_version(spark: SparkSession, table: str) -> int:
    """The greatest version that was published; 0 if there is none."""
    return max((int(x) for x in _children(spark, f"{table}/{MANIFESTS}") if x.isdigit()), default=0)


def parts_of(spark: SparkSession, table: str, version: int) -> list[str]:
    """The names of the parts that make up a version."""
    if not version:
        return []
    p, fs = _fs(spark, f"{table}/{MANIFESTS}/{version:010d}")
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split()
    finally:
        stream.close()


def read_current(spark: SparkSession, table: str) -> DataFrame | None:
    parts = parts_of(spark, table, current_version(spark, table))
    return spark.read.parquet(*[f"{table}/{PARTS}/{x}" for x in parts]) if parts else None


def _commit(spark: SparkSession, table: str, version: int, parts: list[str]) -> None:
    """Make the version exist: its manifest is written aside and renamed to a name that nothing has yet."""
    aside, fs = _fs(spark, f"{table}/{MANIFESTS}/.{version:010d}-{uuid.uuid4().hex}")
    stream = fs.create(aside, True)
    stream.write(bytearray("\n".join(parts).encode()))
    stream.close()
    to, _ = _fs(spark, f"{table}/{MANIFESTS}/{version:010d}")
    if fs.exists(to) or not fs.rename(aside, to):
        fs.delete(aside, False)
        raise RuntimeError(f"version {version} of {table} was published by another run")


def publish(df: DataFrame, table: str) -> int:
    """Write df as the next version, which replaces all rows; returns the version. One committer at a time."""
    spark = df.sparkSession
    v, part = current_version(spark, table) + 1, uuid.uuid4().hex
    df.write.parquet(f"{table}/{PARTS}/{part}")
    _commit(spark, table, v, [part])
    return v


def append(df: DataFrame, table: str, part: str) -> int:
    """Publish a version with the rows of df added as the part named; what is stored is neither read nor written again.

    A part that the table has already is not added twice; one left by a lost run is replaced.
    """
    spark = df.sparkSession
    v = current_version(spark, table)
    parts = parts_of(spark, table, v)
    if part in parts:
        return v
    df.write.mode("overwrite").parquet(f"{table}/{PARTS}/{part}")
    _commit(spark, table, v + 1, [*parts, part])
    return v + 1


def vacuum(spark: SparkSession, table: str, keep: int = 2) -> list[str]:
    """Remove all but the last versions, and the parts that none of those lists; returns the names of these parts.

    Must not run beside a writer or a reader of older versions.
    """
    v = current_version(spark, table)
    versions = [int(x) for x in _children(spark, f"{table}/{MANIFESTS}") if x.isdigit()]
    kept = {x for n in versions if n > v - keep for x in parts_of(spark, table, n)}
    for n in versions:
        if n <= v - keep:
            p, fs = _fs(spark, f"{table}/{MANIFESTS}/{n:010d}")
            fs.delete(p, False)
    gone = sorted(set(_children(spark, f"{table}/{PARTS}")) - kept)
    for x in gone:
        p, fs = _fs(spark, f"{table}/{PARTS}/{x}")
        fs.delete(p, True)
    return gone


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "rn") -> DataFrame:
    """df with the position of each row in its key's group; for small groups and top-k filters."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
