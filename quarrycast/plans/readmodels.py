"""Listings, reports and what feeds them: scans, filters, projections, joins, aggregations and orders."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from quarrycast.functions import dates, text, urls
from quarrycast.operators import listing, state
from quarrycast.operators.listing import ISO, JobFilter, rank
from quarrycast.plans.base import CANON, LISTED, LISTED_COLUMNS, NOW, NOW_ISO, ORDER, Registry, sql_instant
from quarrycast.runtime import table
from quarrycast.sources import sinks

q = Registry()
SINCE = NOW - timedelta(days=60)
TABLES = ["companies", "jobs", "job_snapshots", "lever_postings", "ashby_postings", "feed_items", "funding_items", "mail_messages", "documents", "eval_items"]


def jobs(spark, d):
    return state.canonical_of(table(spark, d, "jobs"), companies(spark, d))


def companies(spark, d):
    return table(spark, d, "companies")


# --- listing --------------------------------------------------------------------------------------------------


@q("F1_hide_duplicates", f"WITH {LISTED} SELECT id, title FROM listed")
def _f1(spark, d):
    return JobFilter().rows(jobs(spark, d), companies(spark, d)).select("id", "title")


@q("F2_contains", f"WITH {LISTED} SELECT id, company, title FROM listed WHERE lower(company) LIKE '%lab%' AND lower(title) LIKE '%eng_neer%'")
def _f2(spark, d):
    return JobFilter(company="LAB", title="eng_neer").rows(jobs(spark, d), companies(spark, d)).select("id", "company", "title")


@q("F3_flags_set", f"WITH {LISTED} SELECT id FROM listed WHERE hires_in_india = 1 AND remote = 1")
def _f3(spark, d):
    return JobFilter(india_only=True, remote_only=True).rows(jobs(spark, d), companies(spark, d)).select("id")


@q("F4_since", f"WITH {LISTED} SELECT id, seen FROM listed WHERE seen >= '{SINCE.strftime(ISO)}'")
def _f4(spark, d):
    return JobFilter(since=dates.parse_since("60d", NOW)).rows(jobs(spark, d), companies(spark, d)).select("id", "seen")


@q("F5_composed", f"WITH {LISTED} SELECT {LISTED_COLUMNS} FROM listed WHERE lower(title) LIKE '%senior%' AND remote = 1 AND seen >= '{SINCE.strftime(ISO)}' ORDER BY {ORDER} LIMIT 50")
def _f5(spark, d):
    return JobFilter(title="senior", remote_only=True, since=SINCE, limit=50).ranked(jobs(spark, d), companies(spark, d))


@q("O1_ranked_listing", f"WITH {LISTED} SELECT id, row_number() OVER (ORDER BY {ORDER}) AS rank FROM listed")
def _o1(spark, d):
    return rank(JobFilter().rows(jobs(spark, d), companies(spark, d)), listing.order()).select("id", "rank")


@q("O5_limited", f"WITH {LISTED} SELECT {LISTED_COLUMNS} FROM listed ORDER BY {ORDER} LIMIT 50")
def _o5(spark, d):
    return JobFilter(limit=50).ranked(jobs(spark, d), companies(spark, d))


@q("A1_count_without_limit", f"WITH {LISTED} SELECT count(*) AS n FROM listed WHERE lower(title) LIKE '%engineer%'")
def _a1(spark, d):
    return JobFilter(title="engineer", limit=2).count(jobs(spark, d), companies(spark, d))


@q(
    "P1_flags",
    f"""WITH {LISTED} SELECT id, concat_ws(' ', CASE WHEN hires_in_india = 1 THEN 'IN' END, CASE WHEN auth_required = 1 THEN 'AUTH' END,
     CASE WHEN coalesce(comp_model, 'unknown') NOT IN ('', 'unknown') THEN comp_model END) AS flags FROM listed""",
)
def _p1(spark, d):
    return JobFilter().rows(jobs(spark, d), companies(spark, d)).select("id", listing.flags().alias("flags"))


@q(
    "P2_digest_flags",
    f"""WITH {LISTED} SELECT id, concat_ws(', ', CASE WHEN hires_in_india = 1 THEN 'india/global' END, CASE WHEN auth_required = 1 THEN 'needs US/EU auth' END,
     CASE WHEN coalesce(comp_model, 'unknown') NOT IN ('', 'unknown') THEN comp_model END) AS flags FROM listed""",
)
def _p2(spark, d):
    return JobFilter().rows(jobs(spark, d), companies(spark, d)).select("id", listing.flags(", ", "india/global", "needs US/EU auth").alias("flags"))


@q("J1_jobs_company", "SELECT j.id, c.name AS company, j.title FROM jobs j JOIN companies c ON c.id = j.company_id")
def _j1(spark, d):
    c = companies(spark, d).select(F.col("id").alias("company_id"), F.col("name").alias("company"))
    return table(spark, d, "jobs", "id", "company_id", "title").join(c, "company_id").select("id", "company", "title")


@q(
    "RM2_pipeline",
    f"""WITH {LISTED} SELECT row_number() OVER (ORDER BY {ORDER}) AS rank, {LISTED_COLUMNS}, concat_ws(' ', CASE WHEN hires_in_india = 1 THEN 'IN' END,
     CASE WHEN auth_required = 1 THEN 'AUTH' END, CASE WHEN coalesce(comp_model, 'unknown') NOT IN ('', 'unknown') THEN comp_model END) AS flags FROM listed""",
)
def pipeline(spark, d):
    """The ranked pipeline with its flags."""
    return rank(JobFilter().rows(jobs(spark, d), companies(spark, d)), listing.order()).select("rank", *listing.COLUMNS, listing.flags().alias("flags"))


# --- watchlist -------------------------------------------------------------------------------------------------


@q("F7_pollable", "SELECT id, name, ats, slug FROM companies WHERE watchlist_enabled = 1 AND ats IN ('greenhouse', 'lever', 'ashby') AND slug IS NOT NULL AND slug <> ''")
def _f7(spark, d):
    return pollable(companies(spark, d)).select("id", "name", "ats", "slug")


def pollable(c):
    return c.where((F.col("watchlist_enabled") == 1) & F.col("ats").isin("greenhouse", "lever", "ashby") & (F.col("slug") != ""))


@q("F8_only", "SELECT id, name FROM companies WHERE contains(lower(name), 'labs') OR slug = 'quillmarsh'")
def _f8(spark, d):
    return companies(spark, d).where(F.lower("name").contains("labs") | (F.col("slug") == "quillmarsh")).select("id", "name")


def effective_priority(now=NOW):
    """high if so by baseline or while the funding window, 60 days from recently_funded_at, is open."""
    until = F.unix_seconds(dates.parse_instant(F.col("recently_funded_at"))) + 60 * 86400
    return F.when((F.col("priority") == "high") | (F.lit(int(now.timestamp())) < until), "high").otherwise("normal")


PRIORITY = f"CASE WHEN priority = 'high' OR {int(NOW.timestamp())} < {sql_instant('recently_funded_at')} + 5184000 THEN 'high' ELSE 'normal' END"


@q("F10_priority", f"SELECT id, {PRIORITY} AS priority_now FROM companies")
def _f10(spark, d):
    return companies(spark, d).select("id", effective_priority().alias("priority_now"))


@q(
    "F9_due",
    f"""SELECT id FROM companies WHERE watchlist_enabled = 1 AND ats IN ('greenhouse', 'lever', 'ashby') AND slug IS NOT NULL AND slug <> '' AND
     coalesce({int(NOW.timestamp())} - {sql_instant('last_polled_at')} >= CASE WHEN {PRIORITY} = 'high' THEN 3 ELSE 6 END * 3600, true)""",
)
def _f9(spark, d):
    waited = F.lit(int(NOW.timestamp())) - F.unix_seconds(dates.parse_instant(F.col("last_polled_at")))
    hours = F.when(effective_priority() == "high", 3).otherwise(6)
    return pollable(companies(spark, d)).where(F.coalesce(waited >= hours * 3600, F.lit(True))).select("id")


@q("F12_recently_funded", f"SELECT id, name, recently_funded_at FROM companies WHERE recently_funded_at >= '{SINCE.strftime(ISO)}'")
def _f12(spark, d):
    return companies(spark, d).where(F.col("recently_funded_at") >= SINCE.strftime(ISO)).select("id", "name", "recently_funded_at")


@q("F13_new_roles", f"WITH {CANON} SELECT id, title FROM canon WHERE canonical_id IS NULL AND first_seen_at >= '{SINCE.strftime(ISO)}'")
def _f13(spark, d):
    return jobs(spark, d).where(F.col("canonical_id").isNull() & (F.col("first_seen_at") >= SINCE.strftime(ISO))).select("id", "title")


@q("P6_board_link", "SELECT id, CASE WHEN slug <> '' AND ats = 'greenhouse' THEN 'https://job-boards.greenhouse.io/' || slug WHEN slug <> '' AND ats = 'lever' THEN 'https://jobs.lever.co/' || slug WHEN slug <> '' AND ats = 'ashby' THEN 'https://jobs.ashbyhq.com/' || slug ELSE '[no board known]' END AS board FROM companies")
def _p6(spark, d):
    return companies(spark, d).select("id", urls.board_link(F.col("ats"), F.col("slug")).alias("board"))


@q("P8_truncated", "SELECT id, CASE WHEN length(title) > 20 THEN left(title, 19) || '…' WHEN length(title) < 20 THEN rpad(title, 20, ' ') ELSE title END AS cell FROM jobs")
def _p8(spark, d):
    return table(spark, d, "jobs", "id", "title").select("id", text.pad(text.truncate(F.col("title"), 20), 20).alias("cell"))


@q("P9_fallback", "SELECT id, coalesce(nullif(funding_stage, ''), 'unknown round') AS stage, coalesce(nullif(domain, ''), 'no domain') AS site FROM companies")
def _p9(spark, d):
    return companies(spark, d).select("id", F.coalesce(text.empty_to_null(F.col("funding_stage")), F.lit("unknown round")).alias("stage"), F.coalesce(text.empty_to_null(F.col("domain")), F.lit("no domain")).alias("site"))


# --- reports ---------------------------------------------------------------------------------------------------


@q("J6_roles_per_company", f"WITH {CANON} SELECT c.id, (SELECT count(*) FROM canon j WHERE j.company_id = c.id AND j.canonical_id IS NULL) AS roles FROM companies c")
def _j6(spark, d):
    n = jobs(spark, d).where("canonical_id is null").groupBy(F.col("company_id").alias("id")).agg(F.count("*").alias("n"))
    return companies(spark, d).select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("roles"))


@q(
    "RM4_funded",
    f"""WITH {CANON}, n AS (SELECT company_id, count(*) AS roles FROM canon WHERE canonical_id IS NULL GROUP BY 1)
SELECT row_number() OVER (ORDER BY recently_funded_at DESC, c.id) AS rank, c.id, c.name, coalesce(nullif(funding_stage, ''), 'unknown round') AS stage,
     CAST(trunc(({int(NOW.timestamp())} - {sql_instant('recently_funded_at')}) / 86400) AS BIGINT) AS days_ago, coalesce(n.roles, 0) AS roles
FROM companies c LEFT JOIN n ON n.company_id = c.id WHERE recently_funded_at >= '{SINCE.strftime(ISO)}'""",
)
def _rm4(spark, d):
    n = jobs(spark, d).where("canonical_id is null").groupBy(F.col("company_id").alias("id")).agg(F.count("*").alias("roles"))
    c = companies(spark, d).where(F.col("recently_funded_at") >= SINCE.strftime(ISO)).join(n, "id", "left")
    out = rank(c, [F.col("recently_funded_at").desc(), F.col("id")])
    return out.select("rank", "id", "name", F.coalesce(text.empty_to_null(F.col("funding_stage")), F.lit("unknown round")).alias("stage"), dates.days_ago(F.col("recently_funded_at"), NOW).alias("days_ago"), F.coalesce("roles", F.lit(0)).alias("roles"))


@q("O4_RM5_candidates", "SELECT id, company_name, announced_at, (SELECT count(*) FROM funding_items WHERE extraction_confidence = 'low') AS total FROM funding_items WHERE extraction_confidence = 'low' ORDER BY announced_at DESC NULLS LAST, id DESC LIMIT 10")
def _o4(spark, d):
    low = table(spark, d, "funding_items", "id", "company_name", "announced_at", "extraction_confidence").where("extraction_confidence = 'low'").drop("extraction_confidence")
    total = low.agg(F.count("*").alias("total"))
    return low.orderBy(F.col("announced_at").desc_nulls_last(), F.col("id").desc()).limit(10).withColumn("total", total.scalar())


@q(
    "O2_RM6_new_roles",
    f"""WITH {CANON} SELECT row_number() OVER (ORDER BY auth_required NULLS FIRST, (hires_in_india = 1) DESC NULLS LAST, first_seen_at DESC, j.id) AS rank, j.id, c.name AS company, j.title,
     coalesce(nullif(j.location, ''), 'location n/a') AS location FROM canon j JOIN companies c ON c.id = j.company_id WHERE canonical_id IS NULL AND first_seen_at >= '{SINCE.strftime(ISO)}'""",
)
def _o2(spark, d):
    c = companies(spark, d).select(F.col("id").alias("company_id"), F.col("name").alias("company"))
    new = jobs(spark, d).where(F.col("canonical_id").isNull() & (F.col("first_seen_at") >= SINCE.strftime(ISO))).join(c, "company_id")
    out = rank(new, [F.col("auth_required").asc_nulls_first(), (F.col("hires_in_india") == 1).desc_nulls_last(), F.col("first_seen_at").desc(), F.col("id")])
    return out.select("rank", "id", "company", "title", F.coalesce(text.empty_to_null(F.col("location")), F.lit("location n/a")).alias("location"))


@q("O3_nulls_last", "SELECT id, row_number() OVER (ORDER BY recently_funded_at IS NULL, recently_funded_at, id) AS rank FROM companies")
def _o3(spark, d):
    return rank(companies(spark, d), [F.col("recently_funded_at").asc_nulls_last(), F.col("id")]).select("id", "rank")


@q("O6_budget", "SELECT id, source FROM funding_items WHERE company_name IS NOT NULL ORDER BY source, id LIMIT 15")
def _o6(spark, d):
    return table(spark, d, "funding_items", "id", "source", "company_name").where("company_name is not null").orderBy("source", "id").limit(15).select("id", "source")


@q("A3_count_where", "SELECT count(*) AS n FROM funding_items WHERE extraction_confidence = 'low'")
def _a3(spark, d):
    return table(spark, d, "funding_items", "extraction_confidence").where("extraction_confidence = 'low'").agg(F.count("*").alias("n"))


@q("A4_single", "SELECT company_id, min(id) AS id FROM jobs GROUP BY company_id HAVING count(*) = 1")
def _a4(spark, d):
    return table(spark, d, "jobs", "id", "company_id").groupBy("company_id").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").drop("n")


@q("A7_K2_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in TABLES))
def _a7(spark, d):
    out = None
    for t in TABLES:
        one = table(spark, d, t).agg(F.lit(t).alias("name"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@q("A8_distinct_append", f"WITH {CANON} SELECT j.id, CASE WHEN b.url = j.url THEN b.url ELSE concat_ws(' ', b.url, j.url) END AS urls FROM canon j JOIN canon b ON b.id = j.canonical_id")
def _a8(spark, d):
    j = jobs(spark, d)
    b = table(spark, d, "jobs", "id", "url").select(F.col("id").alias("canonical_id"), F.col("url").alias("base_url"))
    return j.join(b, "canonical_id").select("id", F.array_join(F.array_distinct(F.array("base_url", "url")), " ").alias("urls"))


@q("K2_values", "SELECT id::VARCHAR AS id, coalesce(name, '') AS name, coalesce(domain, '') AS domain, coalesce(watchlist_enabled::VARCHAR, '') AS enabled, coalesce(funding_stage, '') AS stage FROM companies")
def _k2(spark, d):
    return sinks.cells(companies(spark, d).select("id", "name", "domain", F.col("watchlist_enabled").alias("enabled"), F.col("funding_stage").alias("stage")))


@q(
    "K6_digest_lines",
    f"""WITH {CANON}, f AS (SELECT 1 AS section, row_number() OVER (ORDER BY recently_funded_at DESC, id) AS n, name || ' — ' || coalesce(nullif(funding_stage, ''), 'unknown round') AS line FROM companies WHERE recently_funded_at >= '{SINCE.strftime(ISO)}'),
r AS (SELECT 2 AS section, row_number() OVER (ORDER BY auth_required NULLS FIRST, (hires_in_india = 1) DESC NULLS LAST, first_seen_at DESC, j.id) AS n, c.name || ' — ' || j.title || ' (' || coalesce(nullif(j.location, ''), 'location n/a') || ')' AS line FROM canon j JOIN companies c ON c.id = j.company_id WHERE canonical_id IS NULL AND first_seen_at >= '{SINCE.strftime(ISO)}')
SELECT * FROM f UNION ALL SELECT * FROM r""",
)
def _k6(spark, d):
    funded = q.queries["RM4_funded"](spark, d).select(F.lit(1).alias("section"), F.col("rank").alias("n"), F.concat("name", F.lit(" — "), "stage").alias("line"))
    roles = q.queries["O2_RM6_new_roles"](spark, d).select(F.lit(2).alias("section"), F.col("rank").alias("n"), F.concat("company", F.lit(" — "), "title", F.lit(" ("), "location", F.lit(")")).alias("line"))
    return funded.unionByName(roles)


# --- joins over derived relations: applications from orders, contacts from customer, outreach from events ---------

APPLICATION = "a AS (SELECT o_orderkey AS id, 1 + o_orderkey % (SELECT max(id) FROM jobs) AS job_id, CASE o_orderstatus WHEN 'F' THEN 'rejected' WHEN 'O' THEN 'applied' ELSE 'in_process' END AS status, CAST(o_orderdate AS DATE) AS applied_at, CASE WHEN o_orderstatus = 'O' THEN CAST(o_orderdate AS DATE) + 7 END AS followup_due, o_orderpriority AS notes FROM orders)"
CONTACT = "t AS (SELECT c_custkey AS id, 1 + c_custkey % (SELECT max(id) FROM companies) AS company_id, c_name AS name, c_mktsegment AS title FROM customer)"


def applications(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    jobs, day = table(spark, d, "jobs", "id").agg(F.max("id")).scalar(), F.col("o_orderdate").cast("date")
    return o.select(F.col("o_orderkey").alias("id"), (1 + F.col("o_orderkey") % jobs).alias("job_id"), F.when(F.col("o_orderstatus") == "F", "rejected").when(F.col("o_orderstatus") == "O", "applied").otherwise("in_process").alias("status"), day.alias("applied_at"), F.when(F.col("o_orderstatus") == "O", F.date_add(day, 7)).alias("followup_due"), F.col("o_orderpriority").alias("notes"))


def contacts(spark, d):
    return table(spark, d, "customer", "c_custkey", "c_name", "c_mktsegment").select(F.col("c_custkey").alias("id"), (1 + F.col("c_custkey") % table(spark, d, "companies", "id").agg(F.max("id")).scalar()).alias("company_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("title"))


def applied(spark, d):
    j = table(spark, d, "jobs", "id", "company_id", "title").select(F.col("id").alias("job_id"), "company_id", F.col("title").alias("role"))
    c = companies(spark, d).select(F.col("id").alias("company_id"), F.col("name").alias("company"))
    return applications(spark, d).join(j, "job_id").join(c, "company_id")


@q("J2_F6_applications", f"WITH {APPLICATION} SELECT a.id, c.name AS company, j.title AS role, a.status FROM a JOIN jobs j ON j.id = a.job_id JOIN companies c ON c.id = j.company_id WHERE a.status NOT IN ('rejected')")
def _j2(spark, d):
    return applied(spark, d).where(~F.col("status").isin("rejected")).select("id", "company", "role", "status")


@q("J4_open_at_company", f"WITH {APPLICATION} SELECT j.company_id, count(*) AS n, min(a.id) AS first_id FROM a JOIN jobs j ON j.id = a.job_id WHERE a.status <> 'rejected' GROUP BY 1")
def _j4(spark, d):
    return applied(spark, d).where("status <> 'rejected'").groupBy("company_id").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@q("J5_contact_counts", f"WITH {CONTACT} SELECT c.id, (SELECT count(*) FROM t WHERE t.company_id = c.id) AS contacts FROM companies c")
def _j5(spark, d):
    n = contacts(spark, d).groupBy(F.col("company_id").alias("id")).agg(F.count("*").alias("n"))
    return companies(spark, d).select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("contacts"))


@q("J7_W4_first_contact", f"WITH {CONTACT} SELECT c.id, (SELECT t.name || ' (' || t.title || ')' FROM t WHERE t.company_id = c.id ORDER BY t.id LIMIT 1) AS contact FROM companies c")
def _j7(spark, d):
    first = contacts(spark, d).groupBy(F.col("company_id").alias("id")).agg(F.min_by(F.concat("name", F.lit(" ("), "title", F.lit(")")), "id").alias("contact"))
    return companies(spark, d).select("id").join(first, "id", "left")


@q("J8_last_reply", f"WITH {APPLICATION} SELECT a.id, max(e.ts) AS replied_at FROM a LEFT JOIN events e ON e.event_id = a.id AND e.event_type = 'purchase' GROUP BY a.id")
def _j8(spark, d):
    e = table(spark, d, "events", "event_id", "ts", "event_type").where("event_type = 'purchase'").groupBy(F.col("event_id").alias("id")).agg(F.max("ts").alias("replied_at"))
    return applications(spark, d).select("id").join(e, "id", "left")


@q("P4_days_since", f"WITH {APPLICATION} SELECT id, date_diff('day', applied_at, DATE '2026-10-15') AS days FROM a")
def _p4(spark, d):
    return applications(spark, d).select("id", F.datediff(F.lit("2026-10-15").cast("date"), "applied_at").cast("bigint").alias("days"))


@q(
    "RM1_applications_sheet",
    f"""WITH {APPLICATION}, {CONTACT}, n AS (SELECT company_id, count(*) AS n FROM t GROUP BY 1)
SELECT a.id AS app_id, j.id AS job_id, c.name AS company, j.title, a.status, CAST(a.applied_at AS VARCHAR) AS applied_at, CAST(a.followup_due AS VARCHAR) AS followup_due, date_diff('day', a.applied_at, DATE '2026-10-15') AS days_since_applied,
  j.source, j.comp_model, j.pay_min, j.pay_max, j.pay_currency AS currency, j.auth_required, coalesce(n.n, 0) AS contacts, j.url, a.notes
FROM a JOIN jobs j ON j.id = a.job_id JOIN companies c ON c.id = j.company_id LEFT JOIN n ON n.company_id = c.id""",
)
def _rm1(spark, d):
    """All columns of the sheet; the rows' order, by follow-up, is that of whoever writes it."""
    n = contacts(spark, d).groupBy("company_id").agg(F.count("*").alias("contacts"))
    j = table(spark, d, "jobs", "id", "company_id", "title", "source", "comp_model", "pay_min", "pay_max", "pay_currency", "auth_required", "url").withColumnRenamed("id", "job_id")
    c = companies(spark, d).select(F.col("id").alias("company_id"), F.col("name").alias("company"))
    out = applications(spark, d).join(j, "job_id").join(c, "company_id").join(n, "company_id", "left")
    days = F.datediff(F.lit("2026-10-15").cast("date"), "applied_at").cast("bigint").alias("days_since_applied")
    return out.select(F.col("id").alias("app_id"), "job_id", "company", "title", "status", F.col("applied_at").cast("string").alias("applied_at"), F.col("followup_due").cast("string").alias("followup_due"), days, "source", "comp_model", "pay_min", "pay_max", F.col("pay_currency").alias("currency"), "auth_required", F.coalesce("contacts", F.lit(0)).alias("contacts"), "url", "notes")


# --- validity ------------------------------------------------------------------------------------------------------
EMAILED = "t AS (SELECT c_custkey AS id, 1 + c_custkey % (SELECT max(id) FROM companies) AS company_id, c_name AS name, CASE c_custkey % 4 WHEN 0 THEN 'a@' || lower(trim(k.domain)) WHEN 1 THEN 'a@mail.' || lower(trim(k.domain)) WHEN 2 THEN 'a@other.example' END AS email, lower(trim(k.domain)) AS domain, CASE WHEN c_custkey % 3 = 0 THEN 'inferred' ELSE 'published' END AS confidence FROM customer JOIN companies k ON k.id = 1 + c_custkey % (SELECT max(id) FROM companies))"


def emailed(spark, d):
    k = table(spark, d, "companies", "id", "domain").select(F.col("id").alias("company_id"), F.lower(F.trim("domain")).alias("domain"))
    n = F.col("id") % 4
    email = F.when(n == 0, F.concat(F.lit("a@"), "domain")).when(n == 1, F.concat(F.lit("a@mail."), "domain")).when(n == 2, F.lit("a@other.example"))
    return contacts(spark, d).join(k, "company_id").withColumn("email", email).withColumn("confidence", F.when(F.col("id") % 3 == 0, "inferred").otherwise("published"))


@q(
    "J3_RM3_contacts",
    f"""WITH {EMAILED} SELECT t.id, c.name AS company, t.name, k.c_mktsegment AS title, CASE WHEN t.email <> '' AND t.confidence = 'inferred' THEN '[UNVERIFIED: ' || t.email || ']' ELSE t.email END AS email,
  t.confidence, CASE WHEN t.id % 5 = 0 THEN 'https://people.example/in/' || t.id END AS linkedin, CAST(k.c_nationkey AS VARCHAR) AS source
FROM t JOIN companies c ON c.id = t.company_id JOIN customer k ON k.c_custkey = t.id""",
)
def _j3(spark, d):
    """All columns of the contacts; an address that was guessed can't be pasted as it is."""
    c = companies(spark, d).select(F.col("id").alias("company_id"), F.col("name").alias("company"))
    k = table(spark, d, "customer", "c_custkey", "c_nationkey").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("string").alias("source"))
    guessed = (F.col("email") != "") & (F.col("confidence") == "inferred")
    shown = F.when(guessed, F.concat(F.lit("[UNVERIFIED: "), "email", F.lit("]"))).otherwise(F.col("email"))
    linkedin = F.when(F.col("id") % 5 == 0, F.concat(F.lit("https://people.example/in/"), F.col("id").cast("string")))
    return emailed(spark, d).join(c, "company_id").join(k, "id").select("id", "company", "name", "title", shown.alias("email"), "confidence", linkedin.alias("linkedin"), "source")


@q("F18_domain_guard", f"WITH {EMAILED}, g AS (SELECT *, split_part(email, '@', 2) AS h FROM t) SELECT id, CASE WHEN email IS NULL OR domain IS NULL OR h = domain OR ends_with(h, '.' || domain) OR ends_with(domain, '.' || h) THEN email END AS email, coalesce(NOT (email IS NULL OR domain IS NULL OR h = domain OR ends_with(h, '.' || domain) OR ends_with(domain, '.' || h)), false) AS blanked FROM g")
def _f18(spark, d):
    h = F.substring_index("email", "@", -1)
    fine = F.coalesce(F.col("email").isNull() | F.col("domain").isNull() | (h == F.col("domain")) | h.endswith(F.concat(F.lit("."), "domain")) | F.col("domain").endswith(F.concat(F.lit("."), h)), F.lit(False))
    return emailed(spark, d).select("id", F.when(fine, F.col("email")).alias("email"), (~fine).alias("blanked"))


@q("P3_masked", f"WITH {EMAILED} SELECT id, CASE WHEN confidence = 'inferred' THEN '[UNVERIFIED: ' || email || ']' ELSE email END AS email FROM t")
def _p3(spark, d):
    return emailed(spark, d).select("id", F.when(F.col("confidence") == "inferred", F.concat(F.lit("[UNVERIFIED: "), "email", F.lit("]"))).otherwise(F.col("email")).alias("email"))


@q("F17_vocabulary", "SELECT priority IN ('high', 'normal') AS valid, count(*) AS n FROM (SELECT coalesce(priority, '') AS priority FROM companies) GROUP BY 1")
def _f17(spark, d):
    c = companies(spark, d).select("id", "name", F.coalesce("priority", F.lit("")).alias("priority"))
    good, dead = state.split_valid(c, F.col("priority").isin("high", "normal"), "company.bad_priority", "unknown priority", ["id", "priority"])
    return good.select(F.lit(True).alias("valid")).unionByName(dead.select(F.lit(False).alias("valid"))).groupBy("valid").agg(F.count("*").alias("n"))


@q("P5_RM8_due_labels", f"WITH {APPLICATION} SELECT id, CASE WHEN n < 0 THEN 'OVERDUE' WHEN n = 0 THEN 'DUE TODAY' ELSE 'in ' || n || 'd' END AS label FROM (SELECT id, date_diff('day', DATE '1998-06-15', applied_at + CASE isodow(applied_at) WHEN 6 THEN 6 WHEN 7 THEN 5 ELSE 7 END) AS n FROM a)")
def _p5(spark, d):
    n = F.datediff(dates.add_business_days(F.col("applied_at"), 5), F.lit("1998-06-15").cast("date"))
    return applications(spark, d).select("id", F.when(n < 0, "OVERDUE").when(n == 0, "DUE TODAY").otherwise(F.concat(F.lit("in "), n.cast("string"), F.lit("d"))).alias("label"))
