"""Queries of the stateful rules: upserts, links, lookups, feed health, and what they leave behind."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrycast.functions import domains, mail, text
from quarrycast.functions.funding import gate
from quarrycast.operators import health, state
from quarrycast.operators.listing import rank
from quarrycast.plans.base import CANON, NOW_ISO, Registry, sql_company, sql_title, sql_week
from quarrycast.plans.extraction import GATE, SENDER, SUBJECT, TOKENS, sql_company_in_subject
from quarrycast.runtime import table

q = Registry()

# --- upserts and links --------------------------------------------------------------------------------------------
VALUES = ["title", "jd_text", "location"]
DELIVERIES = range(1, 6)  #: fixed by the table
STAMP = "2026-03-0{n}T00:00:00+00:00"  #: when delivery n was taken
#: each delivery's last row of a key to arrive
BATCH = """b AS (SELECT * EXCLUDE (r) FROM (SELECT source, external_id, snapshot_no AS n, title, jd_text, location, 'https://x.example/' || snapshot_no || '/' || external_id AS url,
  row_number() OVER (PARTITION BY source, external_id, snapshot_no ORDER BY loaded_at DESC NULLS LAST, title DESC NULLS LAST, jd_text DESC NULLS LAST, location DESC NULLS LAST) AS r
  FROM job_snapshots WHERE external_id IS NOT NULL AND source IS NOT NULL) WHERE r = 1)"""
UPSERTED = f"""{BATCH}, k AS (SELECT source, external_id, min(n) AS first, max(n) AS last, string_agg(url, ' ' ORDER BY n) AS urls,
  arg_max(jd_text, n) FILTER (jd_text <> '') AS jd_text FROM b GROUP BY ALL),
u AS (SELECT k.source, k.external_id, b.title, coalesce(k.jd_text, nullif(b.jd_text, '')) AS jd_text, b.location, '2026-03-0' || last || 'T00:00:00+00:00' AS seen_at, '2026-03-0' || first || 'T00:00:00+00:00' AS first_seen_at, urls,
  CASE WHEN first = 5 THEN 'new' WHEN last = 5 THEN 'updated' ELSE 'kept' END AS outcome FROM k JOIN b ON b.source = k.source AND b.external_id = k.external_id AND b.n = k.last)"""


def upserted(spark, d):
    """The state after all deliveries, taken one after the other, with the outcomes of the last."""
    rows = table(spark, d, "job_snapshots", "snapshot_no", "source", "external_id", "loaded_at", *VALUES).where("external_id is not null and source is not null")
    url = F.concat_ws("/", F.lit("https://x.example"), F.col("snapshot_no").cast("string"), "external_id")
    rows = rows.select("snapshot_no", "source", "external_id", *VALUES, url.alias("url"), "loaded_at")
    out = rows.where("false").drop("snapshot_no", "loaded_at").select("*", F.lit("").alias("seen_at"), F.lit("").alias("first_seen_at"), F.array(F.lit("")).alias("source_urls"))
    for n in DELIVERIES:
        out = state.upsert(out.drop("outcome"), rows.where(F.col("snapshot_no") == n).drop("snapshot_no"), ["source", "external_id"], STAMP.format(n=n), ["jd_text"], ["loaded_at"])
    return out


@q("D1_upsert", f"WITH {UPSERTED} SELECT * FROM u")
def _d1(spark, d):
    return upserted(spark, d).select("source", "external_id", "title", F.expr("nullif(jd_text, '')").alias("jd_text"), "location", "seen_at", "first_seen_at", F.array_join("source_urls", " ").alias("urls"), "outcome")


@q("A6_tallies", f"WITH {UPSERTED} SELECT count(*) FILTER (outcome = 'new') AS new, count(*) FILTER (outcome = 'updated') AS updated, count(*) FILTER (outcome = 'kept') AS kept FROM u")
def _a6(spark, d):
    o = F.col("outcome")
    return upserted(spark, d).agg(*[F.count_if(o == x).alias(x) for x in ("new", "updated", "kept")])


@q("D2_J18_canonical", f"WITH {CANON} SELECT id, canonical_id FROM canon")
def _d2(spark, d):
    return state.canonical_of(table(spark, d, "jobs"), table(spark, d, "companies")).select("id", "canonical_id")


@q(
    "D2_link_new",
    f"""WITH {CANON}, old AS (SELECT id, dedupe_key, coalesce(source, '') AS source FROM canon WHERE id % 2 = 0 AND dedupe_key <> '||'), b AS (SELECT dedupe_key, min(id) AS id, arg_min(source, id) AS source FROM old GROUP BY 1),
s2 AS (SELECT o.dedupe_key, min(o.id) AS id FROM old o JOIN b ON b.dedupe_key = o.dedupe_key AND b.source <> o.source GROUP BY 1),
n AS (SELECT id, dedupe_key, coalesce(source, '') AS source FROM canon WHERE id % 2 = 1), f AS (SELECT dedupe_key, min(id) AS id, arg_min(source, id) AS source FROM n WHERE dedupe_key <> '||' GROUP BY 1)
SELECT n.id, CASE WHEN x < n.id THEN x END AS canonical_id FROM (SELECT n.*, CASE WHEN n.source <> coalesce(b.source, f.source) THEN coalesce(b.id, f.id) ELSE s2.id END AS x FROM n LEFT JOIN b USING (dedupe_key) LEFT JOIN f USING (dedupe_key) LEFT JOIN s2 USING (dedupe_key)) n""",
)
def _d2b(spark, d):
    j = state.canonical_of(table(spark, d, "jobs"), table(spark, d, "companies")).select("id", "dedupe_key", "source")
    return state.link_new(j.where("id % 2 = 1"), j.where("id % 2 = 0")).select("id", "canonical_id")


@q("D3_D8_dedupe_key", f"SELECT j.id, {sql_company('c.name')} || '|' || {sql_title('j.title')} || '|' || {sql_week('j.posted_at')} AS dedupe_key FROM jobs j LEFT JOIN companies c ON c.id = j.company_id")
def _d3(spark, d):
    return state.canonical_of(table(spark, d, "jobs"), table(spark, d, "companies")).select("id", "dedupe_key")


@q("D4_T2_insert_or_ignore", "SELECT url, min(item_id) AS item_id FROM feed_items WHERE url NOT IN (SELECT article_url FROM funding_items WHERE article_url IS NOT NULL) GROUP BY url")
def _d4(spark, d):
    known = table(spark, d, "funding_items", "article_url").select(F.col("article_url").alias("url"))
    return state.insert_or_ignore(table(spark, d, "feed_items", "url", "item_id"), known, ["url"], "item_id").select("url", "item_id")


@q("D5_latest_per_key", "SELECT board, id, max(fetched_at)::VARCHAR AS fetched_at FROM lever_postings GROUP BY ALL")
def _d5(spark, d):
    p = table(spark, d, "lever_postings", "board", "id", "fetched_at")
    return state.last_per_key(p, ["board", "id"], "fetched_at").select("board", "id", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("fetched_at"))


MEMBERS = "m AS (SELECT upper(name) AS name, NULL::VARCHAR AS domain, 'lever' AS ats, CASE WHEN id % 2 = 0 THEN slug END AS slug FROM companies WHERE watchlist_enabled = 1 UNION ALL SELECT s_name, 's' || s_suppkey || '.example', 'ashby', 's' || s_suppkey FROM supplier)"


@q(
    "D6_S14_sync_members",
    f"""WITH {MEMBERS} SELECT coalesce(c.name, m.name) AS name, coalesce(c.domain, m.domain) AS domain, CASE WHEN m.name IS NOT NULL THEN m.ats ELSE c.ats END AS ats, CASE WHEN m.name IS NOT NULL THEN m.slug ELSE c.slug END AS slug, c.last_polled_at,
  CASE WHEN c.name IS NULL THEN 'added' WHEN m.name IS NULL THEN 'kept' ELSE 'updated' END AS outcome FROM companies c FULL JOIN m ON lower(c.name) = lower(m.name)""",
)
def _d6(spark, d):
    c = table(spark, d, "companies", "id", "name", "domain", "ats", "slug", "last_polled_at", "watchlist_enabled")
    s = table(spark, d, "supplier", "s_suppkey", "s_name")
    key = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    m = c.where("watchlist_enabled = 1").select(F.upper("name").alias("name"), F.lit(None).cast("string").alias("domain"), F.lit("lever").alias("ats"), F.when(F.col("id") % 2 == 0, F.col("slug")).alias("slug"))
    m = m.unionByName(s.select(F.col("s_name").alias("name"), F.concat(key, F.lit(".example")).alias("domain"), F.lit("ashby").alias("ats"), key.alias("slug")))
    return state.sync_members(c.drop("id", "watchlist_enabled"), m, ["domain"], ["ats", "slug"])


LOOKUP = "bd AS (SELECT lower(trim(domain)) AS k, min(id) AS id FROM companies WHERE domain IS NOT NULL GROUP BY 1), bn AS (SELECT lower(name) AS k, min(id) AS id FROM companies WHERE name IS NOT NULL GROUP BY 1)"


@q("J9_domain_then_name", f"WITH {LOOKUP} SELECT f.id, coalesce(bd.id, bn.id) AS company_id FROM funding_items f LEFT JOIN bd ON bd.k = lower(trim(f.resolved_domain)) LEFT JOIN bn ON bn.k = lower(f.company_name)")
def _j9(spark, d):
    f = table(spark, d, "funding_items", "id", "resolved_domain", "company_name")
    return state.lookup_company(f, table(spark, d, "companies", "id", "name", "domain"), "resolved_domain", "company_name").select("id", "company_id")


@q(
    "D7_get_or_create",
    f"""WITH {LOOKUP}, n AS (SELECT DISTINCT f.company_name AS name FROM funding_items f LEFT JOIN bd ON bd.k = lower(trim(f.resolved_domain)) LEFT JOIN bn ON bn.k = lower(f.company_name) WHERE coalesce(bd.id, bn.id) IS NULL AND f.company_name <> '')
SELECT (SELECT max(id) FROM companies) + row_number() OVER (ORDER BY name) AS id, name FROM n""",
)
def _d7(spark, d):
    c = table(spark, d, "companies", "id", "name", "domain")
    f = table(spark, d, "funding_items", "id", "resolved_domain", "company_name")
    missing = state.lookup_company(f, c, "resolved_domain", "company_name").where("company_id is null and company_name <> ''").select(F.col("company_name").alias("name")).distinct()
    return state.new_ids(missing, c, ["name"])


@q(
    "D7_backfill",
    f"""WITH {LOOKUP}, f AS (SELECT bn.id AS cid, arg_min(trim(f.resolved_domain), f.id) AS domain FROM funding_items f JOIN bn ON bn.k = lower(f.company_name) WHERE trim(f.resolved_domain) <> '' AND lower(trim(f.resolved_domain)) NOT IN (SELECT k FROM bd) GROUP BY 1)
SELECT c.id, coalesce(c.domain, f.domain) AS domain FROM companies c LEFT JOIN f ON f.cid = c.id""",
)
def _d7b(spark, d):
    f = table(spark, d, "funding_items", "id", "resolved_domain", "company_name")
    return state.backfill(table(spark, d, "companies", "id", "name", "domain"), f, "resolved_domain", "company_name", "id").select("id", "domain")


@q("D9_F15_K5_dead_letters", "SELECT count(*) FILTER (nullif(trim(external_id), '') IS NOT NULL AND nullif(trim(title), '') IS NOT NULL) AS valid, count(*) FILTER (nullif(trim(external_id), '') IS NULL OR nullif(trim(title), '') IS NULL) AS dead FROM job_snapshots")
def _d9(spark, d):
    s = table(spark, d, "job_snapshots", "snapshot_no", "source", "board", "external_id", "title")
    fine = F.nullif(F.trim("external_id"), F.lit("")).isNotNull() & F.nullif(F.trim("title"), F.lit("")).isNotNull()
    good, dead = state.split_valid(s, fine, "ingest.incomplete_posting", "no id or title", ["snapshot_no", "source", "board", "external_id", "title"])
    both = good.select(F.lit(1).alias("g")).unionByName(dead.select(F.lit(0).alias("g")))
    return both.agg(F.count_if(F.col("g") == 1).alias("valid"), F.count_if(F.col("g") == 0).alias("dead"))


@q("F16_K5_near_misses", f"SELECT DISTINCT url, 'funding.near_miss' AS rule_id, 'mentions money' AS reason FROM feed_items WHERE ({GATE}) = 'near_miss'")
def _f16(spark, d):
    """Dead letters of headlines that mention money but are no funding news."""
    f = table(spark, d, "feed_items", "headline", "url")
    _, dead = state.split_valid(f, gate(F.col("headline")) != "near_miss", "funding.near_miss", "mentions money", ["headline", "url"])
    return dead.select(F.get_json_object("raw_payload", "$.url").alias("url"), "rule_id", "reason").distinct()


@q("D14_T4_window", "SELECT id, CAST(try_cast(left(announced_at, 10) AS DATE) + 60 AS VARCHAR) AS until FROM funding_items")
def _d14(spark, d):
    return table(spark, d, "funding_items", "id", "announced_at").select("id", F.date_format(F.date_add(F.substring("announced_at", 1, 10).try_cast("date"), 60), "yyyy-MM-dd").alias("until"))


@q(
    "D14_apply_funding",
    f"""WITH {LOOKUP}, f AS (SELECT coalesce(bd.id, bn.id) AS cid, arg_max(struct_pack(a := announced_at, r := round_stage, w := amount_raw), f.id) AS x FROM funding_items f LEFT JOIN bd ON bd.k = lower(trim(f.resolved_domain)) LEFT JOIN bn ON bn.k = lower(f.company_name) GROUP BY 1)
SELECT c.id, CASE WHEN f.cid IS NULL THEN c.recently_funded_at ELSE nullif(x.a, '') END AS recently_funded_at, CASE WHEN f.cid IS NULL THEN c.funding_stage ELSE nullif(x.r, '') END AS funding_stage,
  nullif(x.w, '') AS funding_amount_raw, CAST(try_cast(left(x.a, 10) AS DATE) + 60 AS VARCHAR) AS priority_until FROM companies c LEFT JOIN f ON f.cid = c.id""",
)
def _d14b(spark, d):
    c = table(spark, d, "companies", "id", "name", "domain", "recently_funded_at", "funding_stage")
    f = table(spark, d, "funding_items", "id", "resolved_domain", "company_name", "announced_at", "round_stage", "amount_raw")
    raises = state.lookup_company(f, c, "resolved_domain", "company_name").withColumnRenamed("id", "order")
    return state.apply_funding(c.drop("name", "domain"), raises, 60)


@q(
    "D17_mark_polled",
    f"""WITH e AS (SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT id, CASE WHEN user_id IS NOT NULL THEN '{NOW_ISO}' ELSE last_polled_at END AS last_polled_at, CASE WHEN event_type NOT IN ('error', 'signup') THEN 'v' || event_id ELSE 'old' END AS poll_etag
FROM companies LEFT JOIN e ON user_id = id""",
)
def _d17(spark, d):
    """Events as polls of the company with their user's number: the latest of each counts."""
    c = table(spark, d, "companies").withColumn("poll_etag", F.lit("old")).withColumn("poll_last_modified", F.lit(None).cast("string"))
    e, t = table(spark, d, "events", "user_id", "event_id", "event_type", "ts"), F.col("event_type")
    status = F.when(t == "error", 500).when(t == "signup", 304).otherwise(200)
    o = e.select(F.col("user_id").alias("company_id"), F.struct("ts", "event_id").alias("at"), status.alias("status"), F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("etag"), F.lit("x").alias("last_modified"))
    return state.mark_polled(c, o, NOW_ISO).select("id", "last_polled_at", "poll_etag")


# --- matching by domain and name ------------------------------------------------------------------------------------


@q("J10_domain_only", r"WITH bd AS (SELECT regexp_replace(lower(trim(domain)), '^www\.', '') AS k, min(id) AS company_id FROM companies WHERE domain IS NOT NULL GROUP BY 1) SELECT f.id, bd.company_id FROM funding_items f JOIN bd ON bd.k = regexp_replace(lower(trim(f.resolved_domain)), '^www\.', '')")
def _j10(spark, d):
    by = table(spark, d, "companies", "id", "domain").where("domain is not null").groupBy(domains.registrable(F.col("domain")).alias("k")).agg(F.min("id").alias("company_id"))
    f = table(spark, d, "funding_items", "id", "resolved_domain").withColumn("k", domains.registrable(F.col("resolved_domain")))
    return f.join(by, "k").select("id", "company_id")


TC = f"c AS (SELECT id, {TOKENS.format('name')} AS t FROM companies), f AS (SELECT id, {TOKENS.format('company_name')} AS t FROM funding_items)"


@q("J11_R10_collisions", f"WITH {TC} SELECT f.id, count(*) AS n, min(c.id) AS first_id FROM f JOIN c ON len(f.t) > 0 AND len(c.t) > 0 AND (f.t = c.t OR (f.t[1] = c.t[1] AND length(f.t[1]) >= 4)) GROUP BY 1")
def _j11(spark, d):
    """How many companies' names resemble the item's: counted per first word and per whole list, so no pair is made."""
    tokens = lambda n: domains.name_tokens(F.col(n)).alias("t")
    c = table(spark, d, "companies", "id", "name").select("id", tokens("name")).where("size(t) > 0")
    long_ = F.length(F.get("t", F.lit(0))) >= 4
    by_first = c.where(long_).groupBy(F.get("t", F.lit(0)).alias("k")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    by_list = c.where(~long_).groupBy(F.array_join("t", " ").alias("k")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    f = table(spark, d, "funding_items", "id", "company_name").select("id", tokens("company_name")).where("size(t) > 0")
    a = f.where(long_).select("id", F.get("t", F.lit(0)).alias("k")).join(by_first, "k")
    b = f.where(~long_).select("id", F.array_join("t", " ").alias("k")).join(by_list, "k")
    return a.unionByName(b).select("id", "n", "first_id")


@q(
    "J12_sender_domain",
    f"""WITH m AS (SELECT DISTINCT gmail_id, {SENDER} AS d FROM mail_messages), c AS (SELECT lower(trim(domain)) AS k, min(id) AS id FROM companies WHERE domain IS NOT NULL GROUP BY 1)
SELECT gmail_id, min(c.id) AS company_id FROM m JOIN c ON c.k = m.d OR c.k = array_to_string(list_slice(string_split(m.d, '.'), -2, -1), '.') GROUP BY 1""",
)
def _j12(spark, d):
    """Two keys for each sender, its domain and the last two labels, joined by equality."""
    m = table(spark, d, "mail_messages", "gmail_id", "from_addr").distinct()
    s = mail.sender_domain(F.col("from_addr"))
    keys = m.select("gmail_id", F.explode(F.array_distinct(F.array(s, mail.strip_subdomain(s)))).alias("k")).distinct()
    c = table(spark, d, "companies", "id", "domain").where("domain is not null").groupBy(F.lower(F.trim("domain")).alias("k")).agg(F.min("id").alias("id"))
    return keys.join(c, "k").groupBy("gmail_id").agg(F.min("id").alias("company_id"))


@q(
    "J13_subject_prefix",
    f"""WITH m AS (SELECT DISTINCT lower({sql_company_in_subject()}) AS g FROM mail_messages), h AS (SELECT g, count(*) AS n, min(c.id) AS one, min(c.id) FILTER (lower(c.name) = g) AS exact FROM m JOIN companies c ON starts_with(lower(c.name), g) WHERE g <> '' GROUP BY 1)
SELECT g AS guess, coalesce(exact, CASE WHEN n = 1 THEN one END) AS company_id, n FROM h""",
)
def _j13(spark, d):
    """Companies under all beginnings of their names, counted, so that the prefix match is one equality join."""
    c = table(spark, d, "companies", "id", "name").select("id", F.lower("name").alias("n")).where("n <> ''")
    starts = c.select("id", "n", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("n")), lambda k: F.substring(F.col("n"), F.lit(1), k))).alias("guess"))
    by = starts.groupBy("guess").agg(F.count("*").alias("n"), F.min("id").alias("one"), F.min(F.when(F.col("n") == F.col("guess"), F.col("id"))).alias("exact"))
    g = table(spark, d, "mail_messages", "subject").select(F.lower(mail.company_from_subject(F.col("subject"))).alias("guess")).where("guess <> ''").distinct()
    return g.join(by, "guess").select("guess", F.coalesce("exact", F.when(F.col("n") == 1, F.col("one"))).alias("company_id"), "n")


@q("J14_thread_first", "SELECT thread_id, arg_min(gmail_id, (received_at, gmail_id)) AS gmail_id FROM (SELECT DISTINCT thread_id, gmail_id, received_at FROM mail_messages WHERE received_at IS NOT NULL) GROUP BY 1")
def _j14(spark, d):
    m = table(spark, d, "mail_messages", "thread_id", "gmail_id", "received_at").where("received_at is not null")
    return m.groupBy("thread_id").agg(F.min_by("gmail_id", F.struct("received_at", "gmail_id")).alias("gmail_id"))


@q("J16_unnotified", "SELECT DISTINCT user_id, CAST(ts AS DATE)::VARCHAR AS day FROM events e WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM events n WHERE n.event_type = 'signup' AND n.user_id = e.user_id AND CAST(n.ts AS DATE) = CAST(e.ts AS DATE))")
def _j16(spark, d):
    """Errors of a day that no notice of the same day and user answers; sign-ups stand for notices."""
    e = table(spark, d, "events", "ts", "user_id", "event_type").select("event_type", "user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    of = lambda kind: e.where(F.col("event_type") == kind).select("user_id", "day").distinct()
    return of("error").join(of("signup"), ["user_id", "day"], "left_anti")


# --- feed health ------------------------------------------------------------------------------------------------------
#: events as polls of their user's feed
POLL = "p AS (SELECT user_id AS target, event_id AS id, event_type <> 'error' AS ok, CASE event_type WHEN 'error' THEN 404 WHEN 'signup' THEN 304 ELSE 200 END AS status, CASE event_type WHEN 'error' THEN NULL WHEN 'signup' THEN NULL WHEN 'view' THEN 0 ELSE CAST(floor(value) AS INT) + 1 END AS items FROM events)"
KINDS = "CASE WHEN NOT ok THEN 'f' WHEN status = 304 THEN 'u' WHEN items = 0 THEN 'e' ELSE 'p' END"
REASONED = f"{POLL}, w AS (SELECT *, array_to_string(list_reverse(list({KINDS}) OVER (PARTITION BY target ORDER BY id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)), '') AS trail FROM p), r AS (SELECT *, CASE WHEN regexp_matches(trail, '^f{{3,}}') THEN 'failing' WHEN regexp_matches(trail, '^u*(eu*){{3,}}p') THEN 'empty' END AS reason FROM w)"


def polls(spark, d):
    e, t = table(spark, d, "events", "user_id", "event_id", "event_type", "value"), F.col("event_type")
    items = F.when(t.isin("error", "signup"), None).when(t == "view", 0).otherwise(F.floor("value").cast("int") + 1)
    return e.select(F.col("user_id").alias("target"), F.col("event_id").alias("id"), (t != "error").alias("ok"), F.when(t == "error", 404).when(t == "signup", 304).otherwise(200).alias("status"), items.alias("item_count"))


@q("W1_last_polls", f"WITH {POLL} SELECT target, id, row_number() OVER (PARTITION BY target ORDER BY id DESC) AS rn FROM p QUALIFY rn <= 30")
def _w1(spark, d):
    return health.last_polls(polls(spark, d), ["target"], "id").select("target", "id", "rn")


@q("W2_diagnosis", f"WITH {REASONED} SELECT target, reason FROM r QUALIFY row_number() OVER (PARTITION BY target ORDER BY id DESC) = 1")
def _w2(spark, d):
    return health.diagnose(polls(spark, d), ["target"], "id").select("target", "reason")


W3 = f"""{REASONED}, b AS (SELECT *, reason IS NOT NULL AND lag(reason) OVER (PARTITION BY target ORDER BY id) IS NULL AS begin, lead(id) OVER (PARTITION BY target ORDER BY id) AS nxt FROM r),
i AS (SELECT *, sum(begin::INT) OVER (PARTITION BY target ORDER BY id) AS island FROM b),
al AS (SELECT target, min(id) AS raised_at, arg_min(reason, id) AS reason, last(nxt ORDER BY id) AS resolved_at FROM i WHERE reason IS NOT NULL GROUP BY target, island)"""


@q("W3_alert_history", f"WITH {W3} SELECT * FROM al")
def _w3(spark, d):
    return health.alerts(polls(spark, d), ["target"], "id").select("target", "raised_at", "reason", "resolved_at")


@q("F11_K4_open_alerts", f"WITH {W3} SELECT target, CASE WHEN reason = 'failing' THEN target || ': board is returning errors' ELSE target || ': board went empty' END AS message FROM al WHERE resolved_at IS NULL")
def _f11(spark, d):
    a = health.alerts(polls(spark, d), ["target"], "id").where("resolved_at is null")
    return a.select("target", health.message(F.col("target").cast("string"), F.col("reason")).alias("message"))


@q("J17_P7_RM7_watchlist", f"WITH {W3} SELECT c.id, c.name, concat_ws(' ', CASE WHEN al.target IS NOT NULL THEN 'STALE' END, CASE WHEN coalesce(c.slug, '') = '' THEN 'needs-slug' END) AS flag FROM companies c LEFT JOIN al ON al.target = c.id AND al.resolved_at IS NULL WHERE c.watchlist_enabled = 1")
def _j17(spark, d):
    stale = health.alerts(polls(spark, d), ["target"], "id").where("resolved_at is null").select(F.col("target").alias("id"), F.lit("STALE").alias("stale"))
    c = table(spark, d, "companies", "id", "name", "slug", "watchlist_enabled").where("watchlist_enabled = 1").join(stale, "id", "left")
    return c.select("id", "name", F.concat_ws(" ", "stale", F.when(F.coalesce("slug", F.lit("")) == "", "needs-slug")).alias("flag"))


@q("W2_board_polls", "SELECT source, board, count(*) AS polls, count(*) FILTER (NOT ok) AS failed FROM (SELECT source, board, snapshot_no, min(coalesce(poll_ok, 1)) = 1 AS ok FROM job_snapshots GROUP BY ALL) GROUP BY ALL")
def _w2b(spark, d):
    s = table(spark, d, "job_snapshots", "source", "board", "snapshot_no", "poll_ok").groupBy("source", "board", "snapshot_no").agg((F.min(F.coalesce("poll_ok", F.lit(1))) == 1).alias("ok"))
    return s.groupBy("source", "board").agg(F.count("*").alias("polls"), F.count_if(~F.col("ok")).alias("failed"))
