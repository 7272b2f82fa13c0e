"""Queries of the text functions, extraction rules and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrycast.functions import dates, domains, funding, mail, text, urls
from quarrycast.functions.rx import re2
from quarrycast.plans.base import NOW, Registry, sql_company, sql_day, sql_instant, sql_title, sql_week
from quarrycast.runtime import table
from quarrycast.sources import boards, feeds, mailbox, pages, transport

q = Registry()


def simple(name, tab, key, column, expression, sql, distinct=False):
    """A query of one function over one column."""

    @q(name, f"SELECT {'DISTINCT ' if distinct else ''}{key}, {sql} AS value FROM {tab}")
    def _(spark, d):
        out = table(spark, d, tab, *dict.fromkeys([key, *column.split()])).select(key, expression().alias("value"))
        return out.distinct() if distinct else out


c = F.col
# --- normalisation ----------------------------------------------------------------------------------------------
simple("N4_norm_company", "companies", "id", "name", lambda: text.norm_company(c("name")), sql_company("name"))
simple("N5_norm_title", "jobs", "id", "title", lambda: text.norm_title(c("title")), sql_title("title"))
simple("N6_posted_week", "jobs", "id", "posted_at", lambda: dates.posted_week(c("posted_at")), sql_week("posted_at"))
simple("N7_parse_instant", "jobs", "id", "posted_at", lambda: F.unix_seconds(dates.parse_instant(c("posted_at"))), f"CAST({sql_instant('posted_at')} AS BIGINT)")
simple("N14_day_part", "jobs", "id", "posted_at", lambda: dates.day_part(c("posted_at")).cast("string"), r"CASE WHEN regexp_matches(posted_at, '^\d{4}-\d\d-\d\d([T ]\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)?)?$') THEN CAST(try_cast(left(posted_at, 10) AS DATE) AS VARCHAR) END")
simple("N17_days_ago", "jobs", "id", "seen_at", lambda: dates.days_ago(c("seen_at"), NOW), f"CAST(trunc(({int(NOW.timestamp())} - {sql_instant('seen_at')}) / 86400) AS BIGINT)")
simple("N11_epoch_iso", "events", "event_id", "event_id", lambda: dates.epoch_ms_iso(F.lit(1700000000000) + c("event_id") * 86399001), "strftime(epoch_ms(1700000000000 + event_id * 86399001), '%Y-%m-%dT%H:%M:%S+00:00')")
simple("N12_business_days", "orders", "o_orderkey", "o_orderdate", lambda: dates.add_business_days(c("o_orderdate").cast("date"), 5).cast("string"), "CAST(CAST(o_orderdate AS DATE) + CASE isodow(CAST(o_orderdate AS DATE)) WHEN 6 THEN 6 WHEN 7 THEN 5 ELSE 7 END AS VARCHAR)")
CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, chr(160), ' ', 'g'), '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[\s\x0b]+|[\s\x0b]+$', '', 'g')"
simple("N9_clean", "mail_messages", "gmail_id", "body", lambda: text.clean(c("body")), CLEAN.format(x="body"), distinct=True)
simple("N8_strip_html", "lever_postings", "id", "description_plain", lambda: text.strip_html(F.concat(F.lit("&lt;p&gt;V&lt;b&gt;isa&lt;/b&gt; &amp;amp; more<br/>"), F.coalesce(c("description_plain"), F.lit("")), F.lit("</p><ul><li>x</li></ul>"))), CLEAN.format(x="('Visa & more' || chr(10) || coalesce(description_plain, '') || chr(10) || 'x' || chr(10) || chr(10))"), distinct=True)


@q("N10_json_string", "SELECT event_id, CAST(event_id AS VARCHAR) AS id_text, nullif(trim(event_type), '') AS kind, NULL::VARCHAR AS nothing FROM events")
def _n10(spark, d):
    e = table(spark, d, "events", "event_id", "event_type")
    j = F.to_json(F.struct(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.array(F.lit(1)).alias("list")).alias("a")))
    return e.select("event_id", text.json_string(j, "$.a.id").alias("id_text"), text.json_string(j, "$.a.kind").alias("kind"), text.json_string(j, "$.a.list").alias("nothing"))


RFC = r"'^([A-Za-z]{3}, )?(\d{1,2}) ([A-Z][a-z]{2}) (\d{4}) (\d\d:\d\d:\d\d) ([+-]\d\d)(\d\d)$'"


@q(
    "N15_to_iso",
    rf"""WITH v AS (SELECT DISTINCT item_id, trim(published_at) AS p FROM feed_items WHERE regexp_matches(trim(published_at), {RFC}))
SELECT item_id, regexp_extract(p, {RFC}, 4) || '-' || lpad(CAST(1 + (instr('JanFebMarAprMayJunJulAugSepOctNovDec', regexp_extract(p, {RFC}, 3)) - 1) // 3 AS VARCHAR), 2, '0') || '-' || lpad(regexp_extract(p, {RFC}, 2), 2, '0')
  || 'T' || regexp_extract(p, {RFC}, 5) || regexp_extract(p, {RFC}, 6) || ':' || regexp_extract(p, {RFC}, 7) AS value FROM v""",
)
def _n15(spark, d):
    f = table(spark, d, "feed_items", "item_id", "published_at").where(F.trim("published_at").rlike(RFC.strip("'")))
    return f.select("item_id", dates.to_iso(F.col("published_at")).alias("value")).distinct()


@q("N13_since", "SELECT 'a' AS form, '2026-10-08T00:00:00' AS since UNION ALL SELECT 'b', '2026-10-13T00:00:00' UNION ALL SELECT 'c', '2026-10-01T00:00:00' UNION ALL SELECT 'd', '2026-08-01T00:00:00'")
def _n13(spark, d):
    forms = {"a": "7d", "b": "48h", "c": "2w", "d": "2026-08-01"}
    return spark.createDataFrame([(k, dates.parse_since(v, NOW).strftime("%Y-%m-%dT%H:%M:%S")) for k, v in forms.items()], "form string, since string")


# --- funding headlines --------------------------------------------------------------------------------------------
H = "headline"


def sql_first(x, rules):
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, {re2(p)}) THEN '{v}'" for p, v in rules) + " END"


def sql_any(x, patterns):
    return "(" + " OR ".join(f"regexp_matches({x}, {re2(p)})" for p in patterns) + ")"


SQ = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
AMOUNT = SQ.format(f"regexp_extract({H}, {re2(funding.AMOUNT)}, 0)")
STAGE = f"coalesce({sql_first(H, funding.STAGES)}, 'unknown')"
CURRENCY = f"coalesce({sql_first(f'coalesce(nullif({AMOUNT}, {chr(39) * 2}), {H})', funding.CURRENCIES)}, '')"
NAME = f"regexp_extract({H}, {re2('^(.*?)' + funding.VERB)}, 1)"
for _p in funding.PREFIXES:
    NAME = f"regexp_replace({NAME}, {re2(_p)}, '')"
NAME = f"regexp_replace(trim({NAME}), {re2(funding.AUXILIARY)}, '')"
NAME = f"regexp_replace(rtrim(trim({NAME}), ','), {re2(funding.DESCRIPTOR)}, '')"
NAME = f"CASE WHEN regexp_matches({H}, {re2(funding.VERB)}) THEN trim(regexp_replace(trim({NAME}), {re2(funding.TRAILING_NOUN)}, ''), ' -–—:|,') ELSE '' END"
INVESTORS = f"array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_extract({H}, {re2(funding.INVESTOR_CLAUSE)}, 1), {re2(funding.INVESTOR_SPLIT)}), lambda x: trim(x, ' .,-–—;:')), lambda x: length(x) > 1 AND NOT regexp_matches(x, {re2(funding.NO_INVESTOR)})), ' | ')"
GATE = f"CASE WHEN {sql_any(H, funding.VETOES)} THEN CASE WHEN {sql_any(H, funding.NEAR_MISSES)} THEN 'near_miss' ELSE 'vetoed' END WHEN {sql_any(H, funding.TRIGGERS)} THEN 'funding' WHEN {sql_any(H, funding.NEAR_MISSES)} THEN 'near_miss' ELSE 'other' END"
CONFIDENCE = f"CASE WHEN ({NAME}) <> '' AND NOT regexp_matches(({NAME}), {re2(funding.SEVERAL)}) AND ({STAGE}) <> 'unknown' AND ({AMOUNT}) <> '' THEN 'high' ELSE 'low' END"
for _name, _f, _sql in (
    ("F16_gate", funding.gate, GATE),
    ("X1_round_stage", funding.stage, STAGE),
    ("X2_currency", funding.currency, CURRENCY),
    ("X3_amount", funding.amount, AMOUNT),
    ("X4_company_name", funding.company_name, NAME),
    ("X5_investors", lambda h: F.array_join(funding.investors(h), " | "), INVESTORS),
    ("X6_confidence", funding.confidence, CONFIDENCE),
):
    simple(_name, "feed_items", "item_id", H, lambda f=_f: f(c(H)), _sql, distinct=True)


@q("K7_extracted_json", f"SELECT DISTINCT item_id, {NAME} AS company_name, {STAGE} AS round_stage, {AMOUNT} AS amount_raw, {CURRENCY} AS currency, {INVESTORS} AS investors FROM feed_items")
def _k7(spark, d):
    f = table(spark, d, "feed_items", "item_id", H).distinct()
    out = f.select("item_id", F.to_json(F.struct(funding.company_name(c(H)).alias("company_name"), funding.stage(c(H)).alias("round_stage"), funding.amount(c(H)).alias("amount_raw"), funding.currency(c(H)).alias("currency"), F.array_join(funding.investors(c(H)), " | ").alias("investors"))).alias("j"))
    return out.select("item_id", F.from_json("j", "company_name string, round_stage string, amount_raw string, currency string, investors string").alias("x")).select("item_id", "x.*")


# --- domains --------------------------------------------------------------------------------------------------------
#: a column of hosts with publishers among them
HOST = lambda: F.when(c("id") % 5 == 0, "Blog.Medium.com").when(c("id") % 5 == 1, "www.linkedin.com").otherwise(F.coalesce("domain", F.lit("")))
HOST_SQL = "CASE WHEN id % 5 = 0 THEN 'Blog.Medium.com' WHEN id % 5 = 1 THEN 'www.linkedin.com' ELSE coalesce(domain, '') END"
REG = r"regexp_replace(lower(trim({})), '^www\.', '')"
simple("R1_registrable", "companies", "id", "domain", lambda: domains.registrable(c("domain")), REG.format("domain"))
PUBLISHERS = "(" + ", ".join(f"'{p}'" for p in domains.PUBLISHERS) + ")"
simple("R2_publisher", "companies", "id", "domain", lambda: domains.is_publisher(domains.registrable(HOST())), f"EXISTS (SELECT 1 FROM (VALUES {', '.join(f'({chr(39)}{p}{chr(39)})' for p in domains.PUBLISHERS)}) b(x) WHERE {REG.format(HOST_SQL)} = x OR ends_with({REG.format(HOST_SQL)}, '.' || x))")
TOKENS = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda x: length(x) >= 3 AND x NOT IN (" + ", ".join(f"'{w}'" for w in domains.STOPWORDS) + "))"
DTOKENS = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda x: x <> '' AND x NOT IN (" + ", ".join(f"'{w}'" for w in domains.LEGAL_ONLY) + "))"
simple("R3_name_tokens", "companies", "id", "name", lambda: F.array_join(domains.name_tokens(c("name")), " "), f"array_to_string({TOKENS.format('name')}, ' ')")
simple("R6_domain_tokens", "companies", "id", "name", lambda: F.array_join(domains.domain_tokens(c("name")), " "), f"array_to_string({DTOKENS.format('name')}, ' ')")
LABEL = f"replace(split_part({REG.format('domain')}, '.', 1), '-', '')"
JOINED = f"array_to_string({TOKENS.format('name')}, '')"
simple("R4_domain_matches", "companies", "id", "domain name", lambda: domains.domain_matches_name(c("domain"), c("name")), f"coalesce({LABEL} <> '' AND len({TOKENS.format('name')}) > 0 AND ({LABEL} = {JOINED} OR {LABEL} = ({TOKENS.format('name')})[1] OR (starts_with({JOINED}, {LABEL}) AND length({LABEL}) >= 5) OR (starts_with({LABEL}, {JOINED}) AND length({JOINED}) >= 5)), false)")
GUESS = "CASE WHEN len({t}) >= 2 AND length({j}) >= 4 THEN " + " || ' ' || ".join(f"'{p}' || {{j}} || '.{t}'" for p, t in [("", t) for t in domains.TLDS] + [("get", t) for t in domains.TLDS[:2]]) + " ELSE '' END"
simple("R7_guesses", "companies", "id", "name", lambda: F.array_join(domains.guess_domains(c("name")), " "), GUESS.format(t=DTOKENS.format("name"), j=f"array_to_string({DTOKENS.format('name')}, '')"))
PAGE = lambda: F.concat(F.lit('<p><a class="x" href="https://WWW.LinkedIn.com/in/a">a</a> <A href="https://www.'), F.col("slug"), F.lit('.example/about">b</A><a href=\'/local\'>c</a><a href="https://'), F.col("slug"), F.lit('.example">d</a> for '), F.col("name"))
simple("R5_outbound_hosts", "companies", "id", "slug name", lambda: F.array_join(domains.candidate_domains(PAGE()), " "), "slug || '.example'")
simple("R8_verified_page", "companies", "id", "slug name", lambda: domains.page_names_company(F.when(c("id") % 3 == 0, F.concat(c("name"), F.lit(" - this domain is for sale"))).when(c("id") % 3 == 1, F.lit("hello")).otherwise(c("name")), c("name")), f"CASE WHEN id % 3 = 0 THEN false WHEN id % 3 = 1 THEN len({TOKENS.format('name')}) = 0 ELSE true END")

# --- mails ----------------------------------------------------------------------------------------------------------
ADDRESS = "CASE WHEN regexp_matches(trim(from_addr), '(?s)^.*<[^>]*>') THEN trim(regexp_extract(trim(from_addr), '(?s)^.*<([^>]*)>', 1)) ELSE trim(from_addr) END"
SENDER = f"CASE WHEN contains(({ADDRESS}), '@') THEN lower(trim(regexp_replace(({ADDRESS}), '(?s)^[^@]*@', ''))) ELSE '' END"
LOCAL = f"split_part(lower({ADDRESS}), '@', 1)"
AUTOMATED = f"(NOT contains(({ADDRESS}), '@') OR " + " OR ".join(f"contains({LOCAL}, '{m}')" for m in mail.AUTOMATED) + ")"
simple("M3_address", "mail_messages", "gmail_id", "from_addr", lambda: mail.address(c("from_addr")), ADDRESS, distinct=True)
simple("M3_domain", "mail_messages", "gmail_id", "from_addr", lambda: mail.sender_domain(c("from_addr")), SENDER, distinct=True)
simple("M2_automated", "mail_messages", "gmail_id", "from_addr", lambda: mail.is_automated(c("from_addr")), AUTOMATED, distinct=True)
simple("M6_strip_subdomain", "mail_messages", "gmail_id", "from_domain", lambda: mail.strip_subdomain(c("from_domain")), "array_to_string(list_slice(string_split(from_domain, '.'), -2, -1), '.')", distinct=True)
VIA = lambda: F.regexp_replace(c("from_addr"), r"@[\w.-]*quillmarsh\.example", "@us.greenhouse-mail.io")
simple("M4_platform", "mail_messages", "gmail_id", "from_addr", lambda: mail.is_platform(VIA()), r"regexp_matches(from_addr, '@[\w.-]*quillmarsh\.example')", distinct=True)
SUBJECT = f"regexp_replace(trim(subject), {re2(mail.SUBJECT_PREFIX)}, '')"


def sql_company_in_subject():
    parts = []
    for p in mail.SUBJECT_COMPANY:
        x = f"trim(trim(nullif(regexp_extract({SUBJECT}, {re2(p)}, 1), '')), '-–—|,:;.!\"'' ')"
        for t in mail.COMPANY_TAILS:
            x = rf"regexp_replace({x}, {re2(t.replace('.', chr(92) + '.') + '$')}, '')"
        parts.append(f"CASE WHEN length({x}) >= 2 AND split_part(lower({x}), ' ', 1) NOT IN ({', '.join(chr(39) + w + chr(39) for w in mail.STOP_FIRST)}) THEN {x} END")
    return f"coalesce({', '.join(parts)}, '')"


simple("M5_subject_company", "mail_messages", "gmail_id", "subject", lambda: mail.company_from_subject(c("subject")), sql_company_in_subject(), distinct=True)
HAY = "(coalesce(subject, '') || chr(10) || coalesce(snippet, '') || chr(10) || coalesce(body, ''))"
KIND = f"CASE WHEN {sql_any(HAY, mail.REJECTION)} THEN 'rejection' WHEN {sql_any(HAY, mail.CONFIRMATION)} THEN 'confirmation' WHEN NOT {AUTOMATED.replace('from_addr', 'coalesce(from_addr, ' + chr(39) * 2 + ')')} AND starts_with(lower(trim(coalesce(subject, ''))), 're:') THEN 'reply' ELSE 'other' END"
simple("M1_kind", "mail_messages", "gmail_id", "from_addr subject snippet body", lambda: mail.kind(c("from_addr"), c("subject"), c("snippet"), c("body")), KIND, distinct=True)

# --- urls -----------------------------------------------------------------------------------------------------------
REAL = lambda: F.regexp_replace("url", r"^https://boards\.example/(\w+)/", "https://jobs.$1.co/")
REAL_SQL = r"regexp_replace(url, '^https://boards\.example/(\w+)/', 'https://jobs.\1.co/')"
simple("S17_board_of", "jobs", "id", "url", lambda: F.concat_ws("/", urls.board_of(F.concat(F.lit("see https://jobs.lever.co/jobs and "), REAL()))["ats"], urls.board_of(F.concat(F.lit("see https://jobs.lever.co/jobs and "), REAL()))["slug"]), rf"CASE WHEN regexp_matches({REAL_SQL}, '^https://jobs\.lever\.co/') THEN 'lever/' || trim(regexp_extract({REAL_SQL}, 'jobs\.lever\.co/([A-Za-z0-9_.-]+)', 1), '/.') ELSE '' END")
simple("U1_domain_from_url", "jobs", "id", "url", lambda: urls.domain_from_url(REAL()), rf"CASE WHEN regexp_matches({REAL_SQL}, '^https://jobs\.lever\.co/') THEN '' ELSE regexp_replace(lower(regexp_extract({REAL_SQL}, '^[a-z]+://([^/?#:]+)', 1)), '^www\.', '') END")
simple("U1_company_from_url", "companies", "id", "domain", lambda: urls.company_from_url(F.concat(F.lit("https://jobs."), F.regexp_replace(F.lower(F.trim("domain")), r"^(https?://)?(www\.)?", ""))), r"CASE WHEN domain IS NULL THEN 'Unknown' ELSE coalesce(nullif(array_to_string(list_transform(string_split(split_part(split_part(regexp_replace(lower(trim(domain)), '^(https?://)?(www\.)?', ''), '/', 1), '.', 1), '-'), lambda w: upper(w[1]) || w[2:]), ' '), ''), 'Unknown') END")
simple("U2_absolute", "feed_items", "item_id", "url", lambda: urls.absolute(c("url"), F.lit("/next?p=2")), r"regexp_extract(url, '^([a-z]+://[^/]+)', 1) || '/next?p=2'", distinct=True)
simple("U3_sheet_id", "companies", "id", "slug", lambda: urls.sheet_id(F.when(c("id") % 2 == 0, F.concat(F.lit("https://docs.example/spreadsheets/d/"), c("slug"), F.lit("/edit#gid=0"))).otherwise(F.concat(F.lit(" "), c("slug")))), "slug")

# --- sources --------------------------------------------------------------------------------------------------------


@q(
    "S2_board_greenhouse",
    f"SELECT CAST(id AS VARCHAR) AS external_id, trim(title) AS title, url, nullif(trim(posted_at), '') AS posted_at, nullif(trim(location), '') AS location, {CLEAN.format(x='coalesce(jd_text, ' + chr(39) * 2 + ')')} AS jd_text FROM jobs WHERE nullif(trim(title), '') IS NOT NULL",
)
def _s2(spark, d):
    """One captured payload for each posting, escaped twice as that board does, and read back."""
    esc = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    j = table(spark, d, "jobs", "id", "title", "url", "posted_at", "location", "jd_text")
    content = esc(F.concat(F.lit("<p>"), esc(F.coalesce("jd_text", F.lit(""))), F.lit("</p>")))
    body = F.to_json(F.struct(F.array(F.struct("id", "title", F.col("url").alias("absolute_url"), F.col("posted_at").alias("updated_at"), F.struct(F.col("location").alias("name")).alias("location"), content.alias("content"))).alias("jobs")))
    return boards.greenhouse(j.select(body.alias("body"))).select("external_id", "title", "url", "posted_at", "location", "jd_text")


@q(
    "S3_board_lever",
    f"SELECT DISTINCT id AS external_id, trim(text) AS title, hosted_url AS url, strftime(epoch_ms(CAST(floor(try_cast(trim(created_at) AS DOUBLE)) AS BIGINT)), '%Y-%m-%dT%H:%M:%S+00:00') AS posted_at, nullif(trim(categories.location), '') AS location, nullif(trim(categories.commitment), '') AS employment_type, {CLEAN.format(x='coalesce(description_plain, ' + chr(39) * 2 + ')')} AS jd_text FROM lever_postings WHERE nullif(trim(text), '') IS NOT NULL",
)
def _s3(spark, d):
    p = table(spark, d, "lever_postings")
    body = F.to_json(F.array(F.struct("id", "text", F.col("hosted_url").alias("hostedUrl"), F.col("created_at").alias("createdAt"), "categories", F.col("description_plain").alias("descriptionPlain"))))
    return boards.lever(p.select(body.alias("body"))).select("external_id", "title", "url", "posted_at", "location", "employment_type", "jd_text").distinct()


ASHBY_PAY = "list_filter(coalesce(compensation, []), lambda x: lower(trim(x.compensation_type)) = 'salary')"


@q(
    "S4_A5_board_ashby",
    f"SELECT DISTINCT id AS external_id, trim(title) AS title, is_remote AS remote, nullif(trim(employment_type), '') AS employment_type, nullif(trim(location), '') AS location, list_min(list_transform({ASHBY_PAY}, lambda x: x.min_value)) AS pay_min, list_max(list_transform({ASHBY_PAY}, lambda x: x.max_value)) AS pay_max, list_filter(list_transform({ASHBY_PAY}, lambda x: nullif(trim(x.currency_code), '')), lambda x: x IS NOT NULL)[1] AS pay_currency FROM ashby_postings WHERE nullif(trim(title), '') IS NOT NULL",
)
def _s4(spark, d):
    p = table(spark, d, "ashby_postings")
    parts = F.transform("compensation", lambda x: F.struct(x["compensation_type"].alias("compensationType"), x["min_value"].alias("minValue"), x["max_value"].alias("maxValue"), x["currency_code"].alias("currencyCode")))
    body = F.to_json(F.struct(F.array(F.struct("id", "title", F.col("job_url").alias("jobUrl"), F.col("published_at").alias("publishedAt"), F.col("employment_type").alias("employmentType"), "location", F.col("is_remote").alias("isRemote"), F.col("description_plain").alias("descriptionPlain"), F.struct(parts.alias("summaryComponents")).alias("compensation"))).alias("jobs")))
    return boards.ashby(p.select(body.alias("body"))).select("external_id", "title", "remote", "employment_type", "location", "pay_min", "pay_max", "pay_currency").distinct()


def _xml(x):
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")


#: the sources of feed_items, each read as a feed of its own
FEEDS = ["coastline_vc", "deccan_ledger", "harbour_capital", "prairie_wire", "roundtrack", "rundschau_gruender", "seedline", "straits_founder"]


def _each_feed(spark, d, body, config):
    """(headline, url, source) of all rows, each source's written as a body and read with the source's config."""
    out = None
    for name in FEEDS:
        f = table(spark, d, "feed_items", "headline", "url", "published_at", "source").where(F.col("source") == name)
        one = feeds.read(f.select(body.alias("body")), config(name)).select("headline", "url", "source")
        out = one if out is None else out.unionByName(one)
    return out.distinct()


@q("S5_feed_rss", "SELECT DISTINCT trim(headline) AS headline, trim(url) AS url, source FROM feed_items WHERE trim(headline) <> '' AND trim(url) <> '' AND source IS NOT NULL")
def _s5(spark, d):
    body = F.concat(F.lit('<?xml version="1.0"?><rss version="2.0" xmlns:x="urn:x"><channel><title>feed</title><item><title><![CDATA['), F.col("headline"), F.lit("]]></title><x:link>"), _xml(F.col("url")), F.lit("</x:link><pubDate>"), _xml(F.coalesce("published_at", F.lit(""))), F.lit("</pubDate></item></channel></rss>"))
    return _each_feed(spark, d, body, feeds.FeedConfig)


@q("S6_embedded_json", "SELECT DISTINCT trim(headline) AS headline, url, source FROM feed_items WHERE trim(headline) <> '' AND source IS NOT NULL")
def _s6(spark, d):
    """Links relative to the source's host, which the config knows."""
    blob = F.to_json(F.struct(F.struct(F.array(F.struct(F.col("headline").alias("title"), F.regexp_extract("url", "^https?://[^/]+(/.*)$", 1).alias("slug"))).alias("rows")).alias("data")))
    body = F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">'), blob, F.lit("</script></html>"))
    return _each_feed(spark, d, body, lambda name: feeds.FeedConfig(name, "json_path", json_path="data.rows", link_prefix=f"https://{name.replace('_', '-')}.example"))


@q("S7_S8_css_listing", "SELECT DISTINCT trim(headline) AS headline, url, source FROM feed_items WHERE trim(headline) <> '' AND source IS NOT NULL")
def _s7(spark, d):
    """Pages without the embedded JSON that the source's mode wants, so that its selectors are the fallback."""
    body = F.concat(F.lit('<ul><li class="card big"><h2><a href="'), _xml(F.col("url")), F.lit('"><span>'), _xml(F.col("headline")), F.lit('</span></a></h2><br></li><li class="ad"><a href="/ad">ad</a></li></ul>'))
    return _each_feed(spark, d, body, lambda name: feeds.FeedConfig(name, "json_path", json_path="data.rows", selectors={"item": "li.card", "link": "h2 a", "title": "h2 a"}))


@q("S10_transport", "SELECT id, CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'HTTP 404' WHEN 2 THEN 'expected a JSON array of postings' WHEN 3 THEN 'expected a JSON array of postings' ELSE NULL END AS problem, id % 5 = 0 AS not_modified FROM companies")
def _s10(spark, d):
    n = F.col("id") % 5
    r = table(spark, d, "companies", "id").select("id", F.when(n == 0, 304).when(n == 1, 404).otherwise(200).alias("status"), F.when(n == 2, '{"a": 1}').when(n == 3, "<html>").when(n == 4, "[]").alias("body"), F.lit(None).cast("string").alias("error"))
    return boards.outcome(r, "lever").select("id", "problem", "not_modified")


@q("S11_J15_unseen_mail", "SELECT DISTINCT gmail_id FROM mail_messages WHERE gmail_id NOT IN (SELECT gmail_id FROM mail_messages WHERE kind = 'rejection')")
def _s11(spark, d):
    m = table(spark, d, "mail_messages", "gmail_id", "kind")
    return mailbox.unseen(m.select("gmail_id").distinct(), m.where("kind = 'rejection'"))


@q("S12_mime", "SELECT DISTINCT gmail_id, coalesce(subject, '') AS subject, body FROM mail_messages WHERE body <> ''")
def _s12(spark, d):
    m = table(spark, d, "mail_messages", "gmail_id", "subject", "body").where("body <> ''").distinct()
    url64 = F.regexp_replace(F.translate(F.base64(F.encode("body", "UTF-8")), "+/", "-_"), r"[=\s]", "")
    part = lambda kind, data: F.struct(F.lit(kind).alias("mimeType"), F.struct(data.alias("data")).alias("body"))
    payload = F.to_json(F.struct(F.lit("multipart/mixed").alias("mimeType"), F.array(F.struct(F.lit("SUBJECT").alias("name"), F.coalesce("subject", F.lit("")).alias("value"))).alias("headers"), F.array(part("text/plain; charset=utf-8", url64), part("text/html", F.lit("PGI-eDwvYj4"))).alias("parts")))
    return m.select("gmail_id", payload.alias("p")).select("gmail_id", mailbox.header(F.col("p"), "subject").alias("subject"), mailbox.body_of(F.col("p")).alias("body"))


@q("S13_page_title", "SELECT id, CASE WHEN id % 2 = 0 THEN 'og ' || name ELSE trim(name) END AS title, 'Body ' || name AS text FROM companies")
def _s13(spark, d):
    n = _xml(F.col("name"))
    page = F.concat(F.lit("<html><head>"), F.when(F.col("id") % 2 == 0, F.concat(F.lit('<meta property="og:title" content="og '), n, F.lit('">'))).otherwise(""), F.lit("<title> "), n, F.lit(" </title></head><body><nav>menu</nav><script>x()</script>Body \t "), n, F.lit("<footer>f</footer></body></html>"))
    return table(spark, d, "companies", "id", "name").select("id", pages.title_of(page).alias("title"), pages.text_of(page).alias("text"))


@q("S20_tracked_urls", "SELECT DISTINCT f.article_url, min(i.item_id) AS item_id FROM funding_items f JOIN feed_items i ON i.url = f.article_url GROUP BY 1")
def _s20(spark, d):
    known = table(spark, d, "feed_items", "url", "item_id").groupBy(F.col("url").alias("article_url")).agg(F.min("item_id").alias("item_id"))
    return table(spark, d, "funding_items", "article_url").distinct().join(known, "article_url")


@q("S18_retries", "SELECT event_id, event_id % 4 < 3 AND (event_type = 'error' OR event_type = 'view') AS again, CASE WHEN event_id % 5 = 0 THEN least(event_id % 60, 30)::DOUBLE ELSE pow(2, event_id % 4 - 1) END AS wait FROM events")
def _s18(spark, d):
    t, n = F.col("event_type"), F.col("event_id") % 4
    status = F.when(t == "error", 503).when(t == "view", 429).when(t == "click", 404).otherwise(200)
    after = F.when(F.col("event_id") % 5 == 0, (F.col("event_id") % 60).cast("string"))
    return table(spark, d, "events", "event_id", "event_type").select("event_id", transport.again(status, n).alias("again"), transport.wait(n, after).alias("wait"))


@q("S19_robots", "SELECT id, NOT contains(url, '/lever/') AS allowed FROM jobs")
def _s19(spark, d):
    rules = F.lit("User-agent: *\nDisallow: /lever/\n")
    return table(spark, d, "jobs", "id", "url").select("id", transport.allowed(rules, "quarrycast", F.col("url")).alias("allowed"))


AWAY = r"\b(?:rota|review|share)\w*\b"
EXCUSE = r"\bteam\b|\bgroup"


@q(
    "N2a_found_away_from",
    f"""WITH t AS (SELECT doc_id, text, regexp_split_to_array(text, {re2(AWAY)}) AS g, regexp_extract_all(text, {re2(AWAY)}, 0) AS m FROM documents),
p AS (SELECT doc_id, text, i, list_sum(list_transform(g[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::BIGINT AS pos, length(m[i]) AS n FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM t)),
h AS (SELECT doc_id, bool_or(NOT regexp_matches(substr(text, greatest(1, pos + 1 - 80), n + 80 + least(pos, 80)), {re2(EXCUSE)})) AS f FROM p GROUP BY 1)
SELECT d.doc_id, coalesce(h.f, false) AS found FROM documents d LEFT JOIN h USING (doc_id)""",
)
def _n2a(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", text.found_away_from(c("text"), AWAY, EXCUSE, 80).alias("found"))


@q(
    "R9_resolution",
    f"""SELECT id, CASE WHEN coalesce({LABEL.replace('domain', 'slug || ' + chr(39) + '.example' + chr(39))} <> '' AND len({TOKENS.format('name')}) > 0 AND ({LABEL.replace('domain', 'slug || ' + chr(39) + '.example' + chr(39))} = {JOINED} OR {LABEL.replace('domain', 'slug || ' + chr(39) + '.example' + chr(39))} = ({TOKENS.format('name')})[1] OR (starts_with({JOINED}, {LABEL.replace('domain', 'slug || ' + chr(39) + '.example' + chr(39))}) AND length({LABEL.replace('domain', 'slug || ' + chr(39) + '.example' + chr(39))}) >= 5) OR (starts_with({LABEL.replace('domain', 'slug || ' + chr(39) + '.example' + chr(39))}, {JOINED}) AND length({JOINED}) >= 5)), false) THEN 'link' WHEN len({DTOKENS.format('name')}) < 2 THEN 'single word' ELSE 'to verify' END AS reason FROM companies""",
)
def _r9(spark, d):
    """By a link on the page that fits the name; else by guesses that are to be verified, for names of several words."""
    hosts = domains.candidate_domains(PAGE())
    linked = F.exists(hosts, lambda h: domains.domain_matches_name(h, c("name")))
    return table(spark, d, "companies", "id", "name", "slug").select("id", F.when(linked, "link").when(F.size(domains.guess_domains(c("name"))) == 0, "single word").otherwise("to verify").alias("reason"))
