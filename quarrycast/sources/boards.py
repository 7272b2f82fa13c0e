"""Job boards: captured JSON payloads to postings of one shape.

Each adapter takes a DataFrame with a text column of payloads and gives one row per posting that has an id and a
title: external_id, title, url, source, posted_at, location, employment_type, remote, jd_text, pay_min, pay_max,
pay_currency. What a payload leaves out is null; a payload that isn't of the board's shape gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrycast.functions.dates import epoch_ms_iso
from quarrycast.functions.text import clean, empty_to_null, strip_html

COLUMNS = ["external_id", "title", "url", "source", "posted_at", "location", "employment_type", "remote", "jd_text", "pay_min", "pay_max", "pay_currency"]
A = "struct<jobs: array<struct<id: string, title: string, absolute_url: string, updated_at: string, location: struct<name: string>, content: string>>>"
B = "array<struct<id: string, text: string, hostedUrl: string, createdAt: string, categories: struct<location: string, commitment: string>, descriptionPlain: string, description: string>>"
PART = "array<struct<compensationType: string, minValue: string, maxValue: string, currencyCode: string>>"
C = f"struct<jobs: array<struct<id: string, title: string, jobUrl: string, publishedAt: string, employmentType: string, location: string, address: struct<postalAddress: struct<addressLocality: string>>, isRemote: string, descriptionPlain: string, descriptionHtml: string, compensation: struct<summaryComponents: {PART}, compensationTiers: array<struct<components: {PART}>>>>>>"


def _text(c: str | Column) -> Column:
    return empty_to_null(F.trim(F.col(c) if isinstance(c, str) else c))


def _shape(df: DataFrame, source: str, remote: Column | None = None, pay: tuple | None = None, **cols: Column) -> DataFrame:
    low, high, currency = pay or (F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("string"))
    out = df.where(_text("p.id").isNotNull() & _text("p.title" if "p_title" not in cols else cols.pop("p_title")).isNotNull())
    return out.select(_text("p.id").alias("external_id"), *[v.alias(k) for k, v in cols.items()], F.lit(source).alias("source"), (remote if remote is not None else F.lit(None).cast("boolean")).alias("remote"), low.alias("pay_min"), high.alias("pay_max"), currency.alias("pay_currency")).select(*COLUMNS)


def greenhouse(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Object with jobs; escaped markup."""
    df = payloads.select(F.explode(F.from_json(body, A)["jobs"]).alias("p"))
    return _shape(df, "greenhouse", title=_text("p.title"), url=F.coalesce(F.trim("p.absolute_url"), F.lit("")), posted_at=_text("p.updated_at"), location=_text("p.location.name"), employment_type=F.lit(None).cast("string"), jd_text=strip_html(F.coalesce(F.trim("p.content"), F.lit(""))))


def lever(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Bare array; epoch milliseconds; plain text before markup."""
    df = payloads.select(F.explode(F.from_json(body, B)).alias("p"))
    ms = F.floor(F.trim("p.createdAt").try_cast("double")).try_cast("bigint")
    jd = F.coalesce(clean(_text("p.descriptionPlain")), strip_html(F.coalesce(F.trim("p.description"), F.lit(""))))
    return _shape(df, "lever", p_title=F.col("p.text"), title=_text("p.text"), url=F.coalesce(F.trim("p.hostedUrl"), F.lit("")), posted_at=epoch_ms_iso(ms), location=_text("p.categories.location"), employment_type=_text("p.categories.commitment"), jd_text=jd)


def salary(compensation: Column) -> tuple[Column, Column, Column]:
    """(least, greatest, first currency) of the salary parts of a compensation."""
    none = F.expr(f"cast(array() as {PART})")
    parts = F.concat(F.coalesce(compensation["summaryComponents"], none), F.flatten(F.transform(F.coalesce(compensation["compensationTiers"], F.expr(f"cast(array() as array<struct<components: {PART}>>)")), lambda t: F.coalesce(t["components"], none))))
    own = F.filter(parts, lambda p: F.lower(F.trim(p["compensationType"])) == "salary")
    low = F.array_min(F.transform(own, lambda p: F.trim(p["minValue"]).try_cast("double")))
    high = F.array_max(F.transform(own, lambda p: F.trim(p["maxValue"]).try_cast("double")))
    return low, high, F.get(F.filter(F.transform(own, lambda p: empty_to_null(F.trim(p["currencyCode"]))), lambda x: x.isNotNull()), F.lit(0))


def ashby(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Object with jobs; nested pay; remote only where it is a JSON boolean."""
    df = payloads.select(F.explode(F.from_json(body, C)["jobs"]).alias("p"))
    jd = F.coalesce(clean(_text("p.descriptionPlain")), strip_html(F.coalesce(F.trim("p.descriptionHtml"), F.lit(""))))
    remote = F.when(F.col("p.isRemote") == "true", True).when(F.col("p.isRemote") == "false", False)
    return _shape(df, "ashby", remote, salary(F.col("p.compensation")), title=_text("p.title"), url=F.coalesce(F.trim("p.jobUrl"), F.lit("")), posted_at=_text("p.publishedAt"), location=F.coalesce(_text("p.location"), _text("p.address.postalAddress.addressLocality")), employment_type=_text("p.employmentType"), jd_text=jd)


#: Adapters by name; register another board by adding its function.
ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {"greenhouse": greenhouse, "lever": lever, "ashby": ashby}
_SHAPES = {"greenhouse": A, "lever": B, "ashby": C}


def outcome(responses: DataFrame, provider: str, status: str = "status", body: str = "body", error: str = "error") -> DataFrame:
    """responses with ok, not_modified and problem: a 304 keeps what is known, other failures and bodies of another
    shape are failed polls. A board without postings is ok."""
    code = F.col(status)
    good = F.from_json(F.col(body), _SHAPES[provider])
    shaped = F.trim(body).startswith("[") if provider == "lever" else F.trim(body).startswith("{")
    problem = F.when(code == 304, None).when(code.isNull() | ~code.between(200, 299), F.coalesce(empty_to_null(F.col(error)), F.concat(F.lit("HTTP "), code.cast("string")), F.lit("no response"))).when(~F.coalesce(shaped & good.isNotNull(), F.lit(False)), F.lit("expected a JSON array of postings" if provider == "lever" else "unparseable JSON body"))
    return responses.withColumn("not_modified", F.coalesce(code == 304, F.lit(False))).withColumn("problem", problem).withColumn("ok", F.col("problem").isNull())


def read(responses: DataFrame, provider: str = "provider") -> DataFrame:
    """Postings of captured responses of all providers: one branch per adapter, united."""
    out = None
    for name, adapter in ADAPTERS.items():
        part = adapter(responses.where(F.col(provider) == name))
        out = part if out is None else out.unionByName(part)
    return out
