"""How queries are registered, and SQL that several of them share."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from quarrycast.functions import text
from quarrycast.functions.rx import re2

#: The instant that all time-dependent queries take as now.
NOW = datetime(2026, 10, 15, tzinfo=timezone.utc)
NOW_ISO = "2026-10-15T00:00:00+00:00"


class Registry:
    """Queries and their SQL by name."""

    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def add(f):
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return add


def sub(x: str, pattern: str, by: str, flags: bool = True, ignore_case: bool = True) -> str:
    return f"regexp_replace({x}, {re2(pattern, ignore_case)}, '{by}'{', ' + chr(39) + 'g' + chr(39) if flags else ''})"


def sql_squeeze(x: str) -> str:
    return f"trim({sub(x, chr(92) + 's+', ' ', ignore_case=False)})"


def sql_company(x: str) -> str:
    return sql_squeeze(sub(sub(f"lower(coalesce({x}, ''))", text.COMPANY_SUFFIX, " "), text.NOT_ALNUM, " ", ignore_case=False))


def sql_title(x: str) -> str:
    low = sub(sub(f"lower(coalesce({x}, ''))", text.TITLE_NOISE, " "), text.TITLE_TRAILER, " ")
    return sql_squeeze(sub(low, text.NOT_ALNUM, " ", ignore_case=False))


def sql_day(x: str) -> str:
    """The date that an ISO text shows."""
    t = f"left(trim({x}), 10)"
    return f"(CASE WHEN regexp_matches({t}, '^\\d{{4}}-\\d\\d-\\d\\d$') THEN try_cast({t} AS DATE) END)"


def sql_week(x: str) -> str:
    d = sql_day(x)
    return f"coalesce(isoyear({d})::VARCHAR || '-W' || lpad(week({d})::VARCHAR, 2, '0'), '')"


def sql_instant(x: str) -> str:
    """Seconds since 1970 of the instant of an ISO text."""
    t = f"trim({x})"
    full = f"regexp_matches({t}, '^\\d{{4}}-\\d\\d-\\d\\d[T ]\\d\\d:\\d\\d:\\d\\d(\\.\\d+)?(Z|[+-]\\d\\d:\\d\\d)?$')"
    naive = f"epoch(try_cast(left({t}, 19) AS TIMESTAMP))"
    sign = f"CASE WHEN substr({t}, length({t}) - 5, 1) = '-' THEN -1 ELSE 1 END"
    off = f"(CASE WHEN regexp_matches({t}, '[+-]\\d\\d:\\d\\d$') THEN ({sign}) * (substr({t}, length({t}) - 4, 2)::INT * 3600 + right({t}, 2)::INT * 60) ELSE 0 END)"
    short = f"regexp_matches(left({t}, 19), '^\\d{{4}}-\\d\\d-\\d\\d[T ]\\d\\d:\\d\\d:\\d\\d$')"
    return f"(CASE WHEN {full} AND {naive} IS NOT NULL THEN {naive} - {off} WHEN {short} AND {naive} IS NOT NULL THEN {naive} ELSE epoch({sql_day(x)}) END)"


#: jobs with dedupe_key and canonical_id
CANON = f"""k AS (SELECT j.*, {sql_company('c.name')} || '|' || {sql_title('j.title')} || '|' || {sql_week('j.posted_at')} AS dedupe_key
     FROM jobs j LEFT JOIN companies c ON c.id = j.company_id),
canon AS (SELECT k.*, CASE WHEN coalesce(k.source, '') <> b.source AND k.id > b.id THEN b.id END AS canonical_id
     FROM k LEFT JOIN (SELECT dedupe_key, min(id) AS id, arg_min(coalesce(source, ''), id) AS source FROM k WHERE dedupe_key <> '||' GROUP BY 1) b USING (dedupe_key))"""
#: the listing of jobs that aren't linked duplicates
LISTED = f"""{CANON}, listed AS (SELECT j.id, c.name AS company, j.title, j.location, j.url, j.source, j.comp_model, j.pay_min, j.pay_max, j.pay_currency,
     j.auth_required, j.hires_in_india, j.remote, coalesce(j.first_seen_at, j.seen_at) AS seen
     FROM canon j JOIN companies c ON c.id = j.company_id WHERE j.canonical_id IS NULL)"""
ORDER = "coalesce(auth_required, 0), (coalesce(hires_in_india, 0) = 1) DESC, seen DESC NULLS LAST, id DESC"
LISTED_COLUMNS = "id, company, title, location, url, source, comp_model, pay_min, pay_max, pay_currency, auth_required, hires_in_india, seen"
