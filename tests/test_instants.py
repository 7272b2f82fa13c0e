"""Instants of mixed forms."""

import pytest

from quarrycast.operators import instants
from tests.conftest import rows

HINTS = [("us", "America/New_York", "mdy"), ("de", "Europe/Berlin", "dmy"), ("de", "Europe/Berlin", "dmy"), (None, "UTC", "mdy"), ("none", None, None)]
NAMES = [("EST", -300), ("CEST", 120), ("UTC", 0), ("UTC", 0), (None, 5)]
CASES = [
    ("1735657700557", "us", 1735657700), ("1735657700", None, 1735657700), ("1781278884190111", "us", 1781278884), ("1.788103E12", "us", 1788103000), ("1723463360519.0", "us", 1723463360), ("12", "us", None), ("99999999999999999999", "us", None),
    ("2025-10-24T04:28:23+01:00", None, 1761276503), ("2025-01-26T15:00:04.999+0530", "us", 1737883804), ("2024-04-21T05:32:19z", "us", 1713677539), ("2024-11-19T18:37:13+00", "us", 1732041433), ("20251223T160238+0930", "us", 1766471558), ("20240307T203055Z", None, 1709843455),
    ("2025-07-17 20:19:26 Europe/Berlin", "us", 1752776366), ("2026-02-16T14:46:36[America/New_York]", "de", 1771271196), ("2025-07-23T07:32:11 UTC", "us", 1753255931), ("2025-07-23T07:32:11 XQZ", "us", None),
    ("09/16/2025 00:05", "us", 1757995500), ("16/09/2025 00:05", "us", None), ("16/09/2025 00:05", "de", 1757973900), ("7/11/2026 7:09 PM", "us", 1783811340), ("18.12.2025 14:22", "de", 1766064120), ("05/06/2025", None, None), ("05/06/2025", "none", None),
    ("Wed, 27 Mar 2024 03:01:23 EST", "de", 1711526483), ("03 Jan 2025 22:58 +0930", "us", 1735910880), ("26 Oct 2025", "de", 1761429600), ("7 Sep 2025", "us", 1757217600), ("Jul 28, 2024 9:12 PM CEST", "us", 1722193920), ("October 18, 2026 9:06 am", "us", 1792328760), ("Sep 27, 2024 at 15:12", "de", 1727442720), ("22 November 2024 10:42", "de", 1732268520), ("5 May 2024 12:30 AM", "us", 1714883400),
    ("2025-11-02T01:30:00", "us", 1762061400), ("2025-03-09T02:30:00", "us", 1741505400), ("2025-10-26 02:15:00", "de", 1761437700), ("2025-03-30 02:15:00", "de", 1743297300),
    ("2024/03/16", "us", 1710561600), ("2026-03-08", "us", 1772946000),
    ("2026-02-30T10:00:00Z", "us", None), ("2025-13-04", "us", None), ("31/31/2025", "us", None), ("0000-00-00 00:00:00", "us", None), ("2025-01-01T25:00:00Z", "us", None), ("2025-01-01T10:61:00Z", "us", None), ("13:00 PM", "us", None),
    ("yesterday", "us", None), ("3 days ago", "us", None), ("TBD", "us", None), ("n/a", "us", None), ("", "us", None), (None, "us", None), ("2025-01-01T00:00:00", None, None), ("2025-01-01T00:00:00", "unknown", None), ("x" * 100_000, "us", None),
]


def test_forms(spark):
    df = spark.createDataFrame([(i, v, s) for i, (v, s, _) in enumerate(CASES)], "i int, value string, source string")
    out = instants.utc_seconds(df, "value", "source", spark.createDataFrame(HINTS, "source string, tz_name string, day_order string"), spark.createDataFrame(NAMES, "abbr string, offset_minutes int"))
    got = {r.i: r.utc_second for r in out.collect()}
    assert {v[:40] if v else v: got[i] for i, (v, _, w) in enumerate(CASES) if got[i] != w} == {}


def test_repeated_rows_and_empty_tables(spark):
    hints, names = spark.createDataFrame([], "source string, tz_name string, day_order string"), spark.createDataFrame([], "abbr string, offset_minutes int")
    df = spark.createDataFrame([("a", "2025-01-01T00:00:00Z"), ("a", "2025-01-01T00:00:00Z")], "source string, value string")
    assert rows(instants.utc_seconds(df, "value", "source", hints, names), "utc_second") == [(1735689600,)] * 2
    assert instants.utc_seconds(df.where("false"), "value", "source", hints, names).count() == 0


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata", "Australia/Sydney"])
def test_intervals_are_the_zone_rules(spark, zone):
    from datetime import datetime, timezone
    from zoneinfo import ZoneInfo

    got = instants.offset_intervals(spark).where(f"tz_name = '{zone}' and year = 2025").first().intervals
    for i in got:
        t = max(i["from"] - i.off, 1735689600)
        assert datetime.fromtimestamp(t, timezone.utc).astimezone(ZoneInfo(zone)).utcoffset().total_seconds() == i.off
