"""Functions on golden cases of our own."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from quarrycast.functions import dates, domains, funding, mail, rx, text, urls
from quarrycast.plans.base import NOW


def one(spark, column, *values):
    df = spark.createDataFrame([(*values,)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(column(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first().x


@pytest.mark.parametrize("a,b", [("Acme Labs Pvt. Ltd", "ACME"), ("Blue River Technologies, Inc.", "blue river"), (None, ""), ("株式会社", "")])
def test_company(spark, a, b):
    assert one(spark, text.norm_company, a) == one(spark, text.norm_company, b)


@pytest.mark.parametrize("a,b", [("Engineer (Remote)", "engineer"), ("Engineer - India", "Engineer"), ("Data Engineer II | Bengaluru, KA", "data engineer ii"), ("", None)])
def test_title(spark, a, b):
    assert one(spark, text.norm_title, a) == one(spark, text.norm_title, b)


@pytest.mark.parametrize("raw,week", [("2027-01-01", "2026-W53"), ("2026-08-11T00:30:00+05:30", "2026-W33"), ("garbage", ""), ("", ""), (None, ""), ("2026-02-30", "")])
def test_week(spark, raw, week):
    assert one(spark, dates.posted_week, raw) == week


@pytest.mark.parametrize("raw,want", [("&lt;p&gt;V&lt;b&gt;isa&lt;/b&gt;&lt;/p&gt;", "Visa"), ("a<br>b<li>c</li>d", "a\nbc\nd"), ("x &amp;amp; y", "x & y"), ("", ""), (None, None), ("a \t b\r\n\r\n\r\n\r\nc", "a b\n\nc")])
def test_markup(spark, raw, want):
    assert one(spark, text.strip_html, raw) == want


def test_business_days(spark):
    for k in range(14):
        d = date(2026, 8, 3) + timedelta(days=k)
        for n in (1, 3, 5, 12):
            want, left = d, n
            while left:
                want += timedelta(days=1)
                left -= want.weekday() < 5
            assert one(spark, lambda c, n=n: dates.add_business_days(c.cast("date"), n), str(d)) == want


@pytest.mark.parametrize("value,back", [("7d", 7 * 24), ("48h", 48), ("2w", 14 * 24)])
def test_since(value, back):
    assert dates.parse_since(value, NOW) == NOW - timedelta(hours=back)


@pytest.mark.parametrize("bad", ["7x", "d", "-3d", "soon", "2026-02-30"])
def test_bad_since(bad):
    with pytest.raises(ValueError):
        dates.parse_since(bad, NOW)
    assert dates.parse_since("", NOW) is None


@pytest.mark.parametrize("raw,want", [("Sat, 08 Aug 2026 00:30:00 +0530", "2026-08-08T00:30:00+05:30"), ("2026-08-06 09:00:00", "2026-08-06T09:00:00+00:00"), ("2026-08-06T09:00:00Z", "2026-08-06T09:00:00+00:00"), ("nonsense", None), ("", None), (None, None)])
def test_to_iso(spark, raw, want):
    assert one(spark, dates.to_iso, raw) == want


@pytest.mark.parametrize(
    "headline,name,stage,amount,investors,confidence",
    [
        ("Fintech startup Zuvro raises $4.5 Mn in Series A led by Oakline and Brim Partners", "Zuvro", "A", "$4.5 Mn", ["Oakline", "Brim Partners"], "high"),
        ("Zuvro in advanced talks to raise Rs 40 Cr seed round from existing investors", "Zuvro", "seed", "Rs 40 Cr", [], "high"),
        ("[Update] Zuvro, an EV startup, bags pre-Series A funding", "Zuvro", "seed", "", [], "low"),
        ("Zuvro, Brillo and Kanto raise $3 Mn seed round", "Zuvro, Brillo and Kanto", "seed", "$3 Mn", [], "low"),
        ("Series B funding for Zuvro", "", "B", "", [], "low"),
    ],
)
def test_headlines(spark, headline, name, stage, amount, investors, confidence):
    df = spark.createDataFrame([(headline,)], "h string")
    h = F.col("h")
    r = df.select(funding.company_name(h).alias("n"), funding.stage(h).alias("s"), funding.amount(h).alias("a"), funding.investors(h).alias("i"), funding.confidence(h).alias("c")).first()
    assert (r.n, r.s, r.a, r.i, r.c) == (name, stage, amount, investors, confidence)


@pytest.mark.parametrize("headline,want", [("Acme raises $1 Mn", "funding"), ("VC firm closes $50 Mn maiden fund", "near_miss"), ("Startup funding falls", "near_miss"), ("Weather today", "other"), ("Minister raises concerns", "vetoed"), (None, "other")])
def test_gate(spark, headline, want):
    assert one(spark, funding.gate, headline) == want


def test_domains(spark):
    assert one(spark, lambda d, n: domains.domain_matches_name(d, n), "www.river-mobility.com", "River Mobility") is True
    assert one(spark, lambda d, n: domains.domain_matches_name(d, n), "atlas.com", "River Mobility") is False
    assert one(spark, lambda n: domains.guess_domains(n), "Atlas") == []
    assert one(spark, lambda n: domains.guess_domains(n), "InRisk Labs") == ["inrisklabs.com", "inrisklabs.in", "inrisklabs.co", "inrisklabs.io", "inrisklabs.ai", "getinrisklabs.com", "getinrisklabs.in"]
    assert one(spark, lambda p: domains.candidate_domains(p), '<a href="https://www.acme.com/x">a</a><a href="https://linkedin.com/in">l</a><a href="/y">y</a>') == ["acme.com"]


@pytest.mark.parametrize("subject,want", [("Your application to Zuvro Labs", "Zuvro Labs"), ("Re: Fwd: Thank you for applying to Zuvro, Inc", "Zuvro"), ("Thanks for applying to the team", ""), ("Zuvro | Application received", "Zuvro"), ("Hello", ""), (None, "")])
def test_subjects(spark, subject, want):
    assert one(spark, mail.company_from_subject, subject) == want


@pytest.mark.parametrize("sender,domain,machine", [("Careers <no-reply@Zuvro.com>", "zuvro.com", True), ("ann@zuvro.com", "zuvro.com", False), ("nobody", "", True)])
def test_senders(spark, sender, domain, machine):
    assert (one(spark, mail.sender_domain, sender), one(spark, mail.is_automated, sender)) == (domain, machine)


@pytest.mark.parametrize("link,want", [("https://boards.greenhouse.io/embed/job_board?for=acme&x=1", ("greenhouse", "acme")), ("https://jobs.lever.co/acme/123", ("lever", "acme")), ("https://jobs.ashbyhq.com/acme.", ("ashby", "acme")), ("https://boards.greenhouse.io/embed", None), ("https://x.example", None)])
def test_boards(spark, link, want):
    r = one(spark, urls.board_of, link)
    assert (tuple(r) if r else None) == want


def test_dialect(spark):
    assert one(spark, lambda c: c.rlike(rx.java(r"\bindia\b")), "éindia") is True
    assert one(spark, lambda c: c.rlike(rx.java(r"x$")), "x\n") is False
