"""Adapters on small payloads of our own."""

import base64
import json

from pyspark.sql import functions as F

from quarrycast.sources import boards, feeds, mailbox, members, pages
from tests.conftest import rows


def frame(spark, *bodies):
    return spark.createDataFrame([(b,) for b in bodies], "body string")


def test_board_a(spark):
    body = json.dumps({"jobs": [{"id": 42, "title": " Engineer ", "content": "&lt;p&gt;Hi &amp;amp; bye&lt;/p&gt;", "location": {"name": "Pune"}}, {"id": 43}, {"title": "x"}, None]})
    assert rows(boards.greenhouse(frame(spark, body, "{}", "null", "nonsense", None)), "external_id", "title", "url", "location", "jd_text", "posted_at") == [("42", "Engineer", "", "Pune", "Hi & bye", None)]


def test_board_b(spark):
    body = json.dumps([{"id": "a", "text": "T", "hostedUrl": "u", "createdAt": 1700000000123, "categories": {"location": "X", "commitment": ""}, "descriptionPlain": " p ", "description": "<b>h</b>"}, {"id": "b", "text": "U", "createdAt": "soon", "description": "a&amp;b<br>c"}])
    assert rows(boards.lever(frame(spark, body, "[]")), "external_id", "posted_at", "location", "employment_type", "jd_text") == [("a", "2023-11-14T22:13:20+00:00", "X", None, "p"), ("b", None, None, None, "a&b\nc")]


def test_board_c(spark):
    comp = {"summaryComponents": [{"compensationType": "Equity", "minValue": 1}, {"compensationType": "SALARY", "minValue": 100, "maxValue": 150.5, "currencyCode": ""}], "compensationTiers": [{"components": [{"compensationType": "salary", "minValue": 90, "maxValue": "x", "currencyCode": "EUR"}]}, {}]}
    jobs = [{"id": "1", "title": "T", "isRemote": True, "compensation": comp, "address": {"postalAddress": {"addressLocality": "Bonn"}}}, {"id": "2", "title": "T", "isRemote": "maybe", "compensation": None, "location": "Köln"}]
    assert rows(boards.ashby(frame(spark, json.dumps({"jobs": jobs}))), "external_id", "remote", "location", "pay_min", "pay_max", "pay_currency") == [("1", True, "Bonn", 90.0, 150.5, "EUR"), ("2", None, "Köln", None, None, None)]


def test_outcomes(spark):
    df = spark.createDataFrame([(1, 304, None), (2, 404, None), (3, 200, "[]"), (4, 200, "{}"), (5, None, None)], "i int, status int, body string").withColumn("error", F.lit(None).cast("string"))
    assert rows(boards.outcome(df, "lever"), "i", "ok", "not_modified") == [(1, True, True), (2, False, False), (3, True, False), (4, False, False), (5, False, False)]


RSS = "<rss><channel><title>f</title><item><title> A </title><link>u1</link><pubDate>Sat, 08 Aug 2026 00:30:00 +0530</pubDate></item><item><title></title><link>u2</link></item></channel></rss>"
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>B</title><link href="u3"/><updated>2026-08-06T09:00:00Z</updated></entry></feed>'


def test_feeds(spark):
    got = rows(feeds.read(frame(spark, RSS, ATOM, "<broken", None, '<!DOCTYPE x [<!ENTITY a "b">]><rss/>'), feeds.FeedConfig("s")), "headline", "url", "published_at")
    assert got == [("A", "u1", "2026-08-08T00:30:00+05:30"), ("B", "u3", "2026-08-06T09:00:00+00:00")]


def test_embedded_and_listed(spark):
    page = '<script id="__NEXT_DATA__">{"a": {"rows": [{"t": "X", "slug": "/x"}, {"t": ""}, 5]}}</script>'
    config = feeds.FeedConfig("s", "json_path", json_path="a.rows", fields={"title": "t"}, link_prefix="https://h.example", selectors={"item": "div.card", "link": "a.l"})
    assert rows(feeds.read(frame(spark, page), config), "headline", "url") == [("X", "https://h.example/x")]
    listing = '<div class="card"><a class="l" href="/y"><img alt="pic"></a></div><div class="card"><a class="l" href="https://o.example/z" title="Z"></a></div><div class="card"><a class="l" href="/w"><span>W</span><span>w</span></a></div>'
    got = rows(feeds.read(frame(spark, listing), config), "headline", "url")
    assert got == [("W w", "https://h.example/w"), ("Z", "https://o.example/z"), ("pic", "https://h.example/y")]
    assert [c.name for c in feeds.configs([{"name": "a"}, {"name": "b", "enabled": False}, {"mode": "rss"}])] == ["a"]


def test_mime(spark):
    enc = lambda t: base64.urlsafe_b64encode(t.encode()).decode().rstrip("=")
    part = {"mimeType": "multipart/mixed", "headers": [{"name": "Subject", "value": "s"}], "parts": [{"mimeType": "multipart/alternative", "parts": [{"mimeType": "text/plain", "body": {"data": enc("héllo")}}]}, {"mimeType": "text/html", "body": {"data": enc("<b>x</b>")}}]}
    html = {"mimeType": "text/html", "body": {"data": enc("<b>x</b>y")}}
    df = spark.createDataFrame([(1, json.dumps(part)), (2, json.dumps(html)), (3, "{}"), (4, "bad"), (5, None)], "i int, p string")
    assert rows(df.select("i", mailbox.body_of(F.col("p")).alias("b"))) == [(1, "héllo"), (2, " x y"), (3, ""), (4, ""), (5, "")]
    assert df.where("i = 1").select(mailbox.header(F.col("p"), "subject").alias("s")).first().s == "s"


def test_pages(spark):
    page = "<html><head><title> A &amp; B </title></head><body><script>no</script><h1>H</h1>  text\t x</body></html>"
    r = frame(spark, page).select(pages.title_of(F.col("body")).alias("t"), pages.text_of(F.col("body")).alias("x")).first()
    assert (r.t, r.x) == ("A & B", "H text x")


def test_members(spark, tmp_path):
    path = str(tmp_path / "m.json")
    assert members.load(path) == []
    assert members.append(path, {"name": "Acme", "ats": "lever"}) and not members.append(path, {"name": "ACME"})
    members.save([*members.load(path), {"ats": "x"}], path)
    assert rows(members.frame(spark, members.load(path)), "name", "ats", "watchlist_enabled") == [("Acme", "lever", 1)]
