"""News feeds: captured RSS or Atom, JSON embedded in pages, and listings read by CSS selectors."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrycast.functions.dates import to_iso

ITEMS = "array<struct<headline: string, url: string, published: string>>"
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}


@dataclass(frozen=True)
class FeedConfig:
    """How a source is read."""

    name: str
    mode: str = "rss"  #: rss, json_path or css
    script_id: str = "__NEXT_DATA__"
    json_path: str = ""
    fields: dict = field(default_factory=dict)  #: title, slug, published -> names in the JSON rows
    link_prefix: str = ""
    selectors: dict = field(default_factory=dict)  #: item, link, title for css, also as fallback
    enabled: bool = True


def _local(tag) -> str:
    return tag.rsplit("}", 1)[-1] if isinstance(tag, str) else ""


def rss_items(body: str | None) -> list[dict]:
    """Items of RSS, else entries of Atom, by local names; those without headline or link are left out."""
    if not body or "<!DOCTYPE" in body or "<!ENTITY" in body:
        return []
    try:
        root = ElementTree.fromstring(body.strip())
    except ElementTree.ParseError:
        return []
    nodes = [n for n in root.iter() if _local(n.tag) == "item"] or [n for n in root.iter() if _local(n.tag) == "entry"]
    out = []
    for n in nodes:
        def text(*names, n=n):
            return next((t for name in names for c in n if _local(c.tag) == name and (t := (c.text or "").strip())), "")

        link = text("link") or next((c.get("href") for c in n if _local(c.tag) == "link" and c.get("href")), "")
        if (title := text("title")) and link:
            out.append({"headline": title, "url": link.strip(), "published": text("pubDate", "published", "updated")})
    return out


class _Tree(HTMLParser):
    """A page as nested [tag, attributes, children]; texts are strings."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ["", {}, []]
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = [tag, {k: v or "" for k, v in attrs}, []]
        self.open[-1][2].append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1][2].append([tag, {k: v or "" for k, v in attrs}, []])

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        self.open[-1][2].append(data)


def tree(page: str):
    t = _Tree()
    t.feed(page)
    t.close()
    return t.root


def _nodes(node):
    for c in node[2]:
        if isinstance(c, list):
            yield c
            yield from _nodes(c)


def _fits(node, simple: str) -> bool:
    tag, _, rest = simple.partition(".") if "." in simple else (simple, "", "")
    tag, _, ident = tag.partition("#")
    classes = node[1].get("class", "").split()
    return (not tag or tag == "*" or node[0] == tag) and (not ident or node[1].get("id") == ident) and all(c in classes for c in rest.split(".") if c)


def select(node, selector: str) -> list:
    """Nodes below node that fit 'a.b#c d' style selectors, comma for alternatives, in document order."""
    found = []
    for way in selector.split(","):
        level = [node]
        for simple in way.split():
            level = [m for n in level for m in _nodes(n) if _fits(m, simple)]
        found += [n for n in level if not any(n is f for f in found)]
    return found


def texts(node) -> list[str]:
    return [t for c in node[2] for t in ([c.strip()] if isinstance(c, str) else texts(c)) if t]


def raw_text(node) -> str:
    return "".join(c if isinstance(c, str) else raw_text(c) for c in node[2])


def embedded_items(body: str | None, config: FeedConfig) -> list[dict]:
    """Rows of the JSON in the script of that id, at a dotted path."""
    blob = next((raw_text(n).strip() for n in _nodes(tree(body or "")) if n[0] == "script" and n[1].get("id") == config.script_id), "")
    try:
        node = json.loads(blob) if blob else None
    except ValueError:
        return []
    for part in config.json_path.split("."):
        node = node.get(part) if isinstance(node, dict) else None
    name = lambda key, own: config.fields.get(key) or own
    out = []
    for row in node if isinstance(node, list) else []:
        if not isinstance(row, dict):
            continue
        title, slug = str(row.get(name("title", "title")) or ""), str(row.get(name("slug", "slug")) or row.get("url") or "")
        if title and slug:
            out.append({"headline": title.strip(), "url": slug if slug.startswith("http") else urljoin(config.link_prefix, slug), "published": str(row.get(name("published", "publish")) or "")})
    return out


def listed_items(body: str | None, config: FeedConfig) -> list[dict]:
    """Links of a listing: item nodes, the link in each, its spaced text or else its title or its image's text."""
    s = config.selectors
    out = []
    for node in select(tree(body or ""), s["item"]) if s.get("item") else []:
        link = next(iter(select(node, s.get("link") or "a")), None)
        if link is None or not link[1].get("href"):
            continue
        titled = next(iter(select(node, s.get("title") or "a")), None)
        headline = (" ".join(texts(titled)) if titled else "") or link[1].get("title", "") or next((n[1].get("alt", "") for n in _nodes(node) if n[0] == "img"), "")
        if headline.strip():
            href = link[1]["href"]
            out.append({"headline": headline.strip(), "url": href if href.startswith("http") else urljoin(config.link_prefix, href), "published": ""})
    return out


def parse(body: str | None, config: FeedConfig) -> list[dict]:
    """Items by the source's mode; by selectors if that finds none and there are some."""
    items = rss_items(body) if config.mode == "rss" else embedded_items(body, config) if config.mode == "json_path" else listed_items(body, config)
    return items if items or config.mode == "css" or not config.selectors else listed_items(body, config)


def read(responses: DataFrame, config: FeedConfig, body: str = "body") -> DataFrame:
    """(headline, url, published_at, source) of captured bodies of one source."""

    @F.pandas_udf(ITEMS)
    def items(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: parse(b, config))

    rows = responses.select(F.explode(items(F.col(body))).alias("i"))
    return rows.select("i.headline", "i.url", to_iso(F.nullif(F.col("i.published"), F.lit(""))).alias("published_at"), F.lit(config.name).alias("source"))


def configs(entries: list[dict]) -> list[FeedConfig]:
    """Configurations from plain entries; those without a name are left out, absent `enabled` means enabled."""
    known = {k: v for k, v in FeedConfig.__dataclass_fields__.items()}
    return [FeedConfig(**{k: v for k, v in e.items() if k in known}) for e in entries if e.get("name") and e.get("enabled", True)]
