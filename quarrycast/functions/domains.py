"""Hosts and company names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------------------------------------------
PUBLISHERS = [
    "entrackr.com", "inc42.com", "vccircle.com", "yourstory.com", "moneycontrol.com", "economictimes.indiatimes.com",
    "indiatimes.com", "livemint.com", "business-standard.com", "techcrunch.com", "reuters.com", "bloomberg.com", "forbes.com",
    "medium.com", "twitter.com", "x.com", "facebook.com", "linkedin.com", "instagram.com", "youtube.com", "whatsapp.com", "t.me",
    "telegram.me", "threads.net", "reddit.com", "pinterest.com", "google.com", "gstatic.com", "googleapis.com",
    "doubleclick.net", "gravatar.com", "wordpress.com", "wp.com", "cloudflare.com", "amazonaws.com", "publive.online", "bit.ly",
    "tinyurl.com", "crunchbase.com", "tracxn.com", "wikipedia.org", "apple.com", "play.google.com", "sharechat.com", "koo.app",
]
STOPWORDS = [
    "the", "and", "labs", "technologies", "technology", "systems", "solutions", "ventures", "capital", "group", "india",
    "global", "inc", "ltd", "pvt", "limited", "private", "company", "digital", "online", "app", "ai",
]
LEGAL_ONLY = ["inc", "ltd", "pvt", "limited", "private", "llp", "corp", "co"]
TLDS = ["com", "in", "co", "io", "ai"]
GUESS_PREFIXES = ["", "get", "try"]
MAX_GUESSES = 7
LINK = r"""(?i)<a[^>]+href=["']([^"']+)["']"""
PARKED = r"(?i)(?:domain\s+(?:is\s+)?for\s+sale|buy\s+this\s+domain|parked\s+(?:free\s+)?(?:at|by|domain)|this\s+domain\s+(?:may\s+be|is)\s+for\s+sale|godaddy\s+domain|under\s+construction|coming\s+soon)"
VERIFY_BYTES = 20_000
# ---------------------------------------------------------------------------------------------------------------


def registrable(host: Column) -> Column:
    """host in lower case without blanks and a leading www."""
    return F.regexp_replace(F.lower(F.trim(host)), r"^www\.", "")


def in_list(host: Column, hosts: list[str]) -> Column:
    """host is one of hosts or below one of them."""
    out = host.isin(hosts)
    for h in hosts:
        out |= host.endswith("." + h)
    return out


def is_publisher(host: Column) -> Column:
    return in_list(host, PUBLISHERS)


def _words(name: Column) -> Column:
    return F.split(F.lower(name), "[^a-z0-9]+", -1)


def name_tokens(name: Column) -> Column:
    """Words of three or more letters, common ones left out; for comparing names."""
    return F.filter(_words(name), lambda w: (F.length(w) >= 3) & ~w.isin(STOPWORDS))


def domain_tokens(name: Column) -> Column:
    """All words but legal forms; for making domains."""
    return F.filter(_words(name), lambda w: (w != "") & ~w.isin(LEGAL_ONLY))


def domain_matches_name(domain: Column, name: Column) -> Column:
    """The first label of domain is the name, its first word, or a long enough beginning of either in the other."""
    label = F.replace(F.substring_index(registrable(domain), ".", 1), F.lit("-"), F.lit(""))
    tokens = name_tokens(name)
    joined = F.array_join(tokens, "")
    hit = (label == joined) | (label == F.get(tokens, F.lit(0))) | (joined.startswith(label) & (F.length(label) >= 5)) | (label.startswith(joined) & (F.length(joined) >= 5))
    return F.coalesce((label != "") & (F.size(tokens) > 0) & hit, F.lit(False))


def guess_domains(name: Column) -> Column:
    """At most MAX_GUESSES domains for names of two or more words; none for others, which are too common."""
    tokens = domain_tokens(name)
    joined = F.array_join(tokens, "")
    all_ = F.flatten(F.array(*[F.array(*[F.concat(F.lit(p), joined, F.lit("." + t)) for t in TLDS]) for p in GUESS_PREFIXES]))
    return F.when((F.size(tokens) >= 2) & (F.length(joined) >= 4), F.slice(F.array_distinct(all_), 1, MAX_GUESSES)).otherwise(F.expr("cast(array() as array<string>)"))


def candidate_domains(page: Column) -> Column:
    """Outbound hosts of a page in the order seen, each once, publishers left out."""
    hosts = F.transform(F.regexp_extract_all(page, F.lit(LINK), F.lit(1)), lambda u: registrable(F.try_parse_url(u, F.lit("HOST"))))
    return F.array_distinct(F.filter(hosts, lambda h: h.isNotNull() & h.contains(".") & ~is_publisher(h)))


def page_names_company(page: Column, name: Column) -> Column:
    """The page is not parked, and its head has all words of the name."""
    head = F.lower(F.substring(page, 1, VERIFY_BYTES))
    return F.coalesce(~head.rlike(PARKED) & (head != "") & F.forall(name_tokens(name), lambda w: head.contains(w)), F.lit(False))
