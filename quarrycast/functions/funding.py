"""What a funding headline says: gate, round, currency, amount, company, investors, confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrycast.functions.rx import java
from quarrycast.functions.text import empty_to_null, squeeze

# --- fixed values: rule lists, in their order ------------------------------------------------------------------
TRIGGERS = [
    r"\b(?:raise[sd]?|raising)\b",
    r"\b(?:bags?|bagged|secures?|secured|nets?|netted|garners?|garnered)\b.{0,40}\b(?:funding|round|investment|mn|bn|cr|crore|million)\b",
    r"\b(?:closes?|closed|wraps? up)\b.{0,30}\b(?:round|funding)\b",
    r"\b(?:mops? up|picks? up|lands?|landed|scoops? up)\b.{0,30}\b(?:funding|mn|bn|cr|crore|million)\b",
    r"\b(?:pre-)?series\s+[a-j]\b",
    r"\b(?:seed|pre-seed)\s+(?:round|funding)\b",
    r"\bfunding\s+round\b",
]
VETOES = [
    r"\b(?:vc|venture|pe)\s+(?:firm|fund)\b.{0,30}\b(?:raise[sd]?|closes?)\b.{0,20}\bfund\b",
    r"\braises?\s+(?:concerns?|questions?|doubts?|alarm|the\s+bar)\b",
    r"\b(?:fund|vehicle)\s+(?:i|ii|iii|iv|v)\b",
    r"\bmaiden\s+fund\b",
]
NEAR_MISSES = [r"[$₹]", r"\b(?:crore|cr|lakh|million|mn|billion|bn)\b", r"\b(?:funding|investor|investment|valuation)\b"]
STAGES = [
    (r"\bpre-seed\b|\bpre\s+seed\b", "pre-seed"),
    (r"\bpre-series\s+a\b", "seed"),
    (r"\bseries\s+a\d?\b", "A"),
    (r"\bseries\s+b\d?\b", "B"),
    (r"\bseries\s+[c-j]\d?\b", "C+"),
    (r"\b(?:venture\s+debt|debt\s+(?:funding|round|financing)|ncds?|non-convertible)\b", "debt"),
    (r"\bseed\b", "seed"),
    (r"\bgrowth\s+round\b|\blate-stage\b", "C+"),
]
CURRENCIES = [(r"[$]|\bUSD\b|\bdollars?\b", "USD"), (r"[₹]|\bINR\b|\bRs\.?\b|\bcrore\b|\bcr\b|\blakh\b", "INR")]
PREFIXES = [
    r"^\[[^\]]*\]\s*",
    r"^(?:exclusive|breaking|update)\s*[:|-]\s*",
    r"^[A-Za-z]+-based\s+",
    r"^(?:ev|d2c|b2b|b2c|saas|ai|fintech|healthtech|edtech|agritech|insurtech|deeptech|spacetech|cleantech|quick\s+commerce)\s+",
    r"^(?:startup|firm|company|platform|brand|unicorn|soonicorn|major|player|maker|app)\s+",
    r"^.{0,60}?\b(?:startup|marketplace|firm|platform|company|brand|maker|unicorn|soonicorn|aggregator|manufacturer)\s+",
]
VERB = r"\b(?:raise[sd]?|raising|bags?|bagged|secures?|secured|nets?|netted|garners?|garnered|closes?|closed|mops?\s+up|picks?\s+up|lands?|landed|scoops?\s+up|gets?|receives?|attracts?|kicks?\s+off|wraps?\s+up|opens?)\b"
AMOUNT = r"(?:[$₹]|\bUSD\b|\bINR\b|\bRs\.?\s*)\s*\d[\d,.]*(?:\s*[-\s])?(?:mn|mln|million|bn|billion|cr|crore|lakh|k|m\b)?|\d[\d,.]*\s*(?:mn|mln|million|bn|billion|cr|crore|lakh)\b"
INVESTOR_CLAUSE = r"\b(?:led\s+by|backed\s+by|from)\s+(.+?)(?:\s+(?:to|for|in|at|as|amid|after)\s|$)"
INVESTOR_SPLIT = r"\s*(?:,|\band\b|&|\+)\s*"
NO_INVESTOR = r"^(?:others?|among|more|existing\s+(?:investors?|backers?|shareholders?)|investors?|backers?|new\s+and\s+existing|its\s+\w+)$"
AUXILIARY = r"(?:\s+(?:is|are|was|were|to|set|about|looking|planning|plans?|preparing|poised|likely|in|advanced|talks|close|closing|said|reported|expected|eyes|may|will|could|might)){1,8}\s*$"
DESCRIPTOR = r",\s*(?:an?|the)\s+[^,]{0,40}$"
TRAILING_NOUN = r"\s+(?:startup|firm|company|platform|brand|maker|app)$"
SEVERAL = r",| and "
# -----------------------------------------------------------------------------------------------------------------


def _any(c: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out |= c.rlike(java(p))
    return out


def gate(headline: Column) -> Column:
    """'funding', 'vetoed', 'near_miss' (money is mentioned, but no trigger) or 'other'."""
    h = F.coalesce(headline, F.lit(""))
    return F.when(_any(h, VETOES), F.when(_any(h, NEAR_MISSES), "near_miss").otherwise("vetoed")).when(_any(h, TRIGGERS), "funding").when(_any(h, NEAR_MISSES), "near_miss").otherwise("other")


def _first(c: Column, rules: list[tuple[str, str]]) -> Column:
    return F.coalesce(*[F.when(c.rlike(java(p)), v) for p, v in rules])


def stage(headline: Column) -> Column:
    return F.coalesce(_first(headline, STAGES), F.lit("unknown"))


def amount(headline: Column) -> Column:
    return squeeze(F.regexp_extract(headline, java(AMOUNT), 0))


def currency(headline: Column) -> Column:
    """Currency of the amount, or of the whole headline without one; '' if none is named."""
    over = F.coalesce(empty_to_null(amount(headline)), headline)
    return F.coalesce(_first(over, CURRENCIES), F.lit(""))


def company_name(headline: Column) -> Column:
    """The name before the funding verb without what describes it; '' without a verb."""
    text = F.split(headline, java(VERB), 2)[0]
    for p in PREFIXES:
        text = F.regexp_replace(text, java(p), "")
    text = F.regexp_replace(F.trim(text), java(AUXILIARY), "")
    text = F.regexp_replace(F.rtrim(F.trim(text), F.lit(",")), java(DESCRIPTOR), "")
    text = F.trim(F.regexp_replace(F.trim(text), java(TRAILING_NOUN), ""), F.lit(" -–—:|,"))
    return F.when(headline.rlike(java(VERB)), text).otherwise("")


def investors(headline: Column) -> Column:
    """Names after 'led by', 'backed by' or 'from', placeholders left out."""
    clause = F.regexp_extract(headline, java(INVESTOR_CLAUSE), 1)
    names = F.transform(F.split(clause, java(INVESTOR_SPLIT), -1), lambda x: F.trim(x, F.lit(" .,-–—;:")))
    return F.filter(names, lambda x: (F.char_length(x) > 1) & ~x.rlike(java(NO_INVESTOR)))


def confidence(headline: Column) -> Column:
    """'high' if one company, a round and an amount are named."""
    name = company_name(headline)
    return F.when((name != "") & ~name.rlike(java(SEVERAL)) & (stage(headline) != "unknown") & (amount(headline) != ""), "high").otherwise("low")
