"""Text normalisation as Column -> Column functions, in the JVM but for HTML entities."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarrycast.functions.rx import java

# --- fixed values -------------------------------------------------------------------------------------------
COMPANY_SUFFIX = r"\b(inc|llc|ltd|limited|pvt|private|corp|corporation|co|gmbh|plc|technologies|technology|labs|software|systems|solutions|india)\b"
TITLE_NOISE = r"\((?:remote|hybrid|onsite|on-site|contract|full[\s-]?time|part[\s-]?time)[^)]*\)"
TITLE_TRAILER = r"\s*[-–—|,]\s*(remote|hybrid|onsite|on-site|india|bangalore|bengaluru|mumbai|us|usa|emea|global)\b.*$"
NOT_ALNUM = r"[^a-z0-9 ]+"
BLOCK_END = r"</(p|div|li|tr|td|th|h[1-6]|section|ul|ol|table)\s*>"
LINE_BREAK = r"<br\s*/?>"
TAG = r"<[^>]+>"
# -------------------------------------------------------------------------------------------------------------


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def squeeze(c: Column) -> Column:
    """c with runs of white space as one space, and none at its ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def norm_company(name: Column) -> Column:
    """Comparable form of a company name: no legal words, no punctuation; '' for null."""
    low = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), java(COMPANY_SUFFIX), " ")
    return squeeze(F.regexp_replace(low, NOT_ALNUM, " "))


def norm_title(title: Column) -> Column:
    """Comparable form of a job title: no work mode in brackets, no trailing place; '' for null."""
    low = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), java(TITLE_NOISE), " ")
    return squeeze(F.regexp_replace(F.regexp_replace(low, java(TITLE_TRAILER), " "), NOT_ALNUM, " "))


def clean(text: Column) -> Column:
    """text with plain spaces and line feeds, squeezed, and at most one blank line in a row."""
    t = F.regexp_replace(text, "\u00a0", " ")
    t = F.regexp_replace(t, r"\r\n?", "\n")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r" *\n *", "\n")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+\z", "")


@F.pandas_udf(StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else html.unescape(t))


def unescape(text: Column) -> Column:
    """text with HTML entities resolved; only texts with an ampersand leave the JVM."""
    return F.coalesce(_unescape(F.when(text.contains("&"), text)), text)


def strip_html(markup: Column) -> Column:
    """Readable text of markup that may be escaped once or twice; tags go without a space."""
    t = unescape(unescape(markup))
    t = F.regexp_replace(F.regexp_replace(t, java(LINE_BREAK), "\n"), java(BLOCK_END), "\n")
    return clean(unescape(F.regexp_replace(t, TAG, "")))


def dedupe_key(company: Column, title: Column, posted_at: Column) -> Column:
    """company|title|ISO week, each normalised and possibly empty."""
    from quarrycast.functions.dates import posted_week

    return F.concat_ws("|", norm_company(company), norm_title(title), posted_week(posted_at))


def json_string(payload: Column, path: str) -> Column:
    """The scalar at a JSON path, trimmed; null for containers, absent and empty values. Numbers keep their digits,
    booleans are 'True' and 'False'."""
    v = F.trim(F.get_json_object(payload, path))
    v = F.when(~v.rlike(r"(?s)^[\[{].*[\]}]$"), v)
    return empty_to_null(F.when(v == "true", "True").when(v == "false", "False").otherwise(v))


def truncate(c: Column, width: int) -> Column:
    """c cut to width code points, the last an ellipsis if something was cut."""
    return F.when(F.char_length(c) > width, F.concat(F.substring(c, 1, width - 1), F.lit("…"))).otherwise(c)


def pad(c: Column, width: int) -> Column:
    """c filled with spaces to width code points; longer texts stay whole."""
    return F.when(F.char_length(c) < width, F.rpad(c, width, " ")).otherwise(c)


def found_away_from(c: Column, pattern: str, excuse: str, reach: int) -> Column:
    """c has a match of pattern with none of excuse within reach characters on either side.

    Matches don't overlap. Their places come from the lengths of the pieces between them, so that all stays in the JVM.
    """
    p = java(pattern)
    gaps, hits = F.split(c, p, -1), F.regexp_extract_all(c, F.lit(p), F.lit(0))
    lengths = F.transform(hits, lambda h: F.char_length(h))
    starts = F.aggregate(
        F.sequence(F.lit(1), F.size(hits)),
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out")),
        lambda s, i: F.struct((s["at"] + F.char_length(F.element_at(gaps, i)) + F.element_at(lengths, i)).alias("at"), F.concat(s["out"], F.array(s["at"] + F.char_length(F.element_at(gaps, i)))).alias("out")),
        lambda s: s["out"],
    )
    around = F.transform(starts, lambda a, i: F.substring(c, F.greatest(F.lit(1), a + 1 - reach), F.element_at(lengths, i + 1) + reach + F.least(a, F.lit(reach))))
    return F.coalesce(F.when(F.size(hits) > 0, F.exists(around, lambda t: ~t.rlike(java(excuse)))), F.lit(False))
