"""Senders and subjects of mails."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrycast.functions.domains import in_list
from quarrycast.functions.rx import java
from quarrycast.functions.text import empty_to_null

# --- fixed values ---------------------------------------------------------------------------------------------
REJECTION = [
    r"move forward with other candidate",
    r"moving forward with other candidate",
    r"decided (?:to|not to) (?:move|proceed|progress)[^.]{0,40}(?:other candidate|with your application)",
    r"not (?:be )?(?:moving|progressing|proceeding) (?:forward|ahead)[^.]{0,30}(?:your application|at this time|with your candidacy)",
    r"regret to inform",
    r"will not be (?:moving forward|progressing)",
    r"your application[^.]{0,40}(?:was not successful|has been unsuccessful)",
    r"we (?:have )?(?:decided )?(?:to )?pursue other candidate",
    r"not (?:been )?selected (?:for|to)",
]
CONFIRMATION = [
    r"thank(?:s| you) for (?:applying|your application|your interest)",
    r"we(?:'ve| have)? received your application",
    r"your application (?:has been|was) received",
    r"application (?:received|submitted|confirmation)",
    r"we(?:'ve| have)? got your application",
    r"successfully (?:applied|submitted your application)",
]
PLATFORMS = [
    "greenhouse.io", "greenhouse-mail.io", "us.greenhouse-mail.io", "hire.lever.co", "lever.co", "ashbyhq.com", "ashby.hq",
    "myworkday.com", "workday.com", "icims.com", "smartrecruiters.com", "successfactors.com", "taleo.net", "jobvite.com",
    "breezy.hr", "recruitee.com", "workable.com", "teamtailor.com", "hire.withgoogle.com",
]
AUTOMATED = [
    "no-reply", "noreply", "donotreply", "do-not-reply", "notifications", "notification", "mailer", "automated", "auto-reply",
    "bounce", "postmaster",
]
SUBJECT_COMPANY = [
    r"your application (?:to|at|for) ([A-Z0-9][\w&.' -]{1,40}?)(?:\s*[-–—|,:(]|$)",
    r"thank(?:s| you) for (?:applying|your interest) (?:to|at|in) ([A-Z0-9][\w&.' -]{1,40}?)(?:\s*[-–—|,:(]|$)",
    r"applying (?:to|at) ([A-Z0-9][\w&.' -]{1,40}?)(?:\s*[-–—|,:(]|$)",
    r"application (?:to|at|for) ([A-Z0-9][\w&.' -]{1,40}?)(?:\s*[-–—|,:(]|$)",
    r"^([A-Z0-9][\w&.' -]{1,40}?)\s*[-–—|:]\s*(?:application|thank)",
]
SUBJECT_PREFIX = r"^(?:(?:re|fw|fwd):\s*)+"
COMPANY_TAILS = [" inc", " inc.", " llc", " ltd", " limited", " corp", " corporation", " pvt", " pvt.", " private limited"]
STOP_FIRST = ["the", "our", "us", "your", "this", "a", "an", "join", "work", "be"]
# ---------------------------------------------------------------------------------------------------------------


def address(sender: Column) -> Column:
    """The bare address of a From header."""
    s = F.trim(sender)
    inside = F.regexp_extract(s, r"(?s)^.*<([^>]*)>", 1)
    return F.when(s.rlike(r"(?s)^.*<[^>]*>"), F.trim(inside)).otherwise(s)


def sender_domain(sender: Column) -> Column:
    """The sender's domain in lower case; '' without one."""
    a = address(sender)
    return F.when(a.contains("@"), F.lower(F.trim(F.regexp_replace(a, r"(?s)^[^@]*@", "")))).otherwise("")


def is_automated(sender: Column) -> Column:
    """A machine sender; one without @ counts as such."""
    a = F.lower(address(sender))
    local = F.substring_index(a, "@", 1)
    out = ~a.contains("@")
    for m in AUTOMATED:
        out |= local.contains(m)
    return out


def is_platform(sender: Column) -> Column:
    """A recruiting platform, whose domain says nothing about the employer."""
    return in_list(sender_domain(sender), PLATFORMS)


def strip_subdomain(domain: Column) -> Column:
    return F.substring_index(domain, ".", -2)


def _clean(name: Column) -> Column:
    n = F.trim(F.trim(name), F.lit("-–—|,:;.!\"' "))
    for t in COMPANY_TAILS:
        n = F.regexp_replace(n, java(t.replace(".", r"\.") + r"$"), "")
    return F.when((F.length(n) >= 2) & ~F.substring_index(F.lower(n), " ", 1).isin(STOP_FIRST), n)


def company_from_subject(subject: Column) -> Column:
    """The employer that a subject names; '' if none."""
    s = F.regexp_replace(F.trim(subject), java(SUBJECT_PREFIX), "")
    return F.coalesce(*[_clean(empty_to_null(F.regexp_extract(s, java(p), 1))) for p in SUBJECT_COMPANY], F.lit(""))


def kind(sender: Column, subject: Column, snippet: Column, body: Column) -> Column:
    """rejection, confirmation, reply or other; the first that fits."""
    text = F.concat_ws("\n", F.coalesce(subject, F.lit("")), F.coalesce(snippet, F.lit("")), F.coalesce(body, F.lit("")))
    both = [F.lit(False), F.lit(False)]
    for i, patterns in enumerate((REJECTION, CONFIRMATION)):
        for p in patterns:
            both[i] |= text.rlike(java(p))
    human = ~is_automated(F.coalesce(sender, F.lit(""))) & F.lower(F.trim(F.coalesce(subject, F.lit("")))).startswith("re:")
    return F.when(both[0], "rejection").when(both[1], "confirmation").when(human, "reply").otherwise("other")
