"""Companies, boards and ids in URLs."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarrycast.functions.domains import registrable
from quarrycast.functions.text import empty_to_null

# --- fixed values ---------------------------------------------------------------------------------------------
PATH_HOSTS = ["boards.greenhouse.io", "job-boards.greenhouse.io", "jobs.lever.co", "jobs.ashbyhq.com", "apply.workable.com", "careers.smartrecruiters.com"]
SHARED_HOSTS = [
    *PATH_HOSTS,
    "boards-api.greenhouse.io", "api.lever.co", "api.ashbyhq.com", "jobs.workable.com", "www.linkedin.com", "linkedin.com",
    "wellfound.com", "remoteok.com", "himalayas.app", "weworkremotely.com", "jobicy.com", "arbeitnow.com", "remotive.com",
    "instahyre.com",
]
SKIPPED_LABELS = ["jobs", "careers", "boards", "apply", "job-boards", "hire"]
BOARDS = [
    ("greenhouse", r"(?:boards|job-boards)\.greenhouse\.io/embed/job_board[^\"'\s<>]*?[?&]for=([A-Za-z0-9_.-]+)"),
    ("greenhouse", r"(?:boards|job-boards)\.greenhouse\.io/([A-Za-z0-9_.-]+)"),
    ("lever", r"jobs\.lever\.co/([A-Za-z0-9_.-]+)"),
    ("ashby", r"jobs\.ashbyhq\.com/([A-Za-z0-9_.-]+)"),
]
RESERVED = ["embed", "job_board", "api", "v0", "v1", "jobs", "job", "boards", "static"]
BOARD_URL = {"greenhouse": "https://job-boards.greenhouse.io/", "lever": "https://jobs.lever.co/", "ashby": "https://jobs.ashbyhq.com/"}
SHEET = r"/spreadsheets/d/([A-Za-z0-9_-]+)"
# ---------------------------------------------------------------------------------------------------------------


def host(url: Column) -> Column:
    return registrable(F.try_parse_url(url, F.lit("HOST")))


def company_from_url(url: Column) -> Column:
    """A display name: the path's first part on hosts that boards share, else the first telling label of the host."""
    h = host(url)
    part = F.get(F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/"), lambda p: p != ""), F.lit(0))
    labels = F.split(h, r"\.")
    label = F.when(labels[0].isin(SKIPPED_LABELS) & (F.size(labels) > 1), F.get(labels, F.lit(1))).otherwise(labels[0])
    named = F.when(h.isin(PATH_HOSTS) & part.isNotNull(), _title(F.translate(part, "-_", "  "))).otherwise(_title(F.translate(label, "-", " ")))
    return F.coalesce(empty_to_null(named), F.lit("Unknown"))


def _title(text: Column) -> Column:
    """text in lower case but for the first letter of each run of letters and digits, apostrophes within counted in."""
    pieces = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}\p{M}_'’]+|[^\p{L}\p{N}\p{M}_'’]+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), "")


def domain_from_url(url: Column) -> Column:
    """The host, or '' where many companies share it."""
    h = F.coalesce(host(url), F.lit(""))
    return F.when(h.isin(SHARED_HOSTS), "").otherwise(h)


def board_of(text: Column) -> Column:
    """(ats, slug) of the first job board linked in text, by the order of BOARDS; null if none."""
    found = []
    for ats, p in BOARDS:
        slugs = F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), lambda s: F.trim(s, F.lit("/.")))
        slug = F.get(F.filter(slugs, lambda s: (s != "") & ~F.lower(s).isin(RESERVED)), F.lit(0))
        found.append(F.when(slug.isNotNull(), F.struct(F.lit(ats).alias("ats"), slug.alias("slug"))))
    return F.coalesce(*found)


def board_link(ats: Column, slug: Column) -> Column:
    link = F.coalesce(*[F.when(ats == a, F.concat(F.lit(u), slug)) for a, u in BOARD_URL.items()])
    return F.coalesce(F.when(slug != "", link), F.lit("[no board known]"))


def sheet_id(text: Column) -> Column:
    """The id in a spreadsheet's URL, or the trimmed text itself."""
    return F.coalesce(empty_to_null(F.regexp_extract(text, SHEET, 1)), F.trim(text))


@F.pandas_udf(StringType())
def _join(bases: pd.Series, refs: pd.Series) -> pd.Series:
    return pd.Series([None if r is None else urljoin(b or "", r) for b, r in zip(bases, refs)])


def absolute(base: Column, ref: Column) -> Column:
    """ref against base; absolute and root-relative references are resolved in the JVM."""
    root = F.regexp_extract(base, r"^([a-zA-Z][\w+.-]*://[^/?#]+)", 1)
    easy = F.when(ref.startswith("http"), ref).when(ref.rlike(r"^/(?!/)") & ~ref.contains("/.") & (root != ""), F.concat(root, ref))
    return F.coalesce(easy, _join(base, F.when(easy.isNull(), ref)))
