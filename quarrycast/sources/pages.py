"""Captured pages: title and readable text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarrycast.functions.text import empty_to_null, unescape
from quarrycast.sources.feeds import tree

#: Fixed value: elements whose text is none of the page's.
DROPPED = {"script", "style", "nav", "footer", "header", "noscript", "head"}


def title_of(page: Column) -> Column:
    """og:title, else <title>, else the first <h1>; null if all are empty."""
    meta = F.regexp_extract(page, r"""(?is)<meta\s[^>]*property=["']og:title["'][^>]*>""", 0)
    og = F.regexp_extract(meta, r"""(?is)content=["']([^"']*)["']""", 1)
    bare = lambda rx: F.regexp_replace(F.regexp_extract(page, rx, 1), r"<[^>]+>", "")
    return F.coalesce(*[empty_to_null(F.trim(unescape(c))) for c in (og, bare(r"(?is)<title[^>]*>(.*?)</title>"), bare(r"(?is)<h1[^>]*>(.*?)</h1>"))])


@F.pandas_udf(StringType())
def _text(pages: pd.Series) -> pd.Series:
    def walk(node):
        return "".join(c if isinstance(c, str) else walk(c) for c in node[2] if isinstance(c, str) or c[0] not in DROPPED)

    def one(p):
        if p is None:
            return None
        t = re.sub(r"[ \t]+", " ", walk(tree(p)))
        return re.sub(r"\n{3,}", "\n\n", t).strip()

    return pages.map(one)


def text_of(page: Column) -> Column:
    """The page's text without scripts, styles and frames around it, squeezed."""
    return _text(page)
