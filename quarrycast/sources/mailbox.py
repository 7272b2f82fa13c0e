"""Mailbox payloads: MIME trees to plain text, and which messages are new."""

from __future__ import annotations

import base64
import binascii
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

DEEPEST = 8  #: levels of parts that are looked into


def _decode(data: str) -> str:
    for decoder in (base64.urlsafe_b64decode, base64.b64decode):
        try:
            return decoder(data + "=" * (-len(data) % 4)).decode("utf-8", "replace")
        except (binascii.Error, ValueError):
            continue
    return ""


def plain_text(part: dict | None, depth: int = 0) -> str:
    """The first text/plain part, depth first; else markup with its tags as spaces."""
    if not isinstance(part, dict) or depth > DEEPEST:
        return ""
    kind, data = part.get("mimeType") or "", (part.get("body") or {}).get("data") or ""
    if kind.startswith("text/plain") and data:
        return _decode(data)
    for sub in part.get("parts") or []:
        if text := plain_text(sub, depth + 1):
            return text
    return re.sub(r"<[^<>]*>", " ", _decode(data)) if kind.startswith("text/html") and data else ""


@F.pandas_udf(StringType())
def _flatten(payloads: pd.Series) -> pd.Series:
    def one(p):
        try:
            return plain_text(json.loads(p))
        except (TypeError, ValueError):
            return ""

    return payloads.map(one)


def body_of(payload: Column) -> Column:
    """The text of a JSON MIME tree; '' where there is none."""
    return _flatten(payload)


def header(payload: Column, name: str) -> Column:
    """The value of the last header of that name, whatever its case."""
    headers = F.from_json(payload, "struct<headers: array<struct<name: string, value: string>>>")["headers"]
    own = F.filter(headers, lambda h: F.lower(h["name"]) == name)
    return F.element_at(F.when(F.size(own) > 0, own), -1)["value"]


def unseen(listed: DataFrame, recorded: DataFrame, key: str = "gmail_id") -> DataFrame:
    """Listed messages that aren't recorded yet, before their bodies are fetched."""
    return listed.where(F.col(key).isNotNull()).join(recorded.select(key).distinct(), key, "left_anti")
