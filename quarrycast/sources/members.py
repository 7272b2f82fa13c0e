"""Membership lists and rule files: small, read on the driver."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession

FIELDS = ["name", "domain", "careers_url", "ats", "slug", "priority", "notes"]


def load(path: str, key: str = "companies") -> list[dict]:
    """Entries of a JSON file, or of YAML where a reader for it is installed; those without a name are left out, a
    missing file is empty."""
    if not os.path.exists(path):
        return []
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        data = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError(f"{path} isn't JSON, and no YAML reader is installed") from e
        data = yaml.safe_load(text)
    rows = data.get(key, []) if isinstance(data, dict) else data or []
    return [r for r in rows if isinstance(r, dict) and str(r.get("name") or "").strip()]


def save(entries: list[dict], path: str, key: str = "companies") -> None:
    """Write entries whole: to a file beside, then over the old one."""
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        json.dump({key: entries}, f, ensure_ascii=False, indent=2)
    os.replace(f"{path}.new", path)


def find(entries: list[dict], name: str) -> dict | None:
    return next((e for e in entries if e["name"].lower() == name.lower()), None)


def append(path: str, entry: dict, key: str = "companies") -> bool:
    """Add an entry unless its name is there; whether it was added."""
    entries = load(path, key)
    if find(entries, entry["name"]):
        return False
    save([*entries, entry], path, key)
    return True


def frame(spark: SparkSession, entries: list[dict]) -> DataFrame:
    schema = ", ".join(f"{f} string" for f in FIELDS) + ", watchlist_enabled int"
    return spark.createDataFrame([(*[e.get(f) for f in FIELDS], int(e.get("enabled", True))) for e in entries], schema)
