"""Small column helpers for strings, dates, arrays, JSON and maps."""

from __future__ import annotations

from pyspark.sql import functions as F


def csv_list(c):
    """Comma-separated text to trimmed, non-empty items."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def iso_timestamp(c):
    """ISO 8601 text with an offset, leniently, as a UTC timestamp."""
    return F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))


def step_prefix(c):
    """The ``step4`` part of ``2026-05-13-step4_walkforward``; empty when there is none."""
    return F.regexp_extract(c, r"(step\d+[a-z]?)", 1)


def compose_id(*parts):
    return F.concat_ws("_", *parts)


def floor_minutes(ts, minutes):
    return F.window(ts, f"{minutes} minutes")["start"]


def lookup(key, table):
    """Value of a fixed map, null for an unknown key."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def json_list(c, fields="feature string, op string, threshold double"):
    return F.from_json(c, f"array<struct<{fields}>>")
