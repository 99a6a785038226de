"""Epoch-aligned buckets and time literals."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_RELATIVE = re.compile(r"\s*([+-])\s*(\d+)\s*([smhd])\s*")
_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def bucket(time: Column, seconds: int, kind: str) -> Column:
    """The start of the epoch-aligned bucket; null stays null (a window() would drop the row)."""
    epoch = F.unix_seconds(time.cast("timestamp"))
    floor = epoch - F.pmod(epoch, F.lit(seconds))
    return F.timestamp_seconds(floor).cast(kind)


def literal(value: object, as_of: dt.datetime) -> dt.datetime | None:
    """A time from epoch seconds, "now", "-24h" or a timestamp's text; None if it is none of them."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, (int, float)):
        return dt.datetime.fromtimestamp(value, dt.timezone.utc).replace(tzinfo=None)
    text = str(value).strip()
    if text.lower() == "now":
        return as_of
    if m := _RELATIVE.fullmatch(text):
        step = dt.timedelta(seconds=int(m[2]) * _UNITS[m[3]])
        return as_of + step if m[1] == "+" else as_of - step
    try:
        found = dt.datetime.fromisoformat(text)
    except ValueError:
        return None
    return found.astimezone(dt.timezone.utc).replace(tzinfo=None) if found.tzinfo else found
