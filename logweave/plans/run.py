"""Running of a query text over an events table."""

from __future__ import annotations

import datetime as dt
import threading
import time
import uuid
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame

from logweave.errors import QueryError
from logweave.plans.lower import Lowering
from logweave.plans.parser import parse

DEFAULT_LIMIT, HARD_LIMIT = 1000, 100_000
TIMEOUT_S = 30


def pipe(
    events: DataFrame,
    text: str,
    *,
    as_of: dt.datetime | None = None,
    models=None,
    base: Column | None = None,
    limit: int | None = DEFAULT_LIMIT,
) -> DataFrame:
    """The query's DataFrame. base is a trusted row filter that comes before everything; limit None means all rows."""
    now = as_of or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    return Lowering(events, now, models).run(parse(text), base, limit)


@dataclass
class Result:
    query: str
    fields: list[str]
    rows: list[dict]
    count: int
    elapsed_ms: int
    truncated: bool


def _plain(value):
    return float(value) if isinstance(value, Decimal) else value


def run(events: DataFrame, text: str, *, limit: int = DEFAULT_LIMIT, timeout_s: float = TIMEOUT_S, **kw) -> Result:
    """Collects at most limit rows; a query that takes longer than timeout_s is interrupted. Failures are QueryErrors."""
    limit = max(1, min(limit, HARD_LIMIT))
    spark, tag, began = events.sparkSession, f"pipe-{uuid.uuid4().hex}", time.monotonic()
    out = pipe(events, text, limit=limit + 1, **kw)
    timer = threading.Timer(timeout_s, lambda: spark.interruptTag(tag))
    spark.addTag(tag)
    timer.start()
    try:
        rows = out.collect()
    except Exception as e:
        reason = str(e).split("\n")[0][:300]
        if time.monotonic() - began >= timeout_s:
            reason = f"the query took more than {timeout_s:g} s"
        raise QueryError(reason) from e
    finally:
        timer.cancel()
        spark.removeTag(tag)
    found = [{k: _plain(v) for k, v in r.asDict().items()} for r in rows[:limit]]
    return Result(text, out.columns, found, len(found), int(1000 * (time.monotonic() - began)), len(rows) > limit)
