"""Writes of analysts and of the detection path: alerts, cases, suppression counters, indicators and baselines."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.operators import severity
from logweave.operators.tables import Table

_old = lambda was, new: was


def store_alerts(alerts: Table, found: DataFrame) -> int:
    """Adds alerts whose key is not there; those that are stay as they are, with what analysts did to them."""
    return alerts.upsert(found, {c: _old for c in found.columns})


def set_status(alerts: Table, ids: Iterable, status: str) -> int:
    return alerts.change(F.col("alert_id").isin(*ids), {"status": F.lit(status)})


def set_assignee(alerts: Table, ids: Iterable, assignee: str | None) -> int:
    return alerts.change(F.col("alert_id").isin(*ids), {"assignee": F.lit(assignee or None).cast("string")})


def add_to_case(alerts: Table, cases: Table, case_id, ids: Iterable, now: dt.datetime) -> None:
    """Puts alerts in a case, whose severity becomes at least that of any of them."""
    mine = F.col("alert_id").isin(*ids)
    top = alerts.read().where(mine).agg(F.max(severity.rank(F.col("level")))).first()[0]
    alerts.change(mine, {"case_id": F.lit(case_id)})
    raised = F.greatest(severity.rank(F.col("severity")), F.lit(top))
    if top is not None:
        cases.change(F.col("case_id") == F.lit(case_id), {"severity": severity.name(raised), "updated_at": F.lit(now)})


def remove_from_case(alerts: Table, ids: Iterable) -> int:
    return alerts.change(F.col("alert_id").isin(*ids), {"case_id": F.lit(None)})


def update_case(cases: Table, case_id, now: dt.datetime, **fields: str | None) -> int:
    """Sets title, summary, status, severity or assignee; a case that is closed gets the time, another loses it."""
    values: dict[str, Column] = {k: F.lit(v or None).cast("string") for k, v in fields.items() if k in ("title", "summary", "status", "severity", "assignee")}
    if "status" in fields:
        values["closed_at"] = F.lit(now) if fields["status"] == "closed" else F.lit(None).cast("timestamp")
    return cases.change(F.col("case_id") == F.lit(case_id), values | {"updated_at": F.lit(now)})


def count_suppressions(suppressions: Table, muted: DataFrame, now: dt.datetime) -> int:
    """Adds to the counters of the suppressions (column suppression_id) that muted alerts. Unknown ones are passed over."""
    hits = muted.where("suppression_id is not null").groupBy("suppression_id").agg(F.count(F.lit(1)).alias("hit_count"))
    known = hits.join(suppressions.read().select("suppression_id"), "suppression_id", "left_semi").withColumn("last_hit", F.lit(now))
    return suppressions.upsert(known, {"hit_count": lambda was, new: F.coalesce(was, F.lit(0)) + new})


def upsert_indicators(iocs: Table, rows: DataFrame, now: dt.datetime) -> int:
    """Adds or renews indicators (indicator, ioc_type, source, severity, description); renewed ones are enabled."""
    return iocs.upsert(rows.withColumns({"added_at": F.lit(now), "enabled": F.lit(True)}))


def replace_indicators(iocs: Table, source: str, rows: DataFrame, now: dt.datetime) -> int:
    """A feed's indicators in place of its last ones."""
    iocs.delete(F.col("source") == source)
    return upsert_indicators(iocs, rows, now)


def update_baselines(known: Table, batch: DataFrame) -> int:
    """Entity baselines after a batch of new events: only the buckets of the batch's entities are rewritten."""
    from logweave.operators.analytics import entities

    return known.upsert(
        entities(batch), {"first_seen": F.least, "last_seen": F.greatest, "event_count": lambda was, new: was + new}
    )
