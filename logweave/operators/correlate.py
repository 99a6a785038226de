"""Threshold correlations over a look-back window, in batch and as a stream, and their alerts."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.errors import ConfigError

GROUPABLE = frozenset("vendor product log_type severity action src_ip dst_ip src_port dst_port protocol app user_name host_name rule_name".split())


@dataclass(frozen=True)
class Correlation:
    id: str
    title: str
    window_s: int
    threshold: int
    group_by: tuple[str, ...]
    filters: dict = field(default_factory=dict)
    distinct: str | None = None
    level: str = "high"
    techniques: tuple[str, ...] = ()
    tactics: tuple[str, ...] = ()

    @classmethod
    def parse(cls, doc: dict) -> Correlation:
        by = doc.get("group_by") or []
        by = tuple([by] if isinstance(by, str) else by)
        if not 1 <= len(by) <= 2 or not set(by) <= GROUPABLE:
            raise ConfigError(f"{doc.get('id')}: group_by takes one or two columns of events")
        unknown = set(doc.get("match") or {}) - GROUPABLE
        if unknown or (doc.get("distinct") and doc["distinct"] not in GROUPABLE):
            raise ConfigError(f"{doc.get('id')}: unknown column {sorted(unknown) or doc.get('distinct')}")
        window, threshold = int(doc["window_s"]), int(doc["threshold"])
        if window <= 0 or threshold <= 0:
            raise ConfigError(f"{doc.get('id')}: window and threshold are positive")
        return cls(
            str(doc["id"]), str(doc.get("title") or doc["id"]), window, threshold, by, dict(doc.get("match") or {}), doc.get("distinct"),
            str(doc.get("level") or "high"), tuple(doc.get("techniques") or ()), tuple(doc.get("tactics") or ()),
        )

    def condition(self) -> Column:
        """All filters, case-insensitively, no null key, and no null among the values that are counted."""
        out = F.lit(True)
        for name, wanted in self.filters.items():
            values = [str(v).lower() for v in (wanted if isinstance(wanted, (list, tuple)) else [wanted])]
            out = out & F.coalesce(F.lower(F.col(name).cast("string")).isin(*values), F.lit(False))
        for name in (*self.group_by, *([self.counted] if self.counted else [])):
            out = out & F.col(name).isNotNull()
        return out

    @property
    def counted(self) -> str | None:
        """The column whose distinct values count; a key would always have one, then events count."""
        return None if self.distinct in self.group_by else self.distinct


def correlate(events: DataFrame, rule: Correlation, as_of: dt.datetime) -> DataFrame:
    """Groups of the last window that reach the threshold: the keys, n, first_seen, last_seen."""
    since = as_of - dt.timedelta(seconds=rule.window_s)
    rows = events.where((F.col("event_time") >= F.lit(since)) & (F.col("event_time") <= F.lit(as_of)) & rule.condition())
    n = F.count_distinct(rule.counted) if rule.counted else F.count(F.lit(1))
    out = rows.groupBy(*rule.group_by).agg(n.alias("n"), F.min("event_time").alias("first_seen"), F.max("event_time").alias("last_seen"))
    return out.where(F.col("n") >= rule.threshold)


def group_text(rule: Correlation) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in rule.group_by])


def alerts(found: DataFrame, rule: Correlation, as_of: dt.datetime) -> DataFrame:
    """One alert per group and window-sized bucket of time, so that repeated runs do not repeat it."""
    bucket = int(as_of.replace(tzinfo=dt.timezone.utc).timestamp()) // rule.window_s
    what = f"distinct {rule.counted}" if rule.counted else "events"
    return found.select(
        F.lit(rule.id).alias("rule_id"),
        F.lit(rule.title).alias("rule_title"),
        F.lit(rule.level).alias("level"),
        *rule.group_by,
        "n",
        F.concat(F.col("n").cast("string"), F.lit(f" {what} in {rule.window_s} s for "), group_text(rule)).alias("message"),
        F.sha2(F.concat_ws("|", F.lit(rule.id), group_text(rule), F.lit(str(bucket))), 256).alias("dedup_hash"),
        F.col("last_seen").alias("event_time"),
    )


def buckets(events: DataFrame, rule: Correlation) -> DataFrame:
    """The rule over history: tumbling windows instead of one look-back."""
    n = F.count_distinct(rule.counted) if rule.counted else F.count(F.lit(1))
    out = events.where(rule.condition()).groupBy(F.window("event_time", f"{rule.window_s} seconds").alias("w"), *rule.group_by).agg(n.alias("n"))
    return out.where(F.col("n") >= rule.threshold).select(F.col("w.start").alias("bucket"), *rule.group_by, "n")


def stream(events: DataFrame, rule: Correlation, slide_s: int = 60, late_s: int | None = None) -> DataFrame:
    """Sliding windows over a stream. Events later than the watermark (twice the window by default) are left out."""
    late = late_s if late_s is not None else 2 * rule.window_s
    # exact distinct counts are not kept by a stream; the set's size is, and it is exact
    n = F.size(F.collect_set(rule.counted)) if rule.counted else F.count(F.lit(1))
    window = F.window("event_time", f"{rule.window_s} seconds", f"{min(slide_s, rule.window_s)} seconds").alias("w")
    out = events.withWatermark("event_time", f"{late} seconds").where(rule.condition()).groupBy(window, *rule.group_by).agg(n.cast("long").alias("n"))
    return out.where(F.col("n") >= rule.threshold).select(
        F.lit(rule.id).alias("rule_id"), F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *rule.group_by, "n"
    )
