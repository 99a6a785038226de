"""Attack stories: alerts chained by shared entities within a gap, over at least two tactics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.operators import severity
from logweave.operators.analytics import ENTITY_COLUMNS
from logweave.operators.graph import components
from logweave.scratch import written

#: Tactics in the order of a campaign, IT and OT merged.
TACTICS = (
    "reconnaissance", "resource-development", "initial-access", "execution", "persistence", "privilege-escalation",
    "defense-evasion", "evasion", "credential-access", "discovery", "lateral-movement", "collection",
    "command-and-control", "exfiltration", "inhibit-response-function", "impair-process-control", "impact",
)


def tactic(label: Column) -> Column:
    """Canonical spelling of a tactic: "attack.credential_access" and "credential access" are credential-access."""
    text = F.regexp_replace(F.lower(F.btrim(label)), r"^attack\.", "")
    return F.translate(text, "_ ", "--")


def tactic_rank(label: Column) -> Column:
    """Place in the order; unknown ones come last."""
    at = F.array_position(F.array(*[F.lit(t) for t in TACTICS]), tactic(label))
    return F.when(at > 0, at - 1).otherwise(len(TACTICS)).cast("int")


def _known(tactics: Column) -> Column:
    spelled = F.array_distinct(F.transform(F.coalesce(tactics, F.array().cast("array<string>")), tactic))
    return F.filter(spelled, lambda t: t.isin(*TACTICS))


#: Longest stretch of an entity's time line in one window, in gaps.
STRETCH_GAPS = 24


def edges(alerts: DataFrame, gap_s: float = 3600) -> DataFrame:
    """Pairs of alerts next to each other in an entity's time order, at most gap_s apart.

    The time line is cut into stretches of STRETCH_GAPS gaps, so that a busy entity is many windows. Where one stretch goes
    on in the next, the last alert of the one and the first of the other are neighbours: a row of each, stored, is joined.
    """
    each = F.array(*[F.struct(F.lit(k).alias("t"), F.col(c).alias("v")) for k, c in ENTITY_COLUMNS.items()])
    rows = alerts.select("alert_id", "event_time", F.explode(each).alias("e")).where("e.v is not null and e.v <> ''")
    micros = F.unix_micros(F.col("event_time").cast("timestamp"))
    stretch = F.floor(micros / max(1, int(STRETCH_GAPS * gap_s * 1e6)))
    rows = rows.select("alert_id", "e.t", "e.v", micros.alias("m"), stretch.alias("s")).where("m is not null")
    before = Window.partitionBy("t", "v", "s").orderBy("m", "alert_id")
    near = rows.select("alert_id", "m", F.lag("alert_id").over(before).alias("prev"), F.lag("m").over(before).alias("then"))
    at = F.struct("m", "alert_id")
    ends = written(rows.groupBy("t", "v", "s").agg(F.min(at).alias("first"), F.max(at).alias("last")), "stretches")
    following = ends.select("t", "v", (F.col("s") + 1).alias("s"), F.col("last").alias("_last"))
    seams = ends.join(following, ["t", "v", "s"]).select("first.alert_id", "first.m", F.col("_last.alert_id").alias("prev"), F.col("_last.m").alias("then"))
    close = F.col("prev").isNotNull() & ((F.col("m") - F.col("then")) / 1e6 <= gap_s)
    return near.unionByName(seams).where(close).select(F.col("alert_id").alias("a"), F.col("prev").alias("b")).distinct()


def chains(alerts: DataFrame, gap_s: float = 3600) -> DataFrame:
    """alerts with chain_id, the least alert id that links reach; unlinked alerts are chains of one. Alerts are stored, since
    they are read for links, for seams and for the result: what makes them runs once."""
    alerts = written(alerts, "alerts")
    named = components(edges(alerts, gap_s)).select(F.col("node").alias("alert_id"), "component")
    return alerts.join(named, "alert_id", "left").withColumn("chain_id", F.coalesce("component", "alert_id")).drop("component")


def stories(chained: DataFrame, min_tactics: int = 2) -> DataFrame:
    """One row per chain over enough tactics: stages in order, techniques, severity, span, pivots and a signature."""
    rows = chained.withColumn("_tactics", _known(F.col("tactics")))
    out = rows.groupBy("chain_id").agg(
        F.count(F.lit(1)).alias("alert_count"),
        F.min("event_time").alias("first_time"),
        F.max("event_time").alias("last_time"),
        severity.highest(F.col("level")).alias("severity"),
        F.array_distinct(F.flatten(F.collect_set("_tactics"))).alias("_all"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("techniques")))).alias("techniques"),
        F.sha2(F.concat(F.lit("kc|"), F.array_join(F.transform(F.array_sort(F.collect_list("alert_id")), lambda i: i.cast("string")), ",")), 256).alias("signature"),
    )
    ordered = F.filter(F.array(*[F.lit(t) for t in TACTICS]), lambda t: F.array_contains("_all", t))
    out = out.withColumn("stages", ordered).withColumn("tactic_count", F.size("stages")).where(F.col("tactic_count") >= min_tactics).drop("_all")
    return out.join(pivots(chained), "chain_id", "left")


def pivots(chained: DataFrame) -> DataFrame:
    """Entities that two or more alerts of a chain share, the most shared first."""
    each = F.array(*[F.struct(F.lit(k).alias("t"), F.col(c).alias("v")) for k, c in ENTITY_COLUMNS.items()])
    rows = chained.select("chain_id", F.explode(each).alias("e")).where("e.v is not null and e.v <> ''")
    shared = rows.groupBy("chain_id", "e.t", "e.v").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    one = F.struct((-F.col("n")).alias("o"), "t", "v", "n")
    listed = F.transform(F.array_sort(F.collect_list(one)), lambda x: F.concat_ws(" ", x["t"], x["v"]))
    return shared.groupBy("chain_id").agg(listed.alias("pivots"))


def ranked(found: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """The gravest first; stories whose signature a case already has are left out."""
    if existing is not None:
        found = found.join(existing.select("signature"), "signature", "left_anti")
    return found.orderBy(severity.rank(F.col("severity")).desc(), F.col("tactic_count").desc(), F.col("last_time").desc(), "chain_id")
