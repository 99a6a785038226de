"""Fixed analytic queries over events and alerts: dashboards, entity risk, OT activity, source health, cases."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions import ip, text
from logweave.operators import severity

#: Protocol tags of operational technology.
OT_PROTOCOLS = ("modbus", "dnp3", "s7comm", "cip", "enip", "bacnet", "iec104", "opcua", "profinet")
ENTITY_COLUMNS = {"user": "user_name", "host": "host_name", "ip": "src_ip"}


# -- dashboards ------------------------------------------------------------------------------------------------


def form_search(events: DataFrame, *, equal: dict | None = None, address: str | None = None, contains: dict | None = None, words: str | None = None, since=None, until=None) -> DataFrame:
    """The search form: equalities, an address or network on either side, substrings, words, a time range."""
    cond = F.lit(True)
    for name, value in (equal or {}).items():
        cond = cond & (F.col(name) == value)
    if address:
        network = address if "/" in address else f"{address}/{128 if ':' in address else 32}"
        cond = cond & (ip.inside(ip.key(F.col("src_ip")), network) | ip.inside(ip.key(F.col("dst_ip")), network))
    for name, value in (contains or {}).items():
        cond = cond & F.lower(F.col(name)).contains(value.lower())
    if words:
        cond = cond & text.web_search(F.col("search_tokens"), words)
    if since is not None:
        cond = cond & (F.col("event_time") >= F.lit(since))
    if until is not None:
        cond = cond & (F.col("event_time") < F.lit(until))
    return events.where(cond)


def page(rows: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(F.col("event_time").desc_nulls_last(), F.col("id").desc()).offset(offset).limit(limit)


def distinct_values(events: DataFrame, column: str, limit: int = 200) -> DataFrame:
    return events.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column).limit(limit)


def totals(events: DataFrame, as_of: dt.datetime) -> DataFrame:
    day = as_of - dt.timedelta(days=1)
    return events.agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("event_time") >= F.lit(day)).alias("last_day"),
        F.count_distinct("vendor").alias("vendors"),
        F.count_distinct("src_ip").alias("sources"),
        F.min("event_time").alias("first_seen"),
        F.max("event_time").alias("last_seen"),
    )


def daily_counts(events: DataFrame, by: str | None = None) -> DataFrame:
    keys = [F.to_date("event_time").alias("day")] + ([F.col(by)] if by else [])
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def top_values(rows: DataFrame, column: str, limit: int) -> DataFrame:
    out = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.col("n").desc(), column).limit(limit)


def source_activity(events: DataFrame) -> DataFrame:
    return events.groupBy("vendor", "log_type").agg(F.max("event_time").alias("last_seen"), F.count(F.lit(1)).alias("n"))


def silent_sources(events: DataFrame, as_of: dt.datetime, *, learn_days: int = 7, silent_hours: float = 24, least: int = 10) -> DataFrame:
    """Sources that were active in the learning window and have been quiet for longer than silent_hours."""
    since = as_of - dt.timedelta(days=learn_days)
    quiet = as_of - dt.timedelta(hours=silent_hours)
    seen = source_activity(events.where((F.col("event_time") >= F.lit(since)) & (F.col("event_time") <= F.lit(as_of))))
    return seen.where((F.col("n") >= least) & (F.col("last_seen") < F.lit(quiet)))


def silence_alerts(silent: DataFrame, as_of: dt.datetime, repeat_hours: int = 24) -> DataFrame:
    bucket = int(as_of.replace(tzinfo=dt.timezone.utc).timestamp()) // (repeat_hours * 3600)
    return silent.select(
        F.lit("source-silent").alias("rule_id"), "vendor", "log_type", "last_seen",
        F.sha2(F.concat_ws("|", F.lit("source-silent"), "vendor", "log_type", F.lit(str(bucket))), 256).alias("dedup_hash"),
    )


# -- alerts and cases ------------------------------------------------------------------------------------------


def recent_alerts(alerts: DataFrame, *, status: str | None = None, level: str | None = None, hide_suppressed: bool = True) -> DataFrame:
    cond = F.col("status") == status if status else (F.col("status") != "suppressed") if hide_suppressed else F.lit(True)
    if level:
        cond = cond & (F.lower("level") == level.lower())
    return alerts.where(cond)


def counts_by(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def technique_counts(alerts: DataFrame) -> DataFrame:
    return alerts.select(F.explode("techniques").alias("technique")).groupBy("technique").agg(F.count(F.lit(1)).alias("n"))


def rule_stats(rules: DataFrame, alerts: DataFrame, suppressed: DataFrame) -> DataFrame:
    """Every rule with its alerts and suppressions, zero where there are none."""
    fired = alerts.groupBy("rule_id").agg(F.count(F.lit(1)).alias("alerts"), F.max("event_time").alias("last_alert"))
    muted = suppressed.groupBy("rule_id").agg(F.count(F.lit(1)).alias("suppressed"))
    out = rules.join(fired, "rule_id", "left").join(muted, "rule_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("alerts", "suppressed")})


def case_rollup(cases: DataFrame, alerts: DataFrame) -> DataFrame:
    """Cases with their alert count and a severity that is at least that of any member."""
    members = alerts.where(F.col("case_id").isNotNull()).groupBy("case_id").agg(
        F.count(F.lit(1)).alias("alert_count"), F.max(severity.rank(F.col("level"))).alias("_top")
    )
    top = F.greatest(severity.rank(F.col("severity")), F.coalesce("_top", F.lit(0)))
    out = cases.join(members, "case_id", "left").withColumn("severity", severity.name(top))
    return out.withColumn("alert_count", F.coalesce("alert_count", F.lit(0))).drop("_top")


def related_open_alerts(alerts: DataFrame, entities: DataFrame) -> DataFrame:
    """Alerts that belong to no case and are not suppressed, and share a user, a host or an address with the given ones."""
    free = F.col("case_id").isNull() if "case_id" in alerts.columns else F.lit(True)
    return _sharing(alerts.where(free & (F.col("status") != "suppressed")), entities)


def related_to_alert(alerts: DataFrame, alert_id, limit: int = 8) -> DataFrame:
    """The latest alerts, but suppressed ones, that share a user, a host or an address with one alert."""
    others = alerts.where((F.col("alert_id") != F.lit(alert_id)) & (F.col("status") != "suppressed"))
    found = _sharing(others, alerts.where(F.col("alert_id") == F.lit(alert_id)))
    return found.orderBy(F.col("event_time").desc_nulls_last(), F.col("alert_id").desc()).limit(limit)


def _sharing(alerts: DataFrame, entities: DataFrame) -> DataFrame:
    """Alerts with an entity of the given rows: three equi-joins, not one OR."""
    hits = None
    for column in ENTITY_COLUMNS.values():
        values = entities.select(column).where(F.col(column).isNotNull()).distinct()
        part = alerts.join(values, column, "left_semi").select("alert_id")
        hits = part if hits is None else hits.unionByName(part)
    return alerts.join(hits.distinct(), "alert_id", "left_semi")


def recent_uncased(alerts: DataFrame, as_of: dt.datetime, hours: float = 24, limit: int = 5000) -> DataFrame:
    """The oldest alerts of the last hours that belong to no case and are neither closed nor suppressed: what stories
    are made of. An alert without a time counts by created_at, where there is such a column."""
    time = F.coalesce("event_time", "created_at") if "created_at" in alerts.columns else F.col("event_time")
    free = F.col("case_id").isNull() & ~F.col("status").isin("suppressed", "closed")
    return alerts.where(free & (time >= F.lit(as_of - dt.timedelta(hours=hours)))).orderBy(time, "alert_id").limit(limit)


SUPPRESSION_COLUMNS = {"rule_id": "rule_id", "user_name": "user_name", "host_name": "host_name", "vendor": "vendor"}


def suppress(alerts: DataFrame, suppressions: list[dict]) -> DataFrame:
    """Marks alerts by the first suppression whose set conditions all hold; one without conditions never does.

    Suppressions are configuration: they become one expression, and alerts stay, with status and suppression id.
    """
    found = F.lit(None).cast("string")
    for s in reversed(suppressions):
        tests = []
        for name, column in SUPPRESSION_COLUMNS.items():
            if s.get(name):
                tests.append(F.coalesce(F.lower(F.col(column)) == str(s[name]).lower(), F.lit(False)))
        if s.get("src_ip"):
            net = s["src_ip"] if "/" in s["src_ip"] else f"{s['src_ip']}/{128 if ':' in s['src_ip'] else 32}"
            tests.append(ip.inside(ip.key(F.col("src_ip")), net))
        if not tests or s.get("enabled") is False:
            continue
        cond = tests[0]
        for t in tests[1:]:
            cond = cond & t
        found = F.when(cond, F.lit(str(s["id"]))).otherwise(found)
    out = alerts.withColumn("suppression_id", found)
    return out.withColumn("status", F.when(F.col("suppression_id").isNotNull(), F.lit("suppressed")).otherwise(F.col("status")))


# -- entities --------------------------------------------------------------------------------------------------


def entities(events: DataFrame) -> DataFrame:
    """Users, hosts and addresses with first and last sight and count: one explode and one combined aggregation."""
    each = F.array(*[F.struct(F.lit(k).alias("t"), F.col(c).alias("v")) for k, c in ENTITY_COLUMNS.items()])
    rows = events.select("event_time", F.explode(each).alias("e")).where("e.v is not null and e.v <> ''")
    return rows.groupBy(F.col("e.t").alias("entity_type"), F.col("e.v").alias("entity_value")).agg(
        F.min("event_time").alias("first_seen"), F.max("event_time").alias("last_seen"), F.count(F.lit(1)).alias("event_count")
    )


LINKS = (("user", "user_name", "ip", "src_ip"), ("user", "user_name", "host", "host_name"), ("host", "host_name", "ip", "dst_ip"))


def entity_links(events: DataFrame) -> DataFrame:
    each = F.array(
        *[F.struct(F.lit(a).alias("t"), F.col(ca).alias("v"), F.lit(b).alias("pt"), F.col(cb).alias("pv")) for a, ca, b, cb in LINKS]
    )
    rows = events.select("event_time", F.explode(each).alias("e")).where("e.v is not null and e.pv is not null")
    keys = {"t": "entity_type", "v": "entity_value", "pt": "peer_type", "pv": "peer_value"}
    return rows.groupBy(*[F.col(f"e.{k}").alias(n) for k, n in keys.items()]).agg(
        F.min("event_time").alias("first_seen"), F.max("event_time").alias("last_seen"), F.count(F.lit(1)).alias("n")
    )


def merge_baseline(old: DataFrame, new: DataFrame, keys: list[str], count: str) -> DataFrame:
    """An upsert: earliest first, latest last, counts added."""
    return old.unionByName(new).groupBy(*keys).agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum(count).alias(count)
    )


def new_entities(known: DataFrame, as_of: dt.datetime, hours: float = 24) -> DataFrame:
    return known.where(F.col("first_seen") >= F.lit(as_of - dt.timedelta(hours=hours)))


def new_associations(known: DataFrame, links: DataFrame, as_of: dt.datetime, hours: float = 24, settled_hours: float = 1) -> DataFrame:
    """Recent links of entities that were known before the link appeared."""
    recent = links.where(F.col("first_seen") >= F.lit(as_of - dt.timedelta(hours=hours)))
    old = known.select("entity_type", "entity_value", F.col("first_seen").alias("known_since"))
    settled = F.col("known_since") < F.col("first_seen") - F.expr(f"INTERVAL {int(settled_hours * 3600)} SECOND")
    return recent.join(old, ["entity_type", "entity_value"]).where(settled)


def risk(alerts: DataFrame, as_of: dt.datetime, *, half_life_days: float = 7.0, window_days: int = 30) -> DataFrame:
    """Decayed, weighted alert scores of entities; suppressed alerts do not count. An alert's age is that of created_at,
    where there is such a column, else of its event."""
    time = F.col("created_at" if "created_at" in alerts.columns else "event_time")
    shown = F.col("status") != "suppressed" if "status" in alerts.columns else F.lit(True)
    since = F.lit(as_of - dt.timedelta(days=window_days))
    each = F.array(*[F.struct(F.lit(k).alias("t"), F.col(c).alias("v")) for k, c in ENTITY_COLUMNS.items()])
    age = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(time.cast("timestamp"))) / 1e6
    score = severity.weight(F.col("level")) * severity.decay(age, half_life_days)
    rows = alerts.where((time >= since) & shown).select(score.alias("s"), F.explode(each).alias("e")).where("e.v is not null")
    return rows.groupBy(F.col("e.t").alias("entity_type"), F.col("e.v").alias("entity_value")).agg(
        F.sum("s").alias("score"), F.count(F.lit(1)).alias("alerts")
    )


def top_risk(alerts: DataFrame, known: DataFrame, as_of: dt.datetime, limit: int = 20, **kw) -> DataFrame:
    scored = risk(alerts, as_of, **kw).join(known, ["entity_type", "entity_value"], "left")
    return scored.orderBy(F.col("score").desc(), "entity_type", "entity_value").limit(limit)


# -- operational technology --------------------------------------------------------------------------------------


def _operation(raw_key: str = "ot") -> Column:
    return F.get_json_object("raw", f"$['{raw_key}']['operation']")


def ot_events(events: DataFrame, operation: Column | None = None) -> DataFrame:
    return events.where(F.col("log_type").isin(*OT_PROTOCOLS)).withColumn("operation", _operation() if operation is None else operation)


def ot_summary(ot: DataFrame) -> DataFrame:
    return ot.groupBy(F.col("log_type").alias("protocol")).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("operation") == "read").alias("reads"),
        F.count_if(F.col("operation") == "write").alias("writes"),
        F.count_if(F.col("operation") == "control").alias("controls"),
        F.count_distinct("dst_ip").alias("controllers"),
        F.max("event_time").alias("last_seen"),
    )


def ot_assets(ot: DataFrame) -> DataFrame:
    return ot.where(F.col("dst_ip").isNotNull()).groupBy("dst_ip").agg(
        F.array_sort(F.collect_set("log_type")).alias("protocols"),
        F.count_distinct("src_ip").alias("masters"),
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("operation").isin("write", "control")).alias("changes"),
        F.max("event_time").alias("last_seen"),
    )


def ot_conversations(ot: DataFrame, as_of: dt.datetime, new_hours: float = 24) -> DataFrame:
    """Masters and controllers with a class: new writers first, then new, then known ones."""
    out = ot.where(F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull()).groupBy("src_ip", "dst_ip").agg(
        F.array_sort(F.collect_set("log_type")).alias("protocols"),
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("operation") == "write").alias("writes"),
        F.count_if(F.col("operation") == "control").alias("controls"),
        F.min("event_time").alias("first_seen"),
    )
    new = F.col("first_seen") >= F.lit(as_of - dt.timedelta(hours=new_hours))
    active = F.col("writes") + F.col("controls") > 0
    return out.withColumn("class", F.when(new & active, "new-writer").when(new, "new").otherwise("known"))


def in_class_order(conversations: DataFrame) -> DataFrame:
    first = F.when(F.col("class") == "new-writer", 0).when(F.col("class") == "new", 1).otherwise(2)
    return conversations.orderBy(first, (F.col("writes") + F.col("controls")).desc(), F.col("events").desc(), "src_ip", "dst_ip")


# -- registries --------------------------------------------------------------------------------------------------

RANKS = ("critical", "high", "medium", "low")


def registry_page(rows: DataFrame, aliases: DataFrame, id_: str, rank: str, *, find: str | None = None, search=(), limit: int = 500, offset: int = 0) -> DataFrame:
    """A page of assets or identities, the most important first, with their sorted "type:value" aliases: an empty list
    where there are none. find is looked for in the search columns whatever its case."""
    if find:
        low = find.lower()
        hits = [F.coalesce(F.lower(c).contains(low), F.lit(False)) for c in (id_, *search)]
        rows = rows.where(F.exists(F.array(*hits), lambda h: h))
    order = F.coalesce(F.array_position(F.array(*[F.lit(r) for r in RANKS]), F.col(rank)), F.lit(0))
    order = [F.when(order == 0, len(RANKS) + 1).otherwise(order), F.col(id_)]
    shown = rows.orderBy(*order).offset(offset).limit(limit)
    each = F.concat_ws(":", "alias_type", "alias_value")
    known = aliases.where("alias_type is not null").join(shown.select(id_), id_, "left_semi")
    known = known.groupBy(id_).agg(F.transform(F.array_sort(F.collect_list(F.struct("alias_type", "alias_value", each.alias("x")))), lambda s: s["x"]).alias("aliases"))
    out = shown.join(known, id_, "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
    return out.orderBy(*order)


# -- coverage and compliance -------------------------------------------------------------------------------------


def coverage(rules: DataFrame) -> DataFrame:
    """Enabled rules per technique: rules has rule_id, level, techniques, tactics."""
    rows = rules.select("rule_id", "level", F.explode("techniques").alias("technique"))
    return rows.groupBy("technique").agg(
        F.count_distinct("rule_id").alias("rules"), severity.highest(F.col("level")).alias("highest")
    )


def tactic_coverage(rules: DataFrame) -> DataFrame:
    rows = rules.select("rule_id", F.explode("tactics").alias("tactic"), F.size("techniques").alias("n"))
    return rows.groupBy("tactic").agg(F.count_distinct("rule_id").alias("rules"), F.sum("n").alias("techniques"))


def coverage_map(rules: DataFrame) -> DataFrame:
    """Rules, enabled ones, and covered and uncovered techniques for each tactic; rules without one are "(untagged)".

    rules has rule_id, enabled, techniques, tactics. A technique is covered in a tactic if an enabled rule has both.
    """
    tactics = F.when(F.size("tactics") > 0, F.col("tactics")).otherwise(F.array(F.lit("(untagged)")))
    each = rules.select("rule_id", F.coalesce("enabled", F.lit(False)).alias("on"), "techniques", F.explode(tactics).alias("tactic"))
    counts = each.groupBy("tactic").agg(F.count_distinct("rule_id").alias("rules"), F.count_distinct(F.when(F.col("on"), F.col("rule_id"))).alias("enabled_rules"))
    pairs = each.select("tactic", "on", F.explode("techniques").alias("t")).groupBy("tactic", F.upper("t").alias("t")).agg(F.max("on").alias("on"))
    lists = {name: F.array_sort(F.collect_list(F.when(F.col("on") == on, F.col("t")))) for name, on in (("covered", True), ("uncovered", False))}
    named = pairs.groupBy("tactic").agg(*[c.alias(k) for k, c in lists.items()])
    out = counts.join(named, "tactic", "left")
    return out.withColumns({k: F.coalesce(k, F.array().cast("array<string>")) for k in lists})


def compliance(controls: DataFrame, rules: DataFrame, alerts: DataFrame) -> DataFrame:
    """Controls (framework, control, technique): whether a rule covers any of a control's techniques, and its alerts."""
    covered = rules.select(F.explode("techniques").alias("technique")).distinct().withColumn("covered", F.lit(1))
    fired = technique_counts(alerts)
    rows = controls.join(covered, "technique", "left").join(fired, "technique", "left")
    return rows.groupBy("framework", "control").agg(
        F.count_distinct("technique").alias("techniques"),
        F.count_distinct(F.when(F.col("covered") == 1, F.col("technique"))).alias("covered"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("alerts"),
    )


def navigator_layer(coverage_: DataFrame, name: str = "coverage", domain: str = "enterprise-attack") -> DataFrame:
    """One row: the layer's JSON, techniques of one domain scored by their rules: those of industrial systems begin with
    T0. Techniques are a closed vocabulary of under 1,000."""
    industrial = F.col("technique").rlike("(?i)^T0")
    coverage_ = coverage_.where(industrial if domain == "ics-attack" else ~industrial)
    each = F.array_sort(F.collect_list(F.struct(F.col("technique").alias("techniqueID"), F.col("rules").alias("score"))))
    return coverage_.agg(F.to_json(F.struct(F.lit(name).alias("name"), F.lit(domain).alias("domain"), each.alias("techniques"))).alias("layer"))


def playbook_matches(alerts: DataFrame, playbook: dict) -> DataFrame:
    """Alerts that a playbook's trigger accepts: rule ids, a least severity, techniques."""
    cond = F.lit(True)
    if playbook.get("rule_ids"):
        cond = cond & F.col("rule_id").isin(*playbook["rule_ids"])
    if playbook.get("min_level"):
        cond = cond & (severity.rank(F.col("level")) >= severity.ORDER.index(playbook["min_level"]))
    if playbook.get("techniques"):
        cond = cond & F.arrays_overlap("techniques", F.array(*[F.lit(t) for t in playbook["techniques"]]))
    return alerts.where(cond)


def due_reverts(actions: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Executed actions whose time to be undone has come, with the inverse action."""
    inverse = {"block_ip": "unblock_ip", "disable_user": "enable_user", "isolate_host": "release_host", "add_ioc": "remove_ioc"}
    pairs = [F.lit(x) for kv in inverse.items() for x in kv]
    due = (F.col("status") == "executed") & (F.col("revert_at") <= F.lit(as_of))
    out = actions.where(due).withColumn("revert_action", F.try_element_at(F.create_map(*pairs), F.col("action")))
    return out.where(F.col("revert_action").isNotNull()).orderBy("revert_at")


def drop_expired(spark: SparkSession, store: str, as_of: dt.date, years: int, floor_years: int = 3) -> list[str]:
    """Deletes the months of a store before the cutoff, as whole partitions, and tells which."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    first, gone = retention_cutoff(as_of, years, floor_years), []
    for f in fs.listStatus(path):
        name = f.getPath().getName()
        month = name.removeprefix("event_month=")
        if f.isDirectory() and re.fullmatch(r"event_month=\d{4}-\d{2}", name) and month < first:
            fs.delete(f.getPath(), True)
            gone.append(month)
    return sorted(gone)


def retention_cutoff(as_of: dt.date, years: int, floor_years: int = 3) -> str:
    """The first month that is kept: whole calendar years back, never fewer than the floor."""
    return f"{as_of.year - max(years, floor_years):04d}-{as_of.month:02d}"
