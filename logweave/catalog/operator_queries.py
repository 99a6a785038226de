"""Catalogue of the operators beside the pipe language, over the adapter's events and the other tables."""

from __future__ import annotations

import base64
import datetime as dt
from functools import cache

from pyspark.sql import functions as F

from logweave.catalog.adapter import AS_OF, SQL, events, flat, table
from logweave.catalog.pipe_queries import registry
from logweave.functions import ip
from logweave import scratch
from logweave.operators import analytics, casework, correlate, enrich, ingest, killchain, severity, sigma
from logweave.operators.tables import Table
from logweave.sources import json_formats, line_formats, ranges

ID = "SELECT id FROM ev WHERE "


def _rule(name: str, detection: dict, **kw) -> sigma.Rule:
    return sigma.Rule.parse({"id": name, "title": name, "detection": detection} | kw)


#: Rules of the catalogue and the condition that each stands for.
RULES: dict[str, tuple[dict, str, dict]] = {
    "q_rule_contains": ({"sel": {"message|contains": ["ERROR", "sign"], "HostName|endswith": "1"}, "condition": "sel"}, "(message LIKE '%error%' OR message LIKE '%sign%') AND host_name LIKE '%1'", {}),
    "q_rule_glob": ({"sel": {"user": "U1?", "rule_name": "rule_*"}, "condition": "sel"}, "lower(user_name) LIKE 'u1_' AND lower(rule_name) LIKE 'rule\\_%' ESCAPE '\\'", {}),
    "q_rule_regex": ({"sel": {"message|re": "^(CLICK|view) by u[0-9]{2}$"}, "condition": "sel"}, "regexp_matches(message, '^(click|view) by u[0-9]{2}$')", {}),
    "q_rule_numeric": ({"sel": {"bytes_total|gte": 5000, "SourcePort|lt": 2000}, "condition": "sel"}, "bytes_total >= 5000 AND src_port < 2000", {}),
    "q_rule_all_of": ({"sel_a": {"action": "deny"}, "sel_b": {"dst_port": [443, 502]}, "f": {"severity": "low"}, "condition": "all of sel_* and not f"}, "action = 'deny' AND dst_port IN (443, 502) AND severity <> 'low'", {}),
    "q_rule_n_of": ({"a": {"action": "deny"}, "b": {"dst_port": 502}, "c": {"severity": "high"}, "condition": "2 of them"}, "(action = 'deny')::INT + (dst_port = 502)::INT + (severity = 'high')::INT >= 2", {}),
    "q_rule_not": ({"sel": {"rule_name": None}, "x": {"app|exists": True}, "condition": "not (sel or x)"}, "rule_name IS NOT NULL AND app IS NULL", {}),
    "q_rule_keywords": ({"kw": ["purchase", "H16"], "condition": "kw"}, "log_type = 'purchase' OR host_name = 'h16'", {}),
    "q_rule_raw_key": ({"sel": {"k|lte": 3}, "condition": "sel"}, "CAST(json_extract_string(raw, '$.k') AS DOUBLE) <= 3", {}),
    "q_rule_base64": ({"sel": {"message|base64offset|contains": "by u1"}, "k": {"app|windash|contains": "svc-2"}, "condition": "sel or k"}, "app = 'svc-2'", {}),
    "q_rule_cidr": ({"sel": {"src_ip|cidr": ["10.1.0.0/16", "10.2.3.0/24"]}, "condition": "sel"}, "src_ip LIKE '10.1.%' OR src_ip LIKE '10.2.3.%'", {}),
    "q_rule_fieldref": ({"sel": {"vendor|fieldref": "product"}, "b": {"src_port|fieldref": "bytes_total"}, "c": {"dst_port|fieldref": "dst_port", "host_name": "h3"}, "condition": "sel or b or c"}, "src_port = bytes_total OR host_name = 'h3'", {}),
    "q_rule_cased": ({"a": {"action|cased": "DENY"}, "b": {"action|cased": "deny"}, "condition": "a or b"}, "action = 'deny'", {}),
    "q_rule_logsource": ({"sel": {"severity": "HIGH"}, "condition": "sel"}, "severity = 'high' AND vendor = 'cisco' AND log_type = 'http'", {"logsource": {"vendor": "cisco", "service": "http"}}),
    "q_rule_datamodel": ({"sel": {"severity": "high"}, "condition": "sel"}, "severity = 'high' AND log_type = 'modbus'", {"datamodels": "industrial"}),
}


@cache
def _tags() -> dict[str, str]:
    return {k: m.tag for m in registry().models for k in (m.name.lower(), m.tag.lower())}


def _rules(names) -> list[sigma.Rule]:
    return [_rule(n, RULES[n][0], **RULES[n][2]) for n in names]


def _rule_query(name: str):
    def query(spark, sf_dir):
        rows = events(spark, sf_dir)
        rows = registry().tag(rows) if RULES[name][2].get("datamodels") else rows
        compiled = sigma.compile_rules(_rules([name]), rows.columns, _tags(), spark)
        assert not compiled.disabled, compiled.disabled
        return sigma.matches(rows, compiled).where(F.size("rule_ids") > 0).select("id")

    return query


def _base64(spark, sf_dir):
    """Messages of every second event are encoded; a part of a text and a whole one are looked for in them."""
    rows = events(spark, sf_dir).withColumn("message", F.when(F.col("id") % 2 == 0, F.base64(F.encode("message", "UTF-8"))).otherwise(F.col("message")))
    rule = _rule("b", {"part": {"message|base64offset|contains": "by u1"}, "whole": {"message|base64": "view by u7"}, "condition": "part or whole"})
    return sigma.matches(rows, sigma.compile_rules([rule], rows.columns, _tags())).where(F.size("rule_ids") > 0).select("id")


def _navigator(spark, sf_dir):
    return analytics.navigator_layer(analytics.coverage(_part_rules(spark, sf_dir)).where("technique <> 't1048'"))


LEVELS = {"q_rule_contains": ("high", ["attack.t1110", "attack.credential_access"]), "q_rule_cidr": ("medium", ["attack.t1021.001", "attack.lateral_movement"]), "q_rule_all_of": ("critical", ["attack.t1110", "attack.initial_access"]), "q_rule_numeric": ("low", ["attack.exfiltration"])}


def _alerts(spark, sf_dir):
    """Alerts of four rules with technique and tactic tags; the alert id is event and rule."""
    rows = events(spark, sf_dir)
    rules = [_rule(n, RULES[n][0], level=level, tags=tags) for n, (level, tags) in LEVELS.items()]
    found = sigma.alerts(rows, sigma.compile_rules(rules, rows.columns, _tags()))
    order = F.array_position(F.array(*[F.lit(n) for n in LEVELS]), F.col("rule_id"))
    return found.withColumns({"alert_id": F.col("event_id") * 10 + order, "status": F.lit("new")})


_ALERTS = (
    "al AS (SELECT *, id * 10 + no AS alert_id FROM (SELECT ev.*, 'q_rule_contains' AS rule_id, 1 AS no, 'high' AS level, ['T1110'] AS techniques, ['credential access'] AS tactics FROM ev WHERE "
    + RULES["q_rule_contains"][1]
    + " UNION ALL SELECT ev.*, 'q_rule_cidr', 2, 'medium', ['T1021.001'], ['lateral movement'] FROM ev WHERE "
    + RULES["q_rule_cidr"][1]
    + " UNION ALL SELECT ev.*, 'q_rule_all_of', 3, 'critical', ['T1110'], ['initial access'] FROM ev WHERE "
    + RULES["q_rule_all_of"][1]
    + " UNION ALL SELECT ev.*, 'q_rule_numeric', 4, 'low', CAST([] AS VARCHAR[]), ['exfiltration'] FROM ev WHERE "
    + RULES["q_rule_numeric"][1]
    + "))"
)


def _all_matches(spark, sf_dir):
    rows = events(spark, sf_dir)
    names = [n for n in RULES if n != "q_rule_datamodel"]
    compiled = sigma.compile_rules(_rules(names), rows.columns, _tags())
    return sigma.matched(rows, compiled).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


# -- correlations ------------------------------------------------------------------------------------------------------

CORRELATIONS = {
    "q_corr_threshold": correlate.Correlation("c1", "Many failures", 7 * 86400, 4, ("user_name",), {"action": "FAILED-logon"}),
    "q_corr_distinct": correlate.Correlation("c2", "Many users on a host", 10 * 86400, 9, ("host_name",), {"action": ["deny", "allow"]}, "user_name"),
    "q_corr_distinct_nulls": correlate.Correlation("c5", "Many applications of a user", 12 * 86400, 2, ("user_name",), {"action": "deny"}, "app"),
    "q_corr_multi_key": correlate.Correlation("c3", "Noisy pair", 86400 * 30, 45, ("host_name", "dst_port"), {}),
}
_CORR_SQL = {
    "q_corr_threshold": "SELECT user_name, count(*) AS n, min(event_time) AS first_seen, max(event_time) AS last_seen FROM ev WHERE event_time BETWEEN TIMESTAMP '2024-01-24' AND TIMESTAMP '2024-01-31' AND action = 'failed-logon' GROUP BY 1 HAVING count(*) >= 4",
    "q_corr_distinct": "SELECT host_name, count(DISTINCT user_name) AS n, min(event_time) AS first_seen, max(event_time) AS last_seen FROM ev WHERE event_time BETWEEN TIMESTAMP '2024-01-21' AND TIMESTAMP '2024-01-31' AND action IN ('deny', 'allow') GROUP BY 1 HAVING count(DISTINCT user_name) >= 9",
    "q_corr_distinct_nulls": "SELECT user_name, count(DISTINCT app) AS n, min(event_time) AS first_seen, max(event_time) AS last_seen FROM ev WHERE event_time BETWEEN TIMESTAMP '2024-01-19' AND TIMESTAMP '2024-01-31' AND action = 'deny' AND app IS NOT NULL GROUP BY 1 HAVING count(DISTINCT app) >= 2",
    "q_corr_multi_key": "SELECT host_name, dst_port, count(*) AS n, min(event_time) AS first_seen, max(event_time) AS last_seen FROM ev WHERE event_time BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-31' GROUP BY 1, 2 HAVING count(*) >= 45",
}


def _corr(name: str):
    return lambda spark, sf_dir: correlate.correlate(events(spark, sf_dir), CORRELATIONS[name], AS_OF)


def _corr_alerts(spark, sf_dir):
    rule = CORRELATIONS["q_corr_threshold"]
    found = correlate.correlate(events(spark, sf_dir), rule, AS_OF)
    return correlate.alerts(found, rule, AS_OF).select("rule_id", "user_name", "message", "dedup_hash")


def _corr_buckets(spark, sf_dir):
    rule = correlate.Correlation("c4", "Failures in six hours", 21600, 12, ("severity",), {"action": "failed-logon"})
    return correlate.buckets(events(spark, sf_dir), rule)


# -- analytics ---------------------------------------------------------------------------------------------------------


def _form(spark, sf_dir):
    found = analytics.form_search(events(spark, sf_dir), equal={"severity": "medium"}, address="10.1.0.0/16", contains={"message": "CLICK"}, words='click -h3')
    return found.select("id", "src_ip")


def _page(spark, sf_dir):
    return analytics.page(events(spark, sf_dir).where("action = 'deny'"), 20, 40).select("id", "event_time")


def _known(spark, sf_dir):
    return analytics.entities(events(spark, sf_dir))


def _new_associations(spark, sf_dir):
    rows = events(spark, sf_dir)
    found = analytics.new_associations(analytics.entities(rows), analytics.entity_links(rows), AS_OF, hours=24 * 20)
    return found.select("entity_type", "entity_value", "peer_type", "peer_value", "n")


def _mixed_alerts(spark, sf_dir):
    """Alerts of which every ninth is suppressed, every seventh closed, and every fifth in a case."""
    found = _alerts(spark, sf_dir)
    status = F.when(F.col("event_id") % 9 == 0, "suppressed").when(F.col("event_id") % 7 == 0, "closed").otherwise("new")
    return found.withColumns({"status": status, "case_id": F.when(F.col("event_id") % 5 == 0, F.lit("c"))})


def _risk(spark, sf_dir):
    return analytics.risk(_mixed_alerts(spark, sf_dir), AS_OF).withColumn("score", F.round("score", 4))


def _rule_stats(spark, sf_dir):
    found = _alerts(spark, sf_dir)
    rules = spark.createDataFrame([(n,) for n in [*LEVELS, "never"]], "rule_id string")
    return analytics.rule_stats(rules, found, found.where("severity = 'low'"))


def _related(spark, sf_dir):
    found = _mixed_alerts(spark, sf_dir)
    seen = found.where("rule_id = 'q_rule_all_of'").select("user_name", F.lit(None).cast("string").alias("host_name"), "src_ip").where("user_name in ('u3', 'u4')")
    return analytics.related_open_alerts(found, seen).select("alert_id", "user_name")


def _cases(spark, sf_dir):
    found = _alerts(spark, sf_dir).withColumn("case_id", F.when(F.col("user_name").isin("u1", "u2", "u3"), F.col("user_name")))
    cases = spark.createDataFrame([("u1", "low"), ("u2", "critical"), ("u99", "medium")], "case_id string, severity string")
    return analytics.case_rollup(cases, found)


def _related_to(spark, sf_dir):
    found = _alerts(spark, sf_dir)
    found = found.withColumn("status", F.when(F.col("event_id") % 9 == 0, "suppressed").otherwise("new"))
    one = found.where("rule_id = 'q_rule_all_of'").agg(F.min("alert_id")).first()[0]
    return analytics.related_to_alert(found, one, limit=20).select("alert_id", "event_time")


def _uncased(spark, sf_dir):
    found = _alerts(spark, sf_dir).withColumn("case_id", F.when(F.col("user_name").isin("u1", "u2"), F.lit("c")))
    found = found.withColumn("status", F.when(F.col("event_id") % 9 == 0, "closed").otherwise("new"))
    return analytics.recent_uncased(found, AS_OF, hours=72, limit=5000).select("alert_id", "event_time")


def _recent(spark, sf_dir):
    found = _alerts(spark, sf_dir).withColumn("status", F.when(F.col("event_id") % 9 == 0, "suppressed").otherwise("new"))
    return analytics.recent_alerts(found, level="HIGH").select("alert_id", "level")


def _new_alerts(spark, sf_dir):
    found = _alerts(spark, sf_dir)
    return sigma.new_alerts(found, found.where("event_id % 3 = 0")).select("alert_id")


def _top_risk(spark, sf_dir):
    scored = analytics.top_risk(_mixed_alerts(spark, sf_dir), _known(spark, sf_dir), AS_OF, limit=15)
    return scored.select("entity_type", "entity_value", F.round("score", 4).alias("score"), "alerts", "event_count")


def _registry(spark, sf_dir):
    """Nations as assets, and their customers as aliases."""
    rank = F.expr("CASE n_regionkey WHEN 0 THEN 'critical' WHEN 1 THEN 'low' WHEN 2 THEN 'high' WHEN 3 THEN 'odd' END")
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("asset_id"), "n_nationkey", rank.alias("criticality"))
    names = table(spark, sf_dir, "customer").where("c_nationkey % 4 <> 0").join(enrich.bounded(rows), F.col("c_nationkey") == F.col("n_nationkey"))
    kind = F.when(F.col("c_custkey") % 2 == 0, "hostname").otherwise("fqdn")
    names = names.select("asset_id", kind.alias("alias_type"), F.col("c_name").alias("alias_value"))
    return flat(analytics.registry_page(rows, names, "asset_id", "criticality", find="A", limit=12, offset=2).drop("n_nationkey"))


def _identities(spark, sf_dir):
    names = spark.createDataFrame([("corp\\u3", "id-q"), ("u4", "id-4"), ("u5@x.org", "id-5"), ("u3", "id-3")], "alias string, identity_id string")
    user = F.expr("CASE id % 3 WHEN 0 THEN concat('CORP', chr(92), upper(user_name)) WHEN 1 THEN concat(user_name, '@x.org') ELSE user_name END")
    rows = events(spark, sf_dir).withColumn("user_name", user).select("id", "user_name")
    return enrich.identities(rows, names).select("id", "identity_id")


def _labels(spark, sf_dir):
    own = F.when(F.col("id") % 2 == 0, F.array(F.lit("PCI"), F.concat(F.lit("Zone-"), F.col("dst_port").cast("string"))))
    user = F.when(F.col("id") % 3 == 0, F.array(F.lit("Admin"), F.lit("admin")))
    return flat(events(spark, sf_dir).select("id", enrich.context_tags({"dest": own, "user": user}).alias("tags")))


REVERTS = ["block_ip", "disable_user", "isolate_host", "add_ioc", "notify"]


def _reverts(spark, sf_dir):
    action = F.element_at(F.array(*[F.lit(a) for a in REVERTS]), (F.col("id") % 5 + 1).cast("int"))
    status = F.when(F.col("id") % 2 == 0, "executed").otherwise("failed")
    rows = events(spark, sf_dir).select("id", action.alias("action"), status.alias("status"), F.col("event_time").alias("revert_at"))
    return analytics.due_reverts(rows, dt.datetime(2024, 1, 10)).select("id", "revert_action")


def _retention(spark, sf_dir):
    """Orders as rows of a month-partitioned store, and what the floor of three years keeps of them."""
    month = F.date_format("o_orderdate", "yyyy-MM")
    kept = table(spark, sf_dir, "orders").withColumn("event_month", month).where(F.col("event_month") >= analytics.retention_cutoff(dt.date(1998, 8, 1), 1))
    return kept.groupBy("event_month").agg(F.count(F.lit(1)).alias("n"))


def _diagnosis(spark, sf_dir):
    rule = _rule("d", {"a": {"action": "deny"}, "b": {"dst_port": [443, 502]}, "condition": "a and not b"}, logsource={"product": "asa"})
    out = sigma.diagnose(events(spark, sf_dir), rule)
    return out.select("id", "matched", "logsource_ok", "datamodel_ok", F.col("selections")["a"].alias("a"), F.col("selections")["b"].alias("b"))


def _dry_run(spark, sf_dir):
    rule = _rule("d", {"a": {"action": "deny"}, "condition": "a"})
    return sigma.dry_run(events(spark, sf_dir), rule, limit=300).select("id", "matched")


#: Parts as rules: what each is, as SQL that both engines read alike.
_PART_RULES = """SELECT CAST(p_partkey AS {text}) AS rule_id, CASE p_partkey % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'low' ELSE 'high' END AS level, p_size % 4 <> 0 AS enabled,
    CASE p_partkey % 4 WHEN 0 THEN {array}('T1110', 't1048') WHEN 1 THEN {array}('T1021.001') WHEN 2 THEN {array}('T1110') ELSE {none} END AS techniques,
    CASE p_size % 7 WHEN 0 THEN {array}('initial access', 'exfiltration') WHEN 1 THEN {none} WHEN 2 THEN {array}('lateral movement') ELSE {array}('credential access') END AS tactics
    FROM part WHERE p_size % 7 <> 2 OR p_partkey % 4 = 1"""
_PART_SQL = _PART_RULES.format(text="VARCHAR", array="list_value", none="CAST([] AS VARCHAR[])")


def _part_rules(spark, sf_dir):
    shaped = _PART_RULES.format(text="STRING", array="array", none="CAST(array() AS ARRAY<STRING>)").replace("FROM part", "FROM {part}")
    return spark.sql(shaped, part=table(spark, sf_dir, "part"))


def _coverage_map(spark, sf_dir):
    return flat(analytics.coverage_map(_part_rules(spark, sf_dir)))


SUPPRESSIONS = [{"id": 1, "rule_id": "Q_RULE_CIDR", "src_ip": "10.1.0.0/17"}, {"id": 2, "user_name": "u5"}, {"id": 3}, {"id": 4, "host_name": "h5", "enabled": False}]


def _suppress(spark, sf_dir):
    found = analytics.suppress(_alerts(spark, sf_dir), SUPPRESSIONS)
    return found.groupBy("status", "suppression_id").agg(F.count(F.lit(1)).alias("n"))


def _ot(spark, sf_dir):
    operation = F.when(F.col("id") % 6 == 0, "write").when(F.col("id") % 10 == 0, "control").otherwise("read")
    return analytics.ot_events(events(spark, sf_dir), operation)


def _ot_conversations(spark, sf_dir):
    rows = _ot(spark, sf_dir)
    out = analytics.ot_conversations(rows, AS_OF, new_hours=24 * 10)
    return flat(out.select("src_ip", "dst_ip", "events", "writes", "controls", "class", "protocols"))


def _chains(spark, sf_dir):
    linked = ["alert_id", "event_time", *analytics.ENTITY_COLUMNS.values()]
    return killchain.chains(_alerts(spark, sf_dir).select(*linked), gap_s=600).select("alert_id", "chain_id")


def _stories(spark, sf_dir):
    told = ["alert_id", "event_time", "level", "tactics", "techniques", *analytics.ENTITY_COLUMNS.values()]
    found = killchain.chains(_alerts(spark, sf_dir).select(*told), gap_s=600)
    out = killchain.stories(found)
    return flat(out.select("chain_id", "alert_count", "severity", "stages", "tactic_count", "signature"))


def _rules_frame(spark):
    rules = [sigma.Rule.parse({"id": n, "title": n, "detection": RULES[n][0], "level": level, "tags": tags}) for n, (level, tags) in LEVELS.items()]
    return spark.createDataFrame([(r.id, r.level, list(r.techniques), list(r.tactics)) for r in rules], "rule_id string, level string, techniques array<string>, tactics array<string>")


CONTROLS = [("F1", "AC-7", "T1110"), ("F1", "AC-17", "T1021.001"), ("F1", "AC-17", "T1105"), ("F2", "6.2", "T1110"), ("F2", "6.2", "T1021.001"), ("F2", "9.9", "T9999")]


def _compliance(spark, sf_dir):
    controls = spark.createDataFrame(CONTROLS, "framework string, control string, technique string")
    return analytics.compliance(controls, _rules_frame(spark), _alerts(spark, sf_dir))


DAYS = (dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 9), dt.datetime(2024, 1, 20), dt.datetime(2024, 3, 1))


def _baseline_upserts(spark, sf_dir):
    """Entity baselines as a table that takes the events of one period after another."""
    rows = events(spark, sf_dir)
    known = Table(spark, scratch.folder(spark, "baselines"), ["entity_type", "entity_value"], analytics.entities(rows).schema, buckets=8)
    for since, until in zip(DAYS, DAYS[1:]):
        casework.update_baselines(known, rows.where((F.col("event_time") >= F.lit(since)) & (F.col("event_time") < F.lit(until))))
    return known.read()


def _alert_writes(spark, sf_dir):
    """Alerts stored twice, of which some are closed in between: what analysts did stays."""
    found = _alerts(spark, sf_dir).select("alert_id", "rule_id", "level", "status", F.lit(None).cast("string").alias("assignee"))
    table = Table(spark, scratch.folder(spark, "alerts"), ["alert_id"], found.schema, buckets=8)
    casework.store_alerts(table, found.where("alert_id % 2 = 0"))
    table.change(F.col("level") == "high", {"status": F.lit("closed"), "assignee": F.lit("ann")})
    casework.store_alerts(table, found)
    table.delete((F.col("rule_id") == "q_rule_numeric") & (F.col("alert_id") % 3 == 0))
    return table.read()


# -- enrichment --------------------------------------------------------------------------------------------------------

NETS = [("10.0.0.0/8", "corp"), ("10.1.0.0/16", "site-1"), ("10.1.4.0/24", "lab"), ("10.2.0.0/15", "site-2"), ("10.3.2.128/25", "dmz"), ("2001:db8::/32", "six")]
RANGES = [(0xC6330000, 0xC633FFFF, "AA"), (0xC6330100, 0xC63301FF, "BB"), (0xC6330180, 0xC63302FF, "CC")]


def _scope(spark, sf_dir):
    rows = events(spark, sf_dir)
    return rows.select("id", ip.scope(F.col("src_ip")).alias("src_scope"), ip.scope(F.col("dst_ip")).alias("dst_scope"), ip.scope(F.concat(F.lit("172."), F.col("id") % 64, F.lit(".0.1"))).alias("odd_scope"))


def _prefix(spark, sf_dir):
    return enrich.longest_prefix(events(spark, sf_dir).select("id", "src_ip"), "src_ip", enrich.networks(spark, NETS), "zone")


def _geo(spark, sf_dir):
    segments = enrich.range_table(spark, enrich.flatten_ranges(RANGES))
    return enrich.range_label(events(spark, sf_dir).select("id", "dst_ip"), "dst_ip", segments, "country")


def _located(spark, sf_dir):
    """Nations, then regions, then two wide networks as sources of ranges; every seventh address is an IPv6 one."""
    hexed = lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")
    k = F.col("n_nationkey")
    own = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("4c633"), hexed(k), F.lit("00")).alias("low"), F.concat(F.lit("4c633"), hexed(k), F.lit("ff")).alias("high"),
        F.when(k < 3, F.upper(F.substring("n_name", 1, 2))).alias("country"), F.when(k.isin(1, 3), k + 100).alias("asn"),
    )
    r = F.col("r_regionkey")
    more = table(spark, sf_dir, "region").select(
        F.concat(F.lit("4c633"), hexed(r), F.lit("00")).alias("low"), F.concat(F.lit("4c633"), hexed(r), F.lit("7f")).alias("high"), F.concat(F.lit("R"), F.char(r + 65)).alias("country"), (r + 900).alias("asn")
    )
    wide = spark.createDataFrame([("4c6000000", "4c6ffffff", "WW", 7), ("620010db8" + "0" * 24, "620010db8" + "f" * 24, "SX", 6)], "low string, high string, country string, asn long")
    address = F.when(F.col("id") % 7 == 0, F.concat(F.lit("2001:DB8::"), F.col("id") % 3)).otherwise(F.col("dst_ip"))
    rows = events(spark, sf_dir).select("id", address.alias("address"))
    return ranges.located(rows, "address", [ranges.range_networks(x) for x in (own, more, wide)]).select("id", "country", "asn")


def _assets(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select(F.concat(F.lit("h"), "n_nationkey").alias("alias"), F.concat(F.lit("asset-"), "n_nationkey").alias("asset_id")).where("n_nationkey < 6")
    more = spark.createDataFrame([("10.0.1.1", "asset-ip"), ("198.51.0.10", "asset-dst")], "alias string, asset_id string")
    nets = enrich.networks(spark, [("10.3.0.0/16", "asset-net")])
    return enrich.assets(events(spark, sf_dir).select("id", "host_name", "src_ip", "dst_ip"), names.unionByName(more), nets).select("id", "asset_id")


TI = [("198.51.2.7", "ip", "feed-a", "high"), ("198.51.2.0/24", "cidr", "feed-b", "medium"), ("10.1.0.0/16", "cidr", "feed-b", "low"), ("10.1.3.0/24", "cidr", "feed-c", "critical"), ("2001:db8::1", "ip", "feed-a", "high")]


def _ti(spark, sf_dir):
    iocs = spark.createDataFrame(TI, "indicator string, ioc_type string, source string, severity string")
    rows = events(spark, sf_dir)
    # every seventh event has an IPv6 source, written in full
    six = F.when(F.col("id") % 7 == 0, F.concat(F.lit("2001:0DB8:0:0:0:0:0:"), F.col("id") % 3)).otherwise(F.col("src_ip"))
    return enrich.ti_matches(rows.withColumn("src_ip", six), iocs)


def _ioc(spark, sf_dir):
    iocs = spark.createDataFrame([("233.0.0.0/8", "cidr", "high"), ("114.0.0.0/8", "cidr", "low"), ("mail6.example.com", "domain", "medium"), ("example.org", "domain", "low")], "indicator string, ioc_type string, severity string")
    docs = table(spark, sf_dir, "documents")
    found = enrich.ioc_matches(docs, "doc_id", F.col("text"), iocs)
    return found.select("doc_id", "indicator", "ioc_type", "severity")


# -- ingest ------------------------------------------------------------------------------------------------------------


def _action(**doc):
    return ingest.Action.parse({"id": "a"} | doc)


def _mask_hash(spark, sf_dir):
    a = _action(action="mask", when={"severity": "high"}, mask={"fields": ["user_name"], "method": "hash", "salt": "s"})
    return ingest.apply_actions(events(spark, sf_dir), [a]).select("id", "user_name", "message", "raw")


def _mask_regex(spark, sf_dir):
    a = _action(action="mask", when={"action": ["allow"]}, mask={"patterns": ["u[0-9]+"], "raw": ["k"], "fields": ["src_ip"]})
    return ingest.apply_actions(events(spark, sf_dir), [a]).select("id", "user_name", "message", "raw", "src_ip")


def _sample(spark, sf_dir):
    a = _action(action="sample", when={"log_type": "click"}, sample={"percent": 25, "key": ["user_name", "dst_port"]})
    return ingest.apply_actions(events(spark, sf_dir), [a]).select("id")


def _route(spark, sf_dir):
    a = [_action(action="route", when={"dst_port": "22"}, route={"vendor": "ssh", "product": "gw"}, order=2), _action(id="b", action="drop", when={"vendor": {"contains": "cis"}, "severity": "high"}, order=1)]
    return flat(ingest.apply_actions(events(spark, sf_dir), a).select("id", "vendor", "product", "applied"))


def _dedup(spark, sf_dir):
    rows = events(spark, sf_dir)
    twice = rows.unionByName(rows.where("id % 3 = 0"))
    out = ingest.dedup(twice, ingest.dedup(rows.where("id % 10 = 0")))
    return out.select("id")


def _mapper(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("rule_name", F.when(F.col("id") % 2 == 0, F.col("rule_name")))
    mappers = [
        ingest.Mapper("message", "CLICK", {"k": "rule_name"}, vendor="mapped"),
        ingest.Mapper("message", "by u", {"k": "rule_name", "missing": "app"}, product="second"),
    ]
    return ingest.map_fields(rows, mappers).select("id", "vendor", "product", "rule_name", "app")


# -- parsers over text built in both engines -----------------------------------------------------------------------------


def _text(expression: str):
    return lambda spark, sf_dir: events(spark, sf_dir).select("id", F.expr(expression).alias("value"))


WEBLOG = "concat(src_ip, ' - ', user_name, ' [', date_format(event_time, 'dd/MMM/yyyy:HH:mm:ss'), ' +0000] \"GET /', log_type, '/', id, ' HTTP/1.1\" ', CASE WHEN id % 7 = 0 THEN '404' WHEN id % 11 = 0 THEN '503' ELSE '200' END, ' ', bytes_total, ' \"-\" \"agent/', id % 3, '\"')"
KV = "concat('date=2024-01-02 time=03:04:05 devname=\"fw', id % 3, '\" logid=\"1\" type=\"traffic\" subtype=\"forward\" level=\"Notice\" srcip=', src_ip, ' dstip=', dst_ip, ' srcport=', src_port, ' dstport=', dst_port, ' proto=6 action=\"', action, '\" policyid=', id % 5, ' sentbyte=', bytes_total, ' rcvdbyte=10 msg=\"hello there\"')"
SYSLOG = "concat('<', 8 * (id % 24) + id % 8, '>1 2024-01-02T03:04:05Z ', host_name, ' app', id % 4, ' ', id, ' ID47 - text ', id)"
ECS = "concat('{\"@timestamp\":\"2024-01-02T03:04:05Z\",\"source\":{\"ip\":\"', src_ip, '\",\"port\":', src_port, '},\"event\":{\"action\":\"', action, '\"},\"user\":{\"name\":\"', user_name, '\"},\"host\":{\"name\":\"', host_name, '\"},\"network\":{\"bytes\":', bytes_total, ',\"transport\":\"TCP\"}}')"
ASA = "concat('<166>Jan 02 2024 03:04:05 fw', id % 3, ' : %ASA-', id % 8, '-106023: Deny ', protocol, ' src outside:', src_ip, '/', src_port, ' dst inside:', dst_ip, '/', dst_port, ' by access-group')"
CEF = "concat('CEF:0|Acme|Gate\\\\|way|1.0|', id % 9, '|Blocked thing|', id % 11, '|src=', src_ip, ' spt=', src_port, ' dst=', dst_ip, ' act=', action, ' suser=', user_name, ' in=', bytes_total, ' out=5 msg=a b\\\\=c')"


def _parsed(parse, expression: str, *columns: str):
    def query(spark, sf_dir):
        return parse(_text(expression)(spark, sf_dir).select("value")).select(*columns)

    return query


_SEV8 = "list_extract(['emergency', 'alert', 'critical', 'error', 'warning', 'notice', 'informational', 'debug'], CAST(id % 8 + 1 AS INT))"
_FAC = "list_extract(['kern', 'user', 'mail', 'daemon', 'auth', 'syslog', 'lpr', 'news', 'uucp', 'cron', 'authpriv', 'ftp', 'ntp', 'audit', 'console', 'solaris-cron', 'local0', 'local1', 'local2', 'local3', 'local4', 'local5', 'local6', 'local7'], CAST(id % 24 + 1 AS INT))"
PARSED = {
    "q_parse_weblog": (_parsed(line_formats.web_access, WEBLOG, "src_ip", "user_name", "action", "severity", "rule_name", "bytes_total", "message"), "SELECT src_ip, user_name, 'GET' AS action, CASE WHEN id % 7 = 0 THEN 'warning' WHEN id % 11 = 0 THEN 'error' END AS severity, CASE WHEN id % 7 = 0 THEN 'HTTP 404' WHEN id % 11 = 0 THEN 'HTTP 503' ELSE 'HTTP 200' END AS rule_name, bytes_total, concat('GET /', log_type, '/', id, ' HTTP/1.1') AS message FROM ev"),
    "q_parse_kv": (_parsed(line_formats.fortinet_fortigate, KV, "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "action", "host_name", "rule_name", "bytes_total", "severity", "message", "log_type"), "SELECT src_ip, dst_ip, src_port, dst_port, 'tcp' AS protocol, action, concat('fw', id % 3) AS host_name, concat('policy ', id % 5) AS rule_name, bytes_total + 10 AS bytes_total, 'notice' AS severity, 'hello there' AS message, 'forward' AS log_type FROM ev"),
    "q_parse_syslog_pri": (_parsed(line_formats.generic_syslog, SYSLOG, "log_type", "severity", "host_name", "app", "rule_name", "message"), f"SELECT {_FAC} AS log_type, {_SEV8} AS severity, host_name, concat('app', id % 4) AS app, 'ID47' AS rule_name, concat('text ', id) AS message FROM ev"),
    "q_parse_json_ecs": (_parsed(json_formats.generic_json, ECS, "vendor", "src_ip", "src_port", "action", "user_name", "host_name", "bytes_total", "protocol"), "SELECT 'json' AS vendor, src_ip, src_port, action, user_name, host_name, bytes_total, 'tcp' AS protocol FROM ev"),
    "q_parse_asa": (_parsed(line_formats.cisco_asa, ASA, "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "severity", "action", "host_name", "rule_name"), f"SELECT src_ip, dst_ip, src_port, dst_port, protocol, {_SEV8} AS severity, 'deny' AS action, concat('fw', id % 3) AS host_name, concat('%ASA-', id % 8, '-106023') AS rule_name FROM ev"),
    "q_parse_cef": (_parsed(line_formats.cef, CEF, "vendor", "product", "log_type", "severity", "src_ip", "dst_ip", "src_port", "action", "user_name", "bytes_total", "message", "rule_name"), "SELECT 'acme' AS vendor, 'gate|way' AS product, concat('', id % 9) AS log_type, CASE WHEN id % 11 <= 3 THEN 'low' WHEN id % 11 <= 6 THEN 'medium' WHEN id % 11 <= 8 THEN 'high' ELSE 'very-high' END AS severity, src_ip, dst_ip, src_port, action, user_name, bytes_total + 5 AS bytes_total, 'a b=c' AS message, 'Blocked thing' AS rule_name FROM ev"),
}


# -- star schema ---------------------------------------------------------------------------------------------------------


def _lookup(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    nations = enrich.bounded(table(spark, sf_dir, "nation"))
    joined = customers.join(nations, customers.c_nationkey == nations.n_nationkey)
    return joined.groupBy("n_name").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def _monthly(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month"), "l_returnflag").agg(F.round(F.sum("l_extendedprice"), 0).alias("revenue"), F.count(F.lit(1)).alias("n"))
    return rows.orderBy(F.col("n").desc(), "month", "l_returnflag").limit(10)


def queries():
    out = {n: _rule_query(n) for n in RULES} | {n: _corr(n) for n in CORRELATIONS} | {n: q for n, (q, _) in PARSED.items()}
    ev = events
    return out | {
        "q_rules_all_matches": _all_matches,
        "q_rule_base64_encoded": _base64,
        "q_navigator_layer": _navigator,
        "q_corr_alerts": _corr_alerts,
        "q_corr_buckets": _corr_buckets,
        "q_form_search_cidr": _form,
        "q_form_search_page": _page,
        "q_distinct_values": lambda s, d: analytics.distinct_values(ev(s, d), "host_name"),
        "q_totals": lambda s, d: analytics.totals(ev(s, d), AS_OF),
        "q_daily_counts": lambda s, d: analytics.daily_counts(ev(s, d)),
        "q_entity_activity": lambda s, d: analytics.daily_counts(ev(s, d).where("user_name = 'u7'"), "action"),
        "q_source_activity": lambda s, d: analytics.source_activity(ev(s, d)),
        "q_top_sources": lambda s, d: analytics.top_values(ev(s, d), "src_ip", 12),
        "q_silent_sources": lambda s, d: analytics.silent_sources(ev(s, d).where("log_type <> 'error' or event_time < timestamp '2024-01-26'"), AS_OF),
        "q_entities": lambda s, d: _known(s, d),
        "q_baseline_upserts": _baseline_upserts,
        "q_alert_writes": _alert_writes,
        "q_entity_links": lambda s, d: analytics.entity_links(ev(s, d)),
        "q_new_entities": lambda s, d: analytics.new_entities(_known(s, d), dt.datetime(2024, 1, 1, 12), 24).select("entity_type", "entity_value"),
        "q_new_associations": _new_associations,
        "q_risk_score": _risk,
        "q_alert_levels": lambda s, d: analytics.counts_by(_alerts(s, d), "level"),
        "q_alert_techniques_unnest": lambda s, d: analytics.technique_counts(_alerts(s, d)),
        "q_rule_stats_left_joins": _rule_stats,
        "q_related_alerts_semi": _related,
        "q_related_to_alert": _related_to,
        "q_recent_uncased": _uncased,
        "q_recent_alerts": _recent,
        "q_new_alerts": _new_alerts,
        "q_top_risk": _top_risk,
        "q_registry_page": _registry,
        "q_identity_lookup": _identities,
        "q_context_labels": _labels,
        "q_due_reverts": _reverts,
        "q_retention": _retention,
        "q_rule_diagnosis": _diagnosis,
        "q_rule_dry_run": _dry_run,
        "q_coverage_map": _coverage_map,
        "q_case_rollup": _cases,
        "q_suppression": _suppress,
        "q_playbook_match": lambda s, d: analytics.playbook_matches(_alerts(s, d), {"min_level": "high", "techniques": ["T1110"]}).select("alert_id"),
        "q_ot_summary": lambda s, d: analytics.ot_summary(_ot(s, d)),
        "q_ot_assets": lambda s, d: flat(analytics.ot_assets(_ot(s, d))),
        "q_ot_conversations": _ot_conversations,
        "q_killchain_components": _chains,
        "q_killchain_stories": _stories,
        "q_coverage_rollup": lambda s, d: analytics.coverage(_part_rules(s, d)),
        "q_tactic_coverage": lambda s, d: analytics.tactic_coverage(_part_rules(s, d)),
        "q_compliance": _compliance,
        "q_scope_labels": _scope,
        "q_cidr_longest_prefix": _prefix,
        "q_geo_range_join": _geo,
        "q_geo_precedence": _located,
        "q_asset_precedence": _assets,
        "q_ioc_match_documents": _ioc,
        "q_ti_events": lambda s, d: _ti(s, d).drop("observed"),
        "q_ti_alerts": lambda s, d: flat(enrich.ti_alerts(_ti(s, d), ev(s, d))),
        "q_mask_hash": _mask_hash,
        "q_mask_regex": _mask_regex,
        "q_sample_hash": _sample,
        "q_route_drop": _route,
        "q_dedup_hash": _dedup,
        "q_mapper_fill_empty": _mapper,
        "q_severity_rank": lambda s, d: ev(s, d).groupBy("user_name").agg(severity.highest(F.col("severity")).alias("highest")),
        "q_nation_customer_lookup": _lookup,
        "q_lineitem_monthly_top": _monthly,
    }


_OT = "ot AS (SELECT *, CASE WHEN id % 6 = 0 THEN 'write' WHEN id % 10 = 0 THEN 'control' ELSE 'read' END AS operation FROM ev WHERE log_type = 'modbus')"
_ENT = "ent AS (SELECT t AS entity_type, v AS entity_value, min(event_time) AS first_seen, max(event_time) AS last_seen, count(*) AS event_count FROM (SELECT event_time, 'user' AS t, user_name AS v FROM {0} UNION ALL SELECT event_time, 'host', host_name FROM {0} UNION ALL SELECT event_time, 'ip', src_ip FROM {0}) GROUP BY 1, 2)"
_LINK = "lnk AS (SELECT t AS entity_type, v AS entity_value, pt AS peer_type, pv AS peer_value, min(event_time) AS first_seen, max(event_time) AS last_seen, count(*) AS n FROM (SELECT event_time, 'user' AS t, user_name AS v, 'ip' AS pt, src_ip AS pv FROM {0} UNION ALL SELECT event_time, 'user', user_name, 'host', host_name FROM {0} UNION ALL SELECT event_time, 'host', host_name, 'ip', dst_ip FROM {0}) GROUP BY 1, 2, 3, 4)"
_RANK = "list_position(['informational', 'low', 'medium', 'high', 'critical'], {0})"
_IPNUM = "CAST(string_split({0}, '.')[{1}] AS INT)"


def oracle_sql():
    ev = f"ev AS ({SQL})"
    w = f"WITH {ev} "
    wa = f"WITH {ev}, {_ALERTS} "
    out = {n: w + ID + sql for n, (_, sql, _) in RULES.items()} | {n: w + sql for n, sql in _CORR_SQL.items()} | {n: w + sql for n, (_, sql) in PARSED.items()}
    names = [n for n in RULES if n != "q_rule_datamodel"]
    out["q_rules_all_matches"] = w + " UNION ALL ".join(f"SELECT '{n}' AS rule_id, count(*) AS n FROM ev WHERE {RULES[n][1]} HAVING count(*) > 0" for n in names)
    bucket = int(AS_OF.replace(tzinfo=dt.timezone.utc).timestamp()) // (7 * 86400)
    out["q_corr_alerts"] = w + f"SELECT 'c1' AS rule_id, user_name, concat(n, ' events in 604800 s for ', user_name) AS message, sha256(concat('c1|', user_name, '|{bucket}')) AS dedup_hash FROM ({_CORR_SQL['q_corr_threshold']})"
    out["q_corr_buckets"] = w + "SELECT time_bucket(INTERVAL 6 HOUR, event_time, TIMESTAMP '1970-01-01') AS bucket, severity, count(*) AS n FROM ev WHERE action = 'failed-logon' GROUP BY 1, 2 HAVING count(*) >= 12"
    out["q_form_search_cidr"] = w + "SELECT id, src_ip FROM ev WHERE severity = 'medium' AND src_ip LIKE '10.1.%' AND message LIKE '%click%' AND host_name <> 'h3'"
    out["q_form_search_page"] = w + "SELECT id, event_time FROM ev WHERE action = 'deny' ORDER BY event_time DESC, id DESC LIMIT 20 OFFSET 40"
    out["q_distinct_values"] = w + "SELECT DISTINCT host_name FROM ev ORDER BY 1 LIMIT 200"
    out["q_totals"] = w + "SELECT count(*) AS events, count(*) FILTER (WHERE event_time >= TIMESTAMP '2024-01-30') AS last_day, count(DISTINCT vendor) AS vendors, count(DISTINCT src_ip) AS sources, min(event_time) AS first_seen, max(event_time) AS last_seen FROM ev"
    out["q_daily_counts"] = w + "SELECT CAST(event_time AS DATE) AS day, count(*) AS n FROM ev GROUP BY 1"
    out["q_entity_activity"] = w + "SELECT CAST(event_time AS DATE) AS day, action, count(*) AS n FROM ev WHERE user_name = 'u7' GROUP BY 1, 2"
    out["q_source_activity"] = w + "SELECT vendor, log_type, max(event_time) AS last_seen, count(*) AS n FROM ev GROUP BY 1, 2"
    out["q_top_sources"] = w + "SELECT src_ip, count(*) AS n FROM ev GROUP BY 1 ORDER BY n DESC, src_ip LIMIT 12"
    out["q_silent_sources"] = w + "SELECT vendor, log_type, max(event_time) AS last_seen, count(*) AS n FROM ev WHERE (log_type <> 'error' OR event_time < TIMESTAMP '2024-01-26') AND event_time BETWEEN TIMESTAMP '2024-01-24' AND TIMESTAMP '2024-01-31' GROUP BY 1, 2 HAVING count(*) >= 10 AND max(event_time) < TIMESTAMP '2024-01-30'"
    out["q_entities"] = f"WITH {ev}, {_ENT.format('ev')} SELECT * FROM ent"
    out["q_baseline_upserts"] = f"WITH {ev}, {_ENT.format('ev')} SELECT * FROM ent"
    out["q_alert_writes"] = wa + "SELECT alert_id, rule_id, level, CASE WHEN level = 'high' AND alert_id % 2 = 0 THEN 'closed' ELSE 'new' END AS status, CASE WHEN level = 'high' AND alert_id % 2 = 0 THEN 'ann' END AS assignee FROM al WHERE NOT (rule_id = 'q_rule_numeric' AND alert_id % 3 = 0)"
    # the text's digits in an encoded one depend on its place modulo three; digits that other bytes have a part in are left out
    digits = [base64.b64encode(b" " * i + b"by u1").decode().rstrip("=")[-(-8 * i // 6) : 8 * (i + 5) // 6] for i in range(3)]
    coded = "lower(to_base64(encode(message)))"
    part = " OR ".join(f"contains({coded}, '{d.lower()}')" for d in digits)
    out["q_rule_base64_encoded"] = w + f"SELECT id FROM ev WHERE id % 2 = 0 AND ({part} OR message = 'view by u7')"
    out["q_navigator_layer"] = f"WITH r AS ({_PART_SQL}), c AS (SELECT technique, count(DISTINCT rule_id) AS n FROM (SELECT rule_id, unnest(techniques) AS technique FROM r) WHERE technique <> 't1048' GROUP BY 1) SELECT concat('{{\"name\":\"coverage\",\"domain\":\"enterprise-attack\",\"techniques\":[', string_agg(concat('{{\"techniqueID\":\"', technique, '\",\"score\":', n, '}}'), ',' ORDER BY technique), ']}}') AS layer FROM c"
    out["q_entity_links"] = f"WITH {ev}, {_LINK.format('ev')} SELECT * FROM lnk"
    out["q_new_entities"] = f"WITH {ev}, {_ENT.format('ev')} SELECT entity_type, entity_value FROM ent WHERE first_seen >= TIMESTAMP '2023-12-31 12:00:00'"
    out["q_new_associations"] = f"WITH {ev}, {_ENT.format('ev')}, {_LINK.format('ev')} SELECT l.entity_type, l.entity_value, l.peer_type, l.peer_value, l.n FROM lnk l JOIN ent e USING (entity_type, entity_value) WHERE l.first_seen >= TIMESTAMP '2024-01-11' AND e.first_seen < l.first_seen - INTERVAL 1 HOUR"
    out["q_risk_score"] = wa + ", x AS (SELECT (CASE level WHEN 'critical' THEN 10.0 WHEN 'high' THEN 6.0 WHEN 'medium' THEN 3.0 ELSE 1.0 END) * power(0.5, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(event_time)) / 1e6 / (7 * 86400.0)) AS s, unnest([{'t': 'user', 'v': user_name}, {'t': 'host', 'v': host_name}, {'t': 'ip', 'v': src_ip}]) AS e FROM al WHERE id % 9 <> 0 AND event_time >= TIMESTAMP '2024-01-01') SELECT e.t AS entity_type, e.v AS entity_value, round(sum(s), 4) AS score, count(*) AS alerts FROM x GROUP BY 1, 2"
    out["q_top_risk"] = out["q_risk_score"].replace("SELECT e.t AS", ", " + _ENT.format("ev") + ", r AS (SELECT e.t AS", 1) + ") SELECT r.*, event_count FROM r LEFT JOIN ent USING (entity_type, entity_value) ORDER BY score DESC, entity_type, entity_value LIMIT 15"
    out["q_alert_levels"] = wa + "SELECT level, count(*) AS n FROM al GROUP BY 1"
    out["q_alert_techniques_unnest"] = wa + "SELECT technique, count(*) AS n FROM (SELECT unnest(techniques) AS technique FROM al) GROUP BY 1"
    out["q_rule_stats_left_joins"] = wa + "SELECT r.rule_id, coalesce(a.n, 0) AS alerts, a.last_alert, coalesce(s.n, 0) AS suppressed FROM (SELECT unnest(['" + "', '".join([*LEVELS, "never"]) + "']) AS rule_id) r LEFT JOIN (SELECT rule_id, count(*) AS n, max(event_time) AS last_alert FROM al GROUP BY 1) a USING (rule_id) LEFT JOIN (SELECT rule_id, count(*) AS n FROM al WHERE severity = 'low' GROUP BY 1) s USING (rule_id)"
    out["q_related_alerts_semi"] = wa + "SELECT alert_id, user_name FROM al WHERE id % 9 <> 0 AND id % 5 <> 0 AND EXISTS (SELECT 1 FROM al x WHERE x.rule_id = 'q_rule_all_of' AND x.user_name IN ('u3', 'u4') AND (x.user_name = al.user_name OR x.src_ip = al.src_ip))"
    out["q_related_to_alert"] = wa + ", me AS (SELECT * FROM al WHERE alert_id = (SELECT min(alert_id) FROM al WHERE rule_id = 'q_rule_all_of')) SELECT al.alert_id, al.event_time FROM al, me WHERE al.alert_id <> me.alert_id AND al.id % 9 <> 0 AND (al.src_ip = me.src_ip OR al.user_name = me.user_name OR al.host_name = me.host_name) ORDER BY al.event_time DESC, al.alert_id DESC LIMIT 20"
    out["q_recent_uncased"] = wa + "SELECT alert_id, event_time FROM al WHERE user_name NOT IN ('u1', 'u2') AND id % 9 <> 0 AND event_time >= TIMESTAMP '2024-01-28' ORDER BY event_time, alert_id LIMIT 5000"
    out["q_recent_alerts"] = wa + "SELECT alert_id, level FROM al WHERE id % 9 <> 0 AND level = 'high'"
    out["q_new_alerts"] = wa + "SELECT alert_id FROM al WHERE id % 3 <> 0"
    out["q_registry_page"] = "SELECT n.n_name AS asset_id, CASE n_regionkey WHEN 0 THEN 'critical' WHEN 1 THEN 'low' WHEN 2 THEN 'high' WHEN 3 THEN 'odd' END AS criticality, coalesce(string_agg(CASE WHEN c_custkey % 2 = 0 THEN 'hostname:' ELSE 'fqdn:' END || c_name, ',' ORDER BY CASE WHEN c_custkey % 2 = 0 THEN 'hostname:' ELSE 'fqdn:' END || c_name) FILTER (WHERE c_name IS NOT NULL), '') AS aliases FROM nation n LEFT JOIN customer ON c_nationkey = n_nationkey AND c_nationkey % 4 <> 0 WHERE n_name ILIKE '%a%' GROUP BY n_name, n_regionkey ORDER BY CASE n_regionkey WHEN 0 THEN 0 WHEN 2 THEN 1 WHEN 1 THEN 3 ELSE 4 END, n_name LIMIT 12 OFFSET 2"
    out["q_identity_lookup"] = w + "SELECT id, CASE WHEN id % 3 = 0 AND user_name = 'u3' THEN 'id-q' WHEN id % 3 = 0 AND user_name = 'u4' THEN 'id-4' WHEN id % 3 = 1 AND user_name = 'u5' THEN 'id-5' WHEN id % 3 = 2 AND user_name = 'u4' THEN 'id-4' WHEN id % 3 = 2 AND user_name = 'u3' THEN 'id-3' END AS identity_id FROM ev"
    out["q_context_labels"] = w + "SELECT id, nullif(concat_ws(',', CASE WHEN id % 2 = 0 THEN concat('dest:pci,dest:zone-', dst_port) END, CASE WHEN id % 3 = 0 THEN 'user:admin' END), '') AS tags FROM ev"
    out["q_due_reverts"] = w + "SELECT id, list_extract(['unblock_ip', 'enable_user', 'release_host', 'remove_ioc'], CAST(id % 5 + 1 AS INT)) AS revert_action FROM ev WHERE id % 2 = 0 AND id % 5 < 4 AND event_time <= TIMESTAMP '2024-01-10'"
    out["q_retention"] = "SELECT strftime(o_orderdate, '%Y-%m') AS event_month, count(*) AS n FROM orders WHERE strftime(o_orderdate, '%Y-%m') >= '1995-08' GROUP BY 1"
    out["q_rule_diagnosis"] = w + "SELECT id, action = 'deny' AND dst_port NOT IN (443, 502) AND product = 'asa' AS matched, product = 'asa' AS logsource_ok, true AS datamodel_ok, action = 'deny' AS a, dst_port IN (443, 502) AS b FROM ev"
    out["q_rule_dry_run"] = w + "SELECT id, action = 'deny' AS matched FROM ev ORDER BY event_time DESC, id DESC LIMIT 300"
    r = f"WITH r AS ({_PART_SQL}), "
    each = "e AS (SELECT rule_id, enabled, techniques, unnest(CASE WHEN len(tactics) > 0 THEN tactics ELSE ['(untagged)'] END) AS tactic FROM r)"
    out["q_coverage_map"] = r + each + (
        ", c AS (SELECT tactic, count(DISTINCT rule_id) AS rules, count(DISTINCT rule_id) FILTER (enabled) AS enabled_rules FROM e GROUP BY 1)"
        ", p AS (SELECT tactic, upper(t) AS t, bool_or(enabled) AS o FROM (SELECT tactic, enabled, unnest(techniques) AS t FROM e) GROUP BY 1, 2)"
        " SELECT c.*, coalesce((SELECT string_agg(t, ',' ORDER BY t) FROM p WHERE p.tactic = c.tactic AND o), '') AS covered,"
        " coalesce((SELECT string_agg(t, ',' ORDER BY t) FROM p WHERE p.tactic = c.tactic AND NOT o), '') AS uncovered FROM c"
    )
    top = f"greatest({_RANK.format('c.severity')}, coalesce(m.top, 0))"
    out["q_case_rollup"] = wa + f"SELECT c.case_id, list_extract(['informational', 'low', 'medium', 'high', 'critical'], CAST({top} AS INT)) AS severity, coalesce(m.n, 0) AS alert_count FROM (VALUES ('u1', 'low'), ('u2', 'critical'), ('u99', 'medium')) c(case_id, severity) LEFT JOIN (SELECT user_name, count(*) AS n, max({_RANK.format('level')}) AS top FROM al WHERE user_name IN ('u1', 'u2', 'u3') GROUP BY 1) m ON m.user_name = c.case_id"
    third = _IPNUM.format("src_ip", 3)
    out["q_suppression"] = wa + f"SELECT CASE WHEN suppression_id IS NULL THEN 'new' ELSE 'suppressed' END AS status, suppression_id, count(*) AS n FROM (SELECT CASE WHEN rule_id = 'q_rule_cidr' AND src_ip LIKE '10.1.%' AND {third} < 128 THEN '1' WHEN user_name = 'u5' THEN '2' END AS suppression_id FROM al) GROUP BY 1, 2"
    out["q_playbook_match"] = wa + "SELECT alert_id FROM al WHERE level IN ('high', 'critical') AND list_contains(techniques, 'T1110')"
    wo = f"WITH {ev}, {_OT} "
    out["q_ot_summary"] = wo + "SELECT log_type AS protocol, count(*) AS events, count(*) FILTER (WHERE operation = 'read') AS reads, count(*) FILTER (WHERE operation = 'write') AS writes, count(*) FILTER (WHERE operation = 'control') AS controls, count(DISTINCT dst_ip) AS controllers, max(event_time) AS last_seen FROM ot GROUP BY 1"
    out["q_ot_assets"] = wo + "SELECT dst_ip, 'modbus' AS protocols, count(DISTINCT src_ip) AS masters, count(*) AS events, count(*) FILTER (WHERE operation IN ('write', 'control')) AS changes, max(event_time) AS last_seen FROM ot GROUP BY 1"
    out["q_ot_conversations"] = wo + "SELECT src_ip, dst_ip, count(*) AS events, count(*) FILTER (WHERE operation = 'write') AS writes, count(*) FILTER (WHERE operation = 'control') AS controls, CASE WHEN min(event_time) < TIMESTAMP '2024-01-21' THEN 'known' WHEN count(*) FILTER (WHERE operation IN ('write', 'control')) > 0 THEN 'new-writer' ELSE 'new' END AS class, 'modbus' AS protocols FROM ot GROUP BY 1, 2"
    out["q_coverage_rollup"] = r + f"x AS (SELECT rule_id, level, unnest(techniques) AS technique FROM r) SELECT technique, count(DISTINCT rule_id) AS rules, list_extract(['informational', 'low', 'medium', 'high', 'critical'], CAST(max({_RANK.format('level')}) AS INT)) AS highest FROM x GROUP BY 1"
    out["q_tactic_coverage"] = r + "x AS (SELECT rule_id, len(techniques) AS n, unnest(tactics) AS tactic FROM r) SELECT tactic, count(DISTINCT rule_id) AS rules, CAST(sum(n) AS BIGINT) AS techniques FROM x GROUP BY 1"
    rows = ", ".join(str(c) for c in CONTROLS)
    out["q_compliance"] = wa + f", k AS (SELECT * FROM (VALUES {rows}) t(framework, control, technique)), f AS (SELECT technique, count(*) AS n FROM (SELECT unnest(techniques) AS technique FROM al) GROUP BY 1) SELECT framework, control, count(DISTINCT technique) AS techniques, count(DISTINCT CASE WHEN technique IN ('T1110', 'T1021.001') THEN technique END) AS covered, coalesce(sum(n), 0)::BIGINT AS alerts FROM k LEFT JOIN f USING (technique) GROUP BY 1, 2"
    out["q_scope_labels"] = w + f"SELECT id, 'private' AS src_scope, CASE WHEN {_IPNUM.format('dst_ip', 3)} = 100 THEN 'documentation' ELSE 'public' END AS dst_scope, CASE WHEN id % 64 BETWEEN 16 AND 31 THEN 'private' ELSE 'public' END AS odd_scope FROM ev"
    a, b, c = (_IPNUM.format("src_ip", i) for i in (2, 3, 4))
    out["q_cidr_longest_prefix"] = w + f"SELECT id, src_ip, CASE WHEN {a} = 1 AND {b} = 4 THEN 'lab' WHEN {a} = 1 THEN 'site-1' WHEN {a} = 3 AND {b} = 2 AND {c} >= 128 THEN 'dmz' WHEN {a} IN (2, 3) THEN 'site-2' ELSE 'corp' END AS zone FROM ev"
    b, c = (_IPNUM.format("dst_ip", i) for i in (3, 4))
    out["q_geo_range_join"] = w + f"SELECT id, dst_ip, CASE WHEN {b} = 1 THEN 'BB' WHEN {b} = 2 THEN 'CC' ELSE 'AA' END AS country FROM ev"
    out["q_geo_precedence"] = w + "SELECT id, CASE WHEN id % 7 = 0 THEN 'SX' WHEN id % 5 < 3 THEN upper(substr(n_name, 1, 2)) WHEN id % 250 < 128 THEN 'R' || chr(CAST(65 + id % 5 AS INT)) ELSE 'WW' END AS country, CAST(CASE WHEN id % 7 = 0 THEN 6 WHEN id % 5 IN (1, 3) THEN id % 5 + 100 WHEN id % 250 < 128 THEN 900 + id % 5 ELSE 7 END AS BIGINT) AS asn FROM ev JOIN nation ON n_nationkey = id % 5"
    out["q_asset_precedence"] = w + "SELECT id, CASE WHEN host_name IN ('h0', 'h1', 'h2', 'h3', 'h4', 'h5') THEN 'asset-' || substr(host_name, 2) WHEN src_ip = '10.0.1.1' THEN 'asset-ip' WHEN dst_ip = '198.51.0.10' THEN 'asset-dst' WHEN src_ip LIKE '10.3.%' THEN 'asset-net' END AS asset_id FROM ev"
    dot = "regexp_extract_all(text, '\\b(?:[0-9]{1,3}\\.){3}[0-9]{1,3}\\b')"
    domain = "list_contains(regexp_extract_all(lower(text), '\\b(?:[a-z0-9](?:[a-z0-9-]{{0,61}}[a-z0-9])?\\.)+[a-z]{{2,}}\\b'), '{0}')"
    src, third = "CASE WHEN id % 7 = 0 THEN NULL ELSE src_ip END", f"{_IPNUM.format('dst_ip', 3)} = 2"
    ti = w.rstrip() + (
        ", x AS (SELECT id, indicator, ioc_type, source, severity FROM ("
        f"SELECT id, '198.51.2.7' AS indicator, 'ip' AS ioc_type, 'feed-a' AS source, 'high' AS severity FROM ev WHERE dst_ip = '198.51.2.7' "
        f"UNION SELECT id, '198.51.2.0/24', 'cidr', 'feed-b', 'medium' FROM ev WHERE {third} AND dst_ip <> '198.51.2.7' "
        f"UNION SELECT id, '10.1.3.0/24', 'cidr', 'feed-c', 'critical' FROM ev WHERE {src} LIKE '10.1.3.%' "
        f"UNION SELECT id, '10.1.0.0/16', 'cidr', 'feed-b', 'low' FROM ev WHERE {src} LIKE '10.1.%' AND {src} NOT LIKE '10.1.3.%' "
        "UNION SELECT id, '2001:db8::1', 'ip', 'feed-a', 'high' FROM ev WHERE id % 21 = 7)) "
    )
    out["q_ti_events"] = ti + "SELECT * FROM x"
    top = f"list_extract(['informational', 'low', 'medium', 'high', 'critical'], CAST(max({_RANK.format('severity')}) AS INT))"
    out["q_ti_alerts"] = ti + (
        f", g AS (SELECT id, {top} AS level, count(*) AS n, string_agg(indicator, ',' ORDER BY indicator) AS indicators, "
        "string_agg(concat(indicator, ' (', ioc_type, ')'), ', ' ORDER BY ioc_type = 'cidr', indicator) AS shown, "
        "string_agg(DISTINCT source, ', ' ORDER BY source) AS feeds FROM x GROUP BY id) "
        "SELECT id, 'ti-ioc-match' AS rule_id, 'Threat Intelligence Match' AS rule_title, level, '' AS tactics, '' AS techniques, "
        "concat('Threat-intel match: ', shown, ' — source: ', feeds) AS message, sha256(concat('ti-ioc-match|', id)) AS dedup_hash, "
        "'open' AS status, indicators, event_time, vendor, src_ip, dst_ip, user_name, host_name FROM g JOIN ev USING (id)"
    )
    out["q_ioc_match_documents"] = (
        f"SELECT doc_id, '233.0.0.0/8' AS indicator, 'cidr' AS ioc_type, 'high' AS severity FROM documents WHERE len(list_filter({dot}, lambda x: x LIKE '233.%')) > 0 "
        f"UNION ALL SELECT doc_id, '114.0.0.0/8', 'cidr', 'low' FROM documents WHERE len(list_filter({dot}, lambda x: x LIKE '114.%')) > 0 "
        f"UNION ALL SELECT doc_id, 'mail6.example.com', 'domain', 'medium' FROM documents WHERE {domain.format('mail6.example.com')} "
        f"UNION ALL SELECT doc_id, 'example.org', 'domain', 'low' FROM documents WHERE {domain.format('example.org')}"
    )
    hidden = "'sha256:' || substr(sha256('s' || user_name), 1, 16)"
    hit = "severity = 'high'"
    swap = f"CASE WHEN {hit} THEN replace(message, user_name, {hidden}) ELSE message END"
    out["q_mask_hash"] = w + f"SELECT id, CASE WHEN {hit} THEN {hidden} ELSE user_name END AS user_name, {swap} AS message, raw FROM ev"
    out["q_mask_regex"] = w + "SELECT id, CASE WHEN action = 'allow' THEN '[redacted]' ELSE user_name END AS user_name, CASE WHEN action = 'allow' THEN regexp_replace(message, 'u[0-9]+', '[redacted]', 'g') ELSE message END AS message, CASE WHEN action = 'allow' THEN regexp_replace(raw, '(\"k\": *)[0-9]+', '\\1\"[redacted]\"') ELSE raw END AS raw, CASE WHEN action <> 'allow' THEN src_ip END AS src_ip FROM ev"
    out["q_sample_hash"] = w + "SELECT id FROM ev WHERE log_type <> 'click' OR CAST(concat('0x', substr(sha256(concat(user_name, chr(31), dst_port)), 1, 15)) AS BIGINT) % 10000 < 2500"
    out["q_route_drop"] = w + "SELECT id, CASE WHEN dst_port = 22 THEN 'ssh' ELSE vendor END AS vendor, CASE WHEN dst_port = 22 THEN 'gw' ELSE product END AS product, CASE WHEN dst_port = 22 THEN 'a' ELSE '' END AS applied FROM ev WHERE NOT (vendor LIKE '%cis%' AND severity = 'high')"
    out["q_dedup_hash"] = w + "SELECT id FROM ev WHERE id % 10 <> 0"
    out["q_mapper_fill_empty"] = w + "SELECT id, CASE WHEN message LIKE '%click%' THEN 'mapped' ELSE vendor END AS vendor, CASE WHEN message LIKE '%click%' THEN product ELSE 'second' END AS product, coalesce(CASE WHEN id % 2 = 0 THEN rule_name END, json_extract_string(raw, '$.k')) AS rule_name, app FROM ev"
    out["q_severity_rank"] = w + f"SELECT user_name, list_extract(['informational', 'low', 'medium', 'high', 'critical'], CAST(max({_RANK.format('severity')}) AS INT)) AS highest FROM ev GROUP BY 1"
    out["q_nation_customer_lookup"] = "SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"
    out["q_lineitem_monthly_top"] = "SELECT strftime(l_shipdate, '%Y-%m') AS month, l_returnflag, round(sum(l_extendedprice), 0) AS revenue, count(*) AS n FROM lineitem GROUP BY 1, 2 ORDER BY n DESC, month, l_returnflag LIMIT 10"
    return out
