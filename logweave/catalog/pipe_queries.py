"""Catalogue of the pipe language: each entry is a query and the SQL with the same rows."""

from __future__ import annotations

from functools import cache

from pyspark.sql import functions as F

from logweave.catalog.adapter import AS_OF, SQL, events, flat
from logweave.operators.models import Registry
from logweave.plans.run import pipe


@cache
def registry() -> Registry:
    return Registry.load()


#: name: (query, columns, rest of the SQL over ev)
ALL = (
    "id, event_time, vendor, product, log_type, severity, action, src_ip, dst_ip, src_port, dst_port, protocol, app, user_name, "
    "host_name, rule_name, bytes_total, message"
)
PIPE: dict[str, tuple[str, str]] = {
    "q_search_eq": ("action=deny severity=low", f"SELECT {ALL} FROM ev WHERE action = 'deny' AND severity = 'low'"),
    "q_search_glob": ('message="ERROR*u1?" | fields id, message', "SELECT id, message FROM ev WHERE message ILIKE 'error%u1_'"),
    "q_search_glob_escaped": ('rule_name="rule_1*%" | fields id, rule_name', r"SELECT id, rule_name FROM ev WHERE rule_name ILIKE 'rule\_1%\%' ESCAPE '\'"),
    "q_search_exists": ("rule_name=* app!=* | fields id, rule_name", "SELECT id, rule_name FROM ev WHERE rule_name IS NOT NULL AND app IS NULL"),
    "q_search_in": ("dst_port in (22, 502) user_name in (u1, u2, 'u3') | fields id, dst_port, user_name", "SELECT id, dst_port, user_name FROM ev WHERE dst_port IN (22, 502) AND user_name IN ('u1', 'u2', 'u3')"),
    "q_search_not_or": ("not action=allow severity=high or dst_port=502 user_name=u7 | fields id", "SELECT id FROM ev WHERE (NOT action = 'allow' AND severity = 'high') OR (dst_port = 502 AND user_name = 'u7')"),
    "q_search_time_range": ('event_time >= "2024-01-05" event_time < "2024-01-06 12:00:00" | fields id, event_time', "SELECT id, event_time FROM ev WHERE event_time >= TIMESTAMP '2024-01-05' AND event_time < TIMESTAMP '2024-01-06 12:00:00'"),
    "q_search_time_relative": ('event_time > "-48h" | fields id', "SELECT id FROM ev WHERE event_time > TIMESTAMP '2024-01-31' - INTERVAL 48 HOUR"),
    "q_search_time_epoch": ("event_time < 1704240000 | fields id", "SELECT id FROM ev WHERE event_time < TIMESTAMP '2024-01-03'"),
    "q_search_fts_single": ("purchase | fields id, message", "SELECT id, message FROM ev WHERE list_contains(string_split(message, ' '), 'purchase')"),
    "q_search_fts_multi": ("error u12 not h3 | fields id, message", "SELECT id, message FROM ev WHERE message = 'error by u12' AND host_name <> 'h3'"),
    "q_where_expr": ("* | where src_port > dst_port * 2 and bytes_total >= 500 | fields id, src_port, dst_port", "SELECT id, src_port, dst_port FROM ev WHERE src_port > dst_port * 2 AND bytes_total >= 500"),
    "q_where_like": ("* | where message like 'click by u%1' | fields id, message", "SELECT id, message FROM ev WHERE message LIKE 'click by u%1'"),
    "q_where_isnull": ("* | where isnull(rule_name) and isnotnull(app) | stats count", 'SELECT count(*) AS "count" FROM ev WHERE rule_name IS NULL AND app IS NOT NULL'),
    "q_where_arith_cmp": ("* | where (bytes_total + 10) / 2 - 5 > 4000 and -bytes_total < -9000 | fields id, bytes_total", "SELECT id, bytes_total FROM ev WHERE (bytes_total + 10) / 2.0 - 5 > 4000 AND -bytes_total < -9000"),
    "q_where_field_eq": ("* | where src_port = dst_port + 1002 or vendor = log_type | fields id", "SELECT id FROM ev WHERE src_port = dst_port + 1002 OR vendor = log_type"),
    "q_eval_math": ("* | eval kb = bytes_total / 1024 | eval twice = kb * 2 + 1 | eval r = round(twice, 3) | fields id, r", "SELECT id, CAST(round(CAST(bytes_total AS DOUBLE) / 1024 * 2 + 1, 3) AS DOUBLE) AS r FROM ev"),
    "q_eval_modulo": ("* | eval m = id % 7 | eval n = (0 - id) % 3 | fields id, m, n", "SELECT id, CAST(id % 7 AS DOUBLE) AS m, CAST((0 - id) % 3 AS DOUBLE) AS n FROM ev"),
    "q_eval_concat": ("* | eval who = user_name . '@' . host_name | eval r = rule_name . '!' | fields id, who, r", "SELECT id, user_name || '@' || host_name AS who, rule_name || '!' AS r FROM ev"),
    "q_eval_if": ("* | eval risk = if(severity = 'high' or dst_port = 3389, 'hot', 'cold') | stats count by risk", "SELECT CASE WHEN severity = 'high' OR dst_port = 3389 THEN 'hot' ELSE 'cold' END AS risk, count(*) AS \"count\" FROM ev GROUP BY 1"),
    "q_eval_string_funcs": ("* | eval a = upper(action) | eval b = lower(rule_name) | eval c = len(message) | eval d = trim('  x ') | eval e = replace(message, ' by ', '/') | eval f = substr(message, 0, 4) | eval g = substr(message, 3) | eval h = trim(user_name, 'u1') | fields id, a, b, c, d, e, f, g, h", "SELECT id, upper(action) AS a, lower(rule_name) AS b, length(message) AS c, trim('  x ') AS d, replace(message, ' by ', '/') AS e, substr(message, 1, 3) AS f, substr(message, 3) AS g, trim(user_name, 'u1') AS h FROM ev"),
    "q_eval_round": ("* | eval x = bytes_total / 8 | eval y = round(x) | eval z = abs(0 - ceil(x)) + floor(x) | fields id, y, z", "SELECT id, CAST(round(CAST(bytes_total AS DOUBLE) / 8) AS DOUBLE) AS y, CAST(abs(0 - ceil(bytes_total / 8.0)) + floor(bytes_total / 8.0) AS DOUBLE) AS z FROM ev"),
    "q_eval_coalesce": ("* | eval name = coalesce(rule_name, app, 'none') | stats count by name", "SELECT coalesce(rule_name, app, 'none') AS name, count(*) AS \"count\" FROM ev GROUP BY 1"),
    "q_eval_replace_in_place": ("* | eval severity = upper(severity) | head 20000000 | fields id, severity", "SELECT id, upper(severity) AS severity FROM ev"),
    "q_fields_keep": ("* | fields message, id", "SELECT message, id FROM ev"),
    "q_fields_drop": ("* | fields - message, rule_name, app, protocol", "SELECT id, event_time, vendor, product, log_type, severity, action, src_ip, dst_ip, src_port, dst_port, user_name, host_name, bytes_total FROM ev"),
    "q_fields_raw_key": ("k=69 | fields id, k", "SELECT id, json_extract_string(raw, '$.k') AS k FROM ev WHERE CAST(json_extract_string(raw, '$.k') AS DOUBLE) = 69"),
    "q_rename": ("severity=high | rename user_name as account, host_name as machine | fields id, account, machine", "SELECT id, user_name AS account, host_name AS machine FROM ev WHERE severity = 'high'"),
    "q_rename_swap": ("severity=high | rename src_ip as dst_ip, dst_ip as src_ip | fields id, src_ip, dst_ip", "SELECT id, dst_ip AS src_ip, src_ip AS dst_ip FROM ev WHERE severity = 'high'"),
    "q_sort_multi_nulls": ("* | sort -app, user_name, -id | head 120 | fields id, app, user_name", "SELECT id, app, user_name FROM ev ORDER BY app DESC NULLS FIRST, user_name ASC NULLS LAST, id DESC NULLS LAST LIMIT 120"),
    "q_sort_last_null": ("* | sort user_name, -rule_name | head 77 | fields id, user_name, rule_name", "SELECT id, user_name, rule_name FROM ev ORDER BY user_name NULLS LAST, rule_name DESC NULLS LAST, id LIMIT 77"),
    "q_head": ("* | sort id | head 25", f"SELECT {ALL} FROM ev ORDER BY id LIMIT 25"),
    "q_dedup": ("* | dedup user_name, action | fields id, user_name, action", "SELECT min(id) AS id, user_name, action FROM ev GROUP BY user_name, action"),
    "q_dedup_ordered": ("* | sort -event_time, -id | dedup host_name | fields id, host_name, event_time", "SELECT id, host_name, event_time FROM (SELECT *, row_number() OVER (PARTITION BY host_name ORDER BY event_time DESC, id DESC) AS rn FROM ev) WHERE rn = 1"),
    "q_stats_global": ("* | stats count, sum(bytes_total) as b, avg(bytes_total) as a, min(event_time) as first, max(src_port) as p", 'SELECT count(*) AS "count", CAST(sum(bytes_total) AS DOUBLE) AS b, CAST(avg(bytes_total) AS DOUBLE) AS a, min(event_time) AS first, max(src_port) AS p FROM ev'),
    "q_stats_by": ("* | stats count by action, severity", 'SELECT action, severity, count(*) AS "count" FROM ev GROUP BY ALL'),
    "q_stats_multi": ("* | stats count(rule_name), sum(bytes_total), min(user_name), max(user_name) by app", "SELECT app, count(rule_name) AS count_rule_name, CAST(sum(bytes_total) AS DOUBLE) AS sum_bytes_total, min(user_name) AS min_user_name, max(user_name) AS max_user_name FROM ev GROUP BY app"),
    "q_stats_dc": ("* | stats dc(user_name) as users, distinct_count(dst_ip) by host_name", "SELECT host_name, count(DISTINCT user_name) AS users, count(DISTINCT dst_ip) AS dc_dst_ip FROM ev GROUP BY host_name"),
    "q_stats_values": ("* | stats values(app) as apps by dst_port", "SELECT dst_port, array_to_string(list_sort(list(DISTINCT app)), ',') AS apps FROM ev GROUP BY dst_port"),
    "q_stats_list": ("user_name in (u1, u2) | stats list(id) as ids by user_name", "SELECT user_name, array_to_string(list_sort(list(CAST(id AS VARCHAR))), ',') AS ids FROM ev WHERE user_name IN ('u1', 'u2') GROUP BY user_name"),
    "q_stats_by_raw": ("* | stats count, max(bytes_total) as top by k", "SELECT json_extract_string(raw, '$.k') AS k, count(*) AS \"count\", max(bytes_total) AS top FROM ev GROUP BY 1"),
    "q_stats_having_where": ("* | stats count as n by user_name | where n > 70 | sort -n, user_name", "SELECT user_name, count(*) AS n FROM ev GROUP BY 1 HAVING count(*) > 70"),
    "q_top": ("* | top 5 user_name", 'SELECT user_name, "count", CAST(round(100.0 * "count" / sum("count") OVER (), 2) AS DOUBLE) AS percent FROM (SELECT user_name, count(*) AS "count" FROM ev GROUP BY 1) ORDER BY "count" DESC, user_name LIMIT 5'),
    "q_top_by": ("* | top 12 dst_port by action", 'SELECT action, dst_port, "count", CAST(round(100.0 * "count" / sum("count") OVER (PARTITION BY action), 2) AS DOUBLE) AS percent FROM (SELECT action, dst_port, count(*) AS "count" FROM ev GROUP BY 1, 2) ORDER BY "count" DESC, action, dst_port LIMIT 12'),
    "q_rare": ("* | rare host_name", 'SELECT host_name, "count", CAST(round(100.0 * "count" / sum("count") OVER (), 2) AS DOUBLE) AS percent FROM (SELECT host_name, count(*) AS "count" FROM ev GROUP BY 1) ORDER BY "count", host_name LIMIT 10'),
    "q_bin": ("severity=high | bin span=6h _time as slot | fields id, slot", "SELECT id, time_bucket(INTERVAL 6 HOUR, event_time, TIMESTAMP '1970-01-01') AS slot FROM ev WHERE severity = 'high'"),
    "q_bin_stats": ("* | bin span=7d event_time | stats count by event_time", "SELECT time_bucket(INTERVAL 7 DAY, event_time, TIMESTAMP '1970-01-01') AS event_time, count(*) AS \"count\" FROM ev GROUP BY 1"),
    "q_timechart": ("* | timechart span=1d count, sum(bytes_total) as b", "SELECT time_bucket(INTERVAL 1 DAY, event_time, TIMESTAMP '1970-01-01') AS _time, count(*) AS \"count\", CAST(sum(bytes_total) AS DOUBLE) AS b FROM ev GROUP BY 1"),
    "q_timechart_by": ("* | timechart span=12h count by action", "SELECT time_bucket(INTERVAL 12 HOUR, event_time, TIMESTAMP '1970-01-01') AS _time, action, count(*) AS \"count\" FROM ev GROUP BY 1, 2"),
    "q_timechart_multi_agg": ("* | timechart dc(user_name) as users, max(bytes_total) as top, avg(dst_port) as p by severity", "SELECT time_bucket(INTERVAL 1 HOUR, event_time, TIMESTAMP '1970-01-01') AS _time, severity, count(DISTINCT user_name) AS users, max(bytes_total) AS top, CAST(avg(dst_port) AS DOUBLE) AS p FROM ev GROUP BY 1, 2"),
}

_AUTH = "(log_type IN ('signin', 'authentication', 'auth', 'authpriv'))"
_NET = "(vendor = 'cisco' OR log_type = 'modbus')"
#: Queries that start from a data model; ev has the tags by the same clauses, as far as the adapter can meet them.
MODEL: dict[str, tuple[str, str]] = {
    "q_model_source": ("from datamodel:Authentication | fields id, src, dest, user, vendor_product", f"SELECT id, src_ip AS src, host_name AS dest, user_name AS user, vendor || ' ' || product AS vendor_product FROM ev WHERE {_AUTH}"),
    "q_model_filter_stats": ("from datamodel:network action=deny | stats count, sum(bytes) as b by dest_port", f"SELECT dst_port AS dest_port, count(*) AS \"count\", CAST(sum(bytes_total) AS DOUBLE) AS b FROM ev WHERE {_NET} AND action = 'deny' GROUP BY 1"),
    "q_model_command": ("| datamodel web | where dest_port = 443 | top 3 src", "SELECT src, \"count\", CAST(round(100.0 * \"count\" / sum(\"count\") OVER (), 2) AS DOUBLE) AS percent FROM (SELECT src_ip AS src, count(*) AS \"count\" FROM ev WHERE log_type = 'http' AND dst_port = 443 GROUP BY 1) ORDER BY \"count\" DESC, src LIMIT 3"),
}


def _run(text: str, model: bool = False):
    def query(spark, sf_dir):
        rows = events(spark, sf_dir)
        rows = registry().tag(rows) if model else rows
        return flat(pipe(rows, text, as_of=AS_OF, models=registry(), limit=None))

    return query


def _base(spark, sf_dir):
    return pipe(events(spark, sf_dir), "severity=high | stats count by user_name", base=F.col("host_name").isin("h1", "h2"), limit=None)


def _counts(spark, sf_dir):
    return registry().member_counts(registry().tag(events(spark, sf_dir)))


def _multi(spark, sf_dir):
    rows = registry().tag(events(spark, sf_dir)).where(F.size("cim_models") > 1)
    return flat(rows.select("id", F.col("cim_models").alias("tags")))


def queries():
    out = {k: _run(text) for k, (text, _) in PIPE.items()}
    out |= {k: _run(text, model=True) for k, (text, _) in MODEL.items()}
    return out | {"q_base_filter": _base, "q_model_member_counts": _counts, "q_model_multi_tag": _multi}


_TAGS = (
    f"SELECT id, unnest(list_filter([CASE WHEN {_AUTH} THEN 'authentication' END, CASE WHEN log_type = 'modbus' THEN 'ics' END, "
    f"CASE WHEN {_NET} THEN 'network' END, CASE WHEN log_type = 'http' THEN 'web' END], lambda x: x IS NOT NULL)) AS tag FROM ev"
)


def oracle_sql():
    with_ev = f"WITH ev AS ({SQL}) "
    out = {k: with_ev + sql for k, (_, sql) in (PIPE | MODEL).items()}
    out["q_base_filter"] = with_ev + "SELECT user_name, count(*) AS \"count\" FROM ev WHERE host_name IN ('h1', 'h2') AND severity = 'high' GROUP BY 1"
    out["q_model_member_counts"] = with_ev + f"SELECT tag, count(*) AS n FROM ({_TAGS}) GROUP BY 1"
    out["q_model_multi_tag"] = with_ev + f"SELECT id, string_agg(tag, ',' ORDER BY tag) AS tags FROM ({_TAGS}) GROUP BY 1 HAVING count(*) > 1"
    return out
