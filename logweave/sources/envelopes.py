"""Envelopes of an event collector: bodies to envelopes, and each to the format and text that its parser reads.

A body is one or many JSON objects, apart or not, in an array or in lines. It is cut into tokens (strings, braces, the
rest); the depth of each is a running sum over the body's tokens, and where it returns to zero an envelope ends. Braces and
text like an envelope's within strings so count for nothing. A part that is no JSON costs itself: the search goes on from
its next brace, RETRIES times at most. A body that is nested deeper than DEEPEST is refused whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.scratch import written
from logweave.sources.detect import PARSERS
from logweave.sources.event import lookup

DEEPEST = 100
RETRIES = 8
_TOKENS = r'(?s)"(?:[^"\\]++|\\.)*+"|[{}\[\]]|[^"{}\[\]]++|"'

#: Formats that read JSON only, and formats that read text only.
JSON_ONLY = (
    "aws_cloudtrail", "aws_guardduty", "aws_securityhub", "azure_activity", "crowdstrike_json", "defender_xdr", "entra_signin", "gcp_audit", "generic_json",
    "github_audit", "gitlab_audit", "m365_audit", "netflow", "okta_system_log", "rapid7", "suricata_eve", "sysmon", "tenable", "windows_security", "zeek_json",
)
TEXT_ONLY = (
    "cef", "cisco_asa", "cisco_ftd", "cisco_ios", "crowdstrike_csv", "fortinet_fortigate", "generic_syslog", "leef", "linux_auditd", "meraki", "paloalto_csv",
    "paloalto_syslog", "qualys", "web_access", "zeek_tsv",
)
#: Source types and their formats: whole names, then a part of a name, then beginnings, the first that fits.
WHOLE_NAMES = {
    "json_suricata": "suricata_eve", "syslog": "generic_syslog", "rfc5424_syslog": "generic_syslog", "json": "generic_json", "_json": "generic_json",
    "json_no_timestamp": "generic_json", "azure:monitor:aad": "entra_signin", "azure:monitor:activitylog": "azure_activity", "auditd": "linux_auditd",
    "linux_secure": "generic_syslog", "linux_messages_syslog": "generic_syslog",
}
NAME_PARTS = {"sysmon": "sysmon"}
BEGINNINGS = {
    "cisco:asa": "cisco_asa", "cisco:ftd": "cisco_ftd", "cisco:sourcefire": "cisco_ftd", "cisco:firepower": "cisco_ftd", "cisco:fmc": "cisco_ftd", "cisco:fwsm": "cisco_asa",
    "cisco:pix": "cisco_asa", "cisco:ios": "cisco_ios", "cisco:nxos": "cisco_ios", "cisco:nx-os": "cisco_ios", "cisco:meraki": "meraki", "meraki": "meraki",
    "pan:": "paloalto_syslog", "pan_": "paloalto_syslog", "paloalto": "paloalto_syslog", "palo_alto": "paloalto_syslog", "fgt_": "fortinet_fortigate", "fgt:": "fortinet_fortigate",
    "fortigate": "fortinet_fortigate", "fortinet": "fortinet_fortigate", "xmlwineventlog": "windows_security", "wineventlog": "windows_security", "windows:": "windows_security",
    "linux_audit": "linux_auditd", "access_": "web_access", "apache": "web_access", "nginx": "web_access", "suricata": "suricata_eve", "cef": "cef", "leef": "leef",
    "bro": "zeek_json", "zeek": "zeek_json", "aws:cloudtrail": "aws_cloudtrail", "aws:guardduty": "aws_guardduty", "aws:securityhub": "aws_securityhub",
    "aws:inspector": "aws_securityhub", "ms:defender": "defender_xdr", "ms365:defender": "defender_xdr", "mscs:defender": "defender_xdr", "microsoft:defender": "defender_xdr",
    "azure:defender": "defender_xdr", "defender": "defender_xdr", "qualys": "qualys", "tenable": "tenable", "nessus": "tenable", "rapid7": "rapid7", "insightvm": "rapid7",
    "nexpose": "rapid7", "netflow": "netflow", "ipfix": "netflow", "sflow": "netflow", "o365:": "m365_audit", "ms:o365": "m365_audit", "okta": "okta_system_log",
    "azure:aad": "entra_signin", "ms:aad": "entra_signin", "msaad": "entra_signin", "entra": "entra_signin", "azure:activity": "azure_activity", "mscs:azure": "azure_activity",
    "google:gcp": "gcp_audit", "gcp:": "gcp_audit", "github": "github_audit", "gitlab": "gitlab_audit", "crowdstrike": "crowdstrike_json", "nutanix:files": "nutanix_files",
    "nutanix": "nutanix_pc",
}
#: Members of an envelope that stand above those of its event.
META = ("host", "source", "sourcetype", "index", "time")
_OBJECT = "map<string,variant>"


def format_of(sourcetype: Column) -> Column:
    """The format of a source type, null for one that is unknown or has no parser."""
    name = F.lower(F.btrim(sourcetype))
    known = lambda table: {k: v for k, v in table.items() if v in PARSERS}
    begins = [(name.startswith(k), v) for k, v in BEGINNINGS.items()]
    parts = [(name.contains(k), v) for k, v in NAME_PARTS.items()]
    cases = parts + begins
    found = reduce(lambda acc, c: acc.when(c[0], c[1] if c[1] in PARSERS else None), cases[1:], F.when(cases[0][0], cases[0][1]))
    return F.coalesce(lookup(known(WHOLE_NAMES), name), found)


def _parts(bodies: DataFrame) -> DataFrame:
    """Rows (body, part, text) of the outermost JSON values of stored rows (body, text); the rest between goes. The last
    value may not be whole."""
    tokens = bodies.select("body", F.posexplode_outer(F.regexp_extract_all("text", F.lit(_TOKENS), F.lit(0))).alias("at", "t")).where("t is not null")
    step = F.when(F.col("t").isin("{", "["), 1).when(F.col("t").isin("}", "]"), -1).otherwise(0)
    upto = Window.partitionBy("body").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    tokens = tokens.withColumn("depth", F.sum(step).over(upto))
    # a closing brace too many ends what stands before it: depths are counted from the least one so far
    tokens = tokens.withColumn("least", F.least(F.min("depth").over(upto), F.lit(0)))
    level = F.col("depth") - F.col("least")
    tokens = tokens.withColumn("level", level).withColumn("closes", (F.col("t").isin("}", "]") & (level == 0)).cast("int"))
    before = Window.partitionBy("body").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    tokens = tokens.withColumn("part", F.coalesce(F.sum("closes").over(before), F.lit(0)))
    deepest = Window.partitionBy("body")
    inside = tokens.withColumn("deepest", F.max("level").over(deepest)).where(f"deepest <= {DEEPEST} and (level > 0 or closes = 1)")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "t"))), lambda x: x["t"]), "")
    return inside.groupBy("body", "part").agg(joined.alias("text"))


def envelopes(rows: DataFrame, column: str = "value") -> DataFrame:
    """Rows (envelope) of the JSON objects in bodies, as JSON text."""
    left = rows.select(F.monotonically_increasing_id().cast("string").alias("body"), F.col(column).alias("text")).where("text is not null")
    left, out = written(left, "bodies"), None
    for _ in range(1 + RETRIES):
        parts = written(_parts(left).withColumn("good", F.try_parse_json("text").isNotNull()), "parts")
        whole = parts.where("good").select("text")
        out = whole if out is None else out.unionByName(whole)
        bad = parts.where("not good and instr(substr(text, 2), '{') > 0")
        if not bad.limit(1).count():
            break
        left = written(bad.select(F.concat_ws("/", "body", "part").alias("body"), F.expr("substr(text, 1 + instr(substr(text, 2), '{'))").alias("text")), "bodies")
    listed = F.when(F.col("text").startswith("["), F.from_json("text", "array<string>")).otherwise(F.array("text"))
    return out.select(F.explode_outer(listed).alias("envelope")).where(F.col("envelope").startswith("{"))


def raw_envelopes(rows: DataFrame, column: str = "value") -> DataFrame:
    """Rows (envelope) of the lines of raw bodies; the columns of rows named as in META are what the request said."""
    line = F.explode_outer(F.split(column, r"\r\n|[\r\n]", -1)).alias("event")
    lines = rows.select(line, *[F.col(c).cast("string").alias(c) for c in META if c in rows.columns]).where("trim(event) <> ''")
    return lines.select(F.to_json(F.struct("event", *[F.nullif(F.col(c), F.lit("")).alias(c) for c in META if c in rows.columns])).alias("envelope"))


def routed(found: DataFrame) -> DataFrame:
    """Rows (format, value, time, host) of envelopes: the format's text, or a JSON record of event, fields and metadata.
    The event's own members stand below the envelope's metadata and above its fields. Envelopes without any go."""
    text = lambda v: F.to_json(v)
    rows = found.select(F.from_json("envelope", _OBJECT).alias("e"), F.get_json_object("envelope", "$.event").alias("event"))
    rows = rows.withColumns({k: F.try_element_at("e", F.lit(k)) for k in (*META, "fields")}).withColumn("kind", F.schema_of_variant(F.try_element_at("e", F.lit("event"))))
    is_object = F.col("kind").startswith("OBJECT")
    none = F.from_json(F.lit("{}"), _OBJECT)
    event = F.when(is_object, F.coalesce(F.from_json("event", _OBJECT), none)).otherwise(none)
    fields = F.when(F.schema_of_variant("fields").startswith("OBJECT"), F.coalesce(F.from_json(text(F.col("fields")), _OBJECT), none)).otherwise(none)
    meta = F.map_filter(F.col("e"), lambda k, v: k.isin(*META) & ~F.coalesce(text(v), F.lit("null")).isin("null", '""'))
    rows = rows.withColumns({"own": event, "more": fields, "meta": meta})
    value = F.when(~is_object & F.col("kind").isNotNull() & (F.col("kind") != "VOID"), F.col("event"))
    rows = rows.withColumn("text", F.when(F.btrim(value) != "", value))
    message = F.when(F.col("text").isNotNull(), F.map_concat(none, F.from_json(F.to_json(F.struct(F.col("text").alias("message"))), _OBJECT))).otherwise(none)
    rows = rows.withColumn("message", message)
    above = lambda *maps: lambda k, v: reduce(Column.__and__, [~F.map_contains_key(m, k) for m in maps])
    record = F.map_concat(
        F.map_filter("more", above("own", "meta", "message")), F.map_filter("own", above("meta", "message")), F.map_filter("meta", above("message")), "message"
    )
    mapped = format_of(F.try_variant_get("sourcetype", "$", "string"))
    is_json = F.col("text").rlike(r"^\s*[\[{]")
    verbatim = F.col("text").isNotNull() & mapped.isNotNull() & F.when(is_json, ~mapped.isin(*TEXT_ONLY)).otherwise(~mapped.isin(*JSON_ONLY))
    shaped = F.when(is_object & mapped.isNotNull() & ~mapped.isin(*TEXT_ONLY), mapped).otherwise("generic_json")
    there = is_object | F.col("text").isNotNull() | (F.size("more") > 0)
    rows = rows.where(F.coalesce(there, F.lit(False)))
    return rows.select(
        F.when(verbatim, mapped).otherwise(shaped).alias("format"),
        F.when(verbatim, F.col("text")).otherwise(text(record)).alias("value"),
        F.try_variant_get("time", "$", "string").alias("time"),
        F.try_variant_get("host", "$", "string").alias("host"),
    )
