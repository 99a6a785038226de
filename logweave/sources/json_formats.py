"""Parsers of JSON logs. Each takes rows with a text column value: a record, an array, or a wrapper object."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.ip import bind
from logweave.sources import industrial
from logweave.sources.event import events, host_port, lookup, timestamp, to_long, when_set

Get = Callable[..., Column]


_MAP = "map<string,string>"


def records(rows: DataFrame, *wrappers: str) -> DataFrame:
    """One row per record, as text in column raw, with its own keys in column _top; lines that are no JSON objects go."""
    rows = rows.select(F.rtrim(F.btrim(F.col("value"), F.lit(" \t\r\n﻿")), F.lit(",")).alias("_text"))
    text = F.col("_text")
    # a wrapper's name is in the text as it is, or escaped: other texts are not searched for it
    inner = [F.when(text.contains(w) | text.contains("\\u"), F.from_json(F.get_json_object(text, f"$['{w}']"), "array<string>")) for w in wrappers]
    listed = F.when(text.startswith("["), F.from_json(text, "array<string>")).otherwise(F.coalesce(*inner, F.array(text)))
    read = F.transform(listed, lambda r: F.struct(r.alias("raw"), F.when(r.startswith("{"), F.from_json(r, _MAP)).alias("_top")))
    return rows.select(F.explode(read).alias("x")).select("x.raw", "x._top").where(F.col("_top").isNotNull())


def _entries(map_: Column) -> Column:
    return F.coalesce(F.map_entries(map_), F.array().cast("array<struct<key:string,value:string>>"))


def _below(level: Column) -> Column:
    """The entries of the objects among a level's values, under dot-joined keys."""
    nested = F.filter(level, lambda e: e["value"].startswith("{"))
    named = lambda e: lambda x: F.struct(F.lower(F.concat_ws(".", e["key"], x["key"])).alias("key"), x["value"].alias("value"))
    return F.flatten(F.transform(nested, lambda e: F.transform(_entries(F.from_json(e["value"], _MAP)), named(e))))


def _scalar(v: Column) -> Column:
    """A scalar's text, of a list its first scalar's."""
    first = F.get(F.filter(F.from_json(v, "array<string>"), lambda x: ~x.rlike(r"^\s*[\[{]")), 0)
    return F.when(v.startswith("["), first).when(~v.startswith("{"), v)


def flat(rows: DataFrame, levels: int = 3) -> DataFrame:
    """Rows with column _m, a map of raw's lower-cased, dot-joined keys to scalar texts, trimmed and null where that leaves
    none; of a list its first scalar. Earlier, shallower keys win. Each step is a column, so that it is computed once."""
    top = F.col("_top") if "_top" in rows.columns else F.from_json("raw", _MAP)
    rows = rows.withColumn("_level1", F.transform(_entries(top), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    for k in range(2, levels + 1):
        rows = rows.withColumn(f"_level{k}", _below(F.col(f"_level{k - 1}")))
    every = F.concat(*[F.col(f"_level{k}") for k in range(1, levels + 1)])
    rows = rows.withColumn("_kept", F.filter(F.transform(every, lambda e: F.struct(e["key"], _scalar(e["value"]).alias("value"))), lambda e: F.length(e["value"]) > 0))
    keys = F.col("_kept")["key"]
    first = lambda name: when_set(F.get(F.filter("_kept", lambda e: e["key"] == name), 0)["value"])
    trimmed = F.transform(F.transform(F.col("_kept")["value"], lambda v: F.btrim(v)), lambda v: F.when(v != "", v))
    once = F.map_from_arrays(keys, trimmed)
    again = bind(F.array_distinct(keys), lambda d: F.map_from_arrays(d, F.transform(d, first)))
    return rows.withColumn("_m", F.when(F.size(F.array_distinct(keys)) == F.size(keys), once).otherwise(again)).drop("_kept", *[f"_level{k}" for k in range(1, levels + 1)])


def with_flat(rows: DataFrame) -> tuple[DataFrame, Get]:
    rows = flat(rows)

    def g(*names: str) -> Column:
        return F.coalesce(*[F.try_element_at("_m", F.lit(n.lower())) for n in names])

    return rows, g


def _noted(base: Column, note: Column) -> Column:
    return F.when(base.isNotNull() & note.isNotNull(), F.concat(base, F.lit(" — "), note)).otherwise(F.coalesce(base, note))


def _result(base: Column, result: Column) -> Column:
    return F.when(base.isNotNull() & result.isNotNull(), F.concat(base, F.lit(" ("), result, F.lit(")"))).otherwise(F.coalesce(base, result))


#: The keys that a column is looked for under, the first that is there.
GENERIC_KEYS = {
    "vendor": ("observer.vendor", "vendor"),
    "product": ("observer.product", "product"),
    "event_time": ("@timestamp", "timestamp", "time", "eventtime", "event_time", "_time", "datetime", "created_at", "ts", "observedtimestamp", "date"),
    "log_type": ("event.category", "event.type", "event_type", "event.dataset", "log_type", "logtype", "category", "type", "eventtype"),
    "severity": ("event.severity", "severity", "level", "sev", "priority", "log.level"),
    "action": ("event.action", "action", "act", "event_action", "disposition", "outcome", "activity"),
    "src_ip": ("source.ip", "src_ip", "srcip", "source_ip", "sourceip", "client.ip", "client_ip", "clientip", "src", "ipaddress", "ip"),
    "dst_ip": ("destination.ip", "dst_ip", "dstip", "dest_ip", "destip", "destination_ip", "server.ip", "dst"),
    "src_port": ("source.port", "src_port", "srcport", "sport", "sourceport"),
    "dst_port": ("destination.port", "dst_port", "dstport", "dport", "destinationport"),
    "protocol": ("network.protocol", "network.transport", "protocol", "proto", "transport", "ip_proto"),
    "user_name": ("user.name", "username", "user_name", "user", "account", "principal", "actor", "src_user", "subject"),
    "host_name": ("host.name", "hostname", "host", "computer", "device", "dvc", "observer.hostname"),
    "rule_name": ("rule.name", "rule", "rule_name", "signature", "alert.signature", "policy", "rulename"),
    "bytes_total": ("network.bytes", "bytes", "bytes_total", "total_bytes"),
    "message": ("message", "msg", "description", "summary", "text", "event.original", "raw_message"),
}


def generic_json(rows: DataFrame) -> DataFrame:
    """Records of any JSON log, bare or in a list under a usual name."""
    rows, g = with_flat(records(rows, "records", "data", "events", "logs"))
    found = {column: g(*keys) for column, keys in GENERIC_KEYS.items()}
    found |= {column: F.lower(found[column]) for column in ("severity", "protocol")}
    vendor, product = F.lower(F.coalesce(found.pop("vendor"), F.lit("json"))), found.pop("product")
    return events(rows, vendor, product, **(found | {"event_time": timestamp(found["event_time"])}))


def aws_cloudtrail(rows: DataFrame) -> DataFrame:
    rows, g = with_flat(records(rows, "Records"))
    service = F.split_part(g("eventsource"), F.lit("."), F.lit(1))
    console, error = g("responseelements.consolelogin"), g("errorcode")
    return events(
        rows, "aws", "cloudtrail",
        event_time=timestamp(g("eventtime")),
        log_type=service,
        app=service,
        action=F.when(console.isNotNull(), F.lower(console)).when(error.isNotNull(), "failed").otherwise("success"),
        src_ip=g("sourceipaddress"),
        user_name=g("useridentity.username", "useridentity.arn", "useridentity.principalid", "useridentity.type"),
        host_name=g("recipientaccountid", "useridentity.accountid"),
        rule_name=g("eventname"),
        message=F.coalesce(g("errormessage"), _noted(g("eventname"), console)),
    )


def azure_activity(rows: DataFrame) -> DataFrame:
    rows, g = with_flat(records(rows, "records", "value"))
    operation = g("operationname", "operationname.value", "operationname.localizedvalue")
    result = g("resulttype", "status", "resulttype.value", "status.value", "status.localizedvalue")
    level = F.lower(g("level"))
    return events(
        rows, "microsoft", "azure",
        event_time=timestamp(g("time", "eventtimestamp")),
        log_type=F.lower(F.coalesce(g("category", "category.value"), F.lit("activity"))),
        severity=lookup({"information": "informational", "verbose": "debug"}, level, level),
        action=operation,
        src_ip=g("calleripaddress", "clientipaddress"),
        user_name=g("identity.claims.name", "identity.claims.http://schemas.xmlsoap.org/ws/2005/05/identity/claims/upn", "identity.claims.upn", "caller"),
        rule_name=g("resourceid"),
        message=_result(operation, result),
    )


def entra_signin(rows: DataFrame) -> DataFrame:
    rows, g = with_flat(records(rows, "value", "records"))
    code, app, reason = to_long(g("status.errorcode")), g("appdisplayname"), g("status.failurereason")
    risk = F.lower(g("risklevelduringsignin", "risklevelaggregated"))
    base = F.when(app.isNotNull(), F.concat(F.lit("Sign-in to "), app)).otherwise("Sign-in")
    said = F.when(~F.lower(reason).isin("other.", "other"), reason)
    return events(
        rows, "microsoft", "entra",
        event_time=timestamp(g("createddatetime")),
        log_type=F.lit("signin"),
        severity=F.when(~risk.isin("none", "hidden", "unknownfuturevalue"), risk),
        action=F.when(code == 0, "success").when(code.isNotNull(), "failure"),
        src_ip=g("ipaddress"),
        user_name=g("userprincipalname", "userdisplayname"),
        app=app,
        host_name=g("devicedetail.displayname"),
        rule_name=g("clientappused"),
        message=_noted(base, said),
    )


def gcp_audit(rows: DataFrame) -> DataFrame:
    rows, g = with_flat(records(rows, "entries"))
    method = g("protopayload.methodname")
    return events(
        rows, "gcp", "cloud-audit",
        event_time=timestamp(g("timestamp")),
        log_type=g("protopayload.servicename"),
        severity=F.lower(g("severity")),
        action=method,
        src_ip=g("protopayload.requestmetadata.callerip"),
        user_name=g("protopayload.authenticationinfo.principalemail"),
        rule_name=g("protopayload.resourcename"),
        message=_noted(method, g("protopayload.status.message")),
    )


def github_audit(rows: DataFrame) -> DataFrame:
    rows, g = with_flat(records(rows))
    action, repo = g("action"), g("repo", "repository")
    return events(
        rows, "github", "audit",
        event_time=timestamp(g("@timestamp", "created_at", "timestamp")),
        log_type=F.split_part(action, F.lit("."), F.lit(1)),
        action=action,
        src_ip=g("actor_ip"),
        user_name=g("actor", "user"),
        rule_name=F.coalesce(repo, g("org", "business")),
        message=F.when(repo.isNotNull(), F.concat(action, F.lit(" on "), repo)).otherwise(action),
    )


def gitlab_audit(rows: DataFrame) -> DataFrame:
    rows, g = with_flat(records(rows))
    verbs = [F.when(g(f"details.{v}").isNotNull(), F.concat(F.lit(f"{v} "), g(f"details.{v}"))) for v in ("add", "remove", "change")]
    action = F.coalesce(g("details.custom_message"), g("event_name", "details.event_name"), *verbs)
    target = g("details.target_details", "details.entity_path")
    return events(
        rows, "gitlab", "audit",
        event_time=timestamp(g("created_at", "details.created_at")),
        log_type=F.lower(g("entity_type")),
        action=action,
        src_ip=g("details.ip_address"),
        user_name=g("details.author_name", "author_id"),
        rule_name=target,
        message=F.when(action.isNotNull() & target.isNotNull() & ~action.contains(target), _noted(action, target)).otherwise(action),
    )


def m365_audit(rows: DataFrame) -> DataFrame:
    rows = records(rows)
    embedded = F.get_json_object("raw", "$.AuditData")
    merged = F.concat(F.regexp_replace(embedded, r"\}\s*$", ","), F.substring("raw", 2, 1 << 30))
    rows = rows.withColumn("raw", F.when(embedded.startswith("{"), merged).otherwise(F.col("raw"))).drop("_top")
    rows, g = with_flat(rows)
    address, port = host_port(g("clientip", "clientipaddress", "actoripaddress"))
    return events(
        rows, "microsoft", "o365",
        event_time=timestamp(g("creationtime", "creationdate")),
        log_type=F.lower(g("workload")),
        action=g("operation"),
        src_ip=address,
        src_port=port,
        user_name=g("userid", "userprincipalname", "userkey"),
        rule_name=g("objectid"),
        message=_result(g("operation"), g("resultstatus", "result")),
    )


def okta_system_log(rows: DataFrame) -> DataFrame:
    rows, g = with_flat(records(rows, "value"))
    targets = F.from_json(F.get_json_object("raw", "$.target"), "array<map<string,string>>")
    app = F.get(F.filter(targets, lambda t: t["type"].isin("AppInstance", "app")), 0)
    sev = F.lower(g("severity"))
    return events(
        rows, "okta", "system-log",
        event_time=timestamp(g("published")),
        log_type=g("eventtype"),
        severity=lookup({"info": "informational", "warn": "warning"}, sev, sev),
        action=F.lower(g("outcome.result")),
        src_ip=F.coalesce(g("client.ipaddress"), F.get_json_object("raw", "$.request.ipChain[0].ip")),
        user_name=g("actor.alternateid", "actor.displayname"),
        app=F.coalesce(F.try_element_at(app, F.lit("displayName")), F.try_element_at(app, F.lit("alternateId"))),
        rule_name=g("legacyeventtype", "eventtype"),
        message=_noted(g("displaymessage", "eventtype"), g("outcome.reason")),
    )


def netflow(rows: DataFrame) -> DataFrame:
    rows, g = with_flat(records(rows, "flows"))
    sizes = [to_long(g("bytes")), to_long(g("out_bytes"))]
    total = F.when(F.coalesce(*sizes).isNotNull(), F.try_add(*[F.coalesce(s, F.lit(0).cast("long")) for s in sizes]))
    proto = F.coalesce(F.lower(g("protocol")), to_long(g("protocol_number")).cast("string"))
    end = lambda a, p: F.concat(F.coalesce(g(a), F.lit("?")), F.coalesce(F.concat(F.lit(":"), g(p)), F.lit("")))
    packets = F.concat(to_long(g("packets")).cast("string"), F.lit(" pkts"))
    flow = F.concat(F.coalesce(proto, F.lit("flow")), F.lit(" "), end("src_ip", "src_port"), F.lit(" -> "), end("dst_ip", "dst_port"))
    return events(
        rows, "netflow", F.lower(g("flow_version")),
        event_time=timestamp(g("end_time", "start_time", "export_time")),
        log_type=F.lit("netflow"),
        src_ip=g("src_ip"), dst_ip=g("dst_ip"), src_port=g("src_port"), dst_port=g("dst_port"),
        protocol=proto,
        app=g("application_name"),
        host_name=g("exporter"),
        bytes_total=total,
        message=F.concat_ws(" ", flow, packets, F.concat(total.cast("string"), F.lit(" bytes"))),
    )


def crowdstrike_json(rows: DataFrame) -> DataFrame:
    rows, get = with_flat(records(rows, "resources", "events"))
    g = lambda *names: F.coalesce(*[get(f"metadata.{n}", f"event.{n}", n) for n in names])
    kind, detection = g("eventtype", "event_simplename"), g("detectname", "detect_name", "name")
    found = detection.isNotNull() | F.coalesce(F.lower(kind).contains("detection"), F.lit(False))
    return events(
        rows, "crowdstrike", "falcon",
        event_time=timestamp(g("timestamp", "eventcreationtime", "processstarttime", "contexttimestamp", "detecttime", "@timestamp", "createdtimestamp", "processendtime")),
        log_type=F.when(found, "detection").otherwise(F.lower(F.coalesce(kind, F.lit("event")))),
        severity=g("severityname", "severity_name", "severity", "max_severity_displayname"),
        action=g("patterndispositiondescription", "pattern_disposition_description", "action", "status"),
        src_ip=g("localip", "local_ip", "src_ip"),
        dst_ip=g("externalip", "external_ip", "remoteaddress", "aip"),
        src_port=g("localport", "local_port"),
        dst_port=g("remoteport", "remote_port"),
        protocol=g("protocol", "connectionprotocol"),
        user_name=g("username", "user_name", "userid"),
        host_name=g("computername", "hostname", "host", "aid", "sensorid", "device_id"),
        rule_name=g("tactic", "technique"),
        message=F.coalesce(detection, g("commandline", "command_line", "filename", "filepath", "imagefilename", "description"), kind),
    )


def suricata_eve(rows: DataFrame) -> DataFrame:
    rows, g = with_flat(records(rows))
    kind = g("event_type")
    sizes = [to_long(g("flow.bytes_toserver")), to_long(g("flow.bytes_toclient"))]
    detail = (
        F.when(kind == "alert", g("alert.signature"))
        .when(kind == "dns", F.concat_ws(" ", F.lit("DNS"), g("dns.rrtype"), g("dns.rrname")))
        .when(kind == "http", F.concat_ws(" ", F.lit("HTTP"), g("http.http_method"), F.concat(F.coalesce(g("http.hostname"), F.lit("")), F.coalesce(g("http.url"), F.lit("")))))
        .when(kind == "tls", F.concat_ws(" ", F.lit("TLS"), g("tls.sni", "tls.subject")))
        .when(kind == "fileinfo", g("fileinfo.filename"))
    )
    return events(
        rows, "suricata", "eve",
        event_time=timestamp(g("timestamp")),
        log_type=kind,
        severity=lookup({"1": "high", "2": "medium", "3": "low"}, g("alert.severity")),
        action=g("alert.action"),
        src_ip=g("src_ip"), dst_ip=g("dest_ip"), src_port=g("src_port"), dst_port=g("dest_port"),
        protocol=F.lower(g("proto")),
        app=g("app_proto"),
        host_name=g("host"),
        rule_name=g("alert.signature"),
        bytes_total=F.when(F.coalesce(*sizes).isNotNull(), sum((F.coalesce(s, F.lit(0)) for s in sizes), F.lit(0))),
        message=F.coalesce(detail, kind),
    )


def _put(raw: Column, **new: Column) -> Column:
    """raw with keys added in front; null values are left out."""
    extra = F.to_json(F.struct(*[v.alias(k) for k, v in new.items()]))
    body = F.substring(F.ltrim(raw), 2, 1 << 30)
    comma = F.when(extra == "{}", "").when(F.btrim(body) == "}", "").otherwise(",")
    return F.concat(F.regexp_replace(extra, r"\}$", ""), comma, body)


def windows_security(rows: DataFrame) -> DataFrame:
    rows, g = with_flat(records(rows))
    text = F.coalesce(g("message", "description"), F.lit(""))
    code = F.coalesce(*[to_long(g(n)) for n in ("id", "event id", "eventid", "event_id")])

    def last(label: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(rf"{label}:\s*([^\r\n\t]+)"), F.lit(1))
        return F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter(F.transform(found, lambda x: F.btrim(x)), lambda v: ~v.isin("-", "NULL SID", ""))), -1)

    user, domain = last("Account Name"), last("Account Domain")
    summary = F.get(F.filter(F.transform(F.split(text, r"[\r\n]+"), lambda x: F.btrim(x)), lambda x: x != ""), 0)
    return events(
        rows.withColumn("raw", _put(F.col("raw"), event_id=code)), "microsoft", "windows",
        event_time=timestamp(g("timecreated", "date and time", "date", "time created")),
        log_type=F.lit("security"),
        severity=F.lower(g("leveldisplayname", "level")),
        action=lookup(WINDOWS_ACTIONS, code),
        src_ip=F.regexp_extract(text, r"Source Network Address:\s*([0-9A-Fa-f:.]+)", 1),
        user_name=F.when(domain.isNotNull() & ~user.contains("\\"), F.concat(domain, F.lit("\\"), user)).otherwise(user),
        host_name=g("machinename", "computername", "computer"),
        rule_name=F.when(code.isNotNull(), F.concat(F.lit("Event "), code.cast("string"))).otherwise(g("providername", "source")),
        message=F.coalesce(summary, g("providername", "source")),
    )


#: Event ids and what they report.
WINDOWS_ACTIONS = {
    4624: "logon", 4625: "failed-logon", 4634: "logoff", 4647: "logoff", 4648: "explicit-logon", 4672: "special-logon",
    4688: "process-create", 4689: "process-exit", 4720: "user-created", 4722: "user-enabled", 4725: "user-disabled",
    4726: "user-deleted", 4740: "account-locked", 4768: "kerberos-tgt", 4769: "kerberos-service",
    4776: "credential-validation", 1102: "audit-log-cleared", 4719: "audit-policy-changed",
}
SYSMON_KINDS = {
    1: "process-create", 2: "file-time-change", 3: "network-connect", 5: "process-exit", 6: "driver-load", 7: "image-load",
    8: "create-remote-thread", 9: "raw-access-read", 10: "process-access", 11: "file-create", 12: "registry-add-delete",
    13: "registry-set", 14: "registry-rename", 15: "file-stream-hash", 17: "pipe-create", 18: "pipe-connect",
    19: "wmi-filter", 20: "wmi-consumer", 21: "wmi-binding", 22: "dns-query", 23: "file-delete", 24: "clipboard",
    25: "process-tamper", 26: "file-delete-detected", 27: "file-block-executable", 28: "file-block-shredding",
    29: "file-executable-detected",
}
SYSMON_LIFTED = (
    "Image CommandLine ParentImage ParentCommandLine OriginalFileName TargetFilename TargetObject Details QueryName QueryResults User "
    "Hashes ProcessId ParentProcessId IntegrityLevel CurrentDirectory PipeName DestinationHostname SourceImage TargetImage "
    "GrantedAccess CallTrace ImageLoaded Signature Signed SignatureStatus StartModule StartFunction"
).split()


def sysmon(rows: DataFrame) -> DataFrame:
    rows, g = with_flat(records(rows))
    rows = rows.withColumns({"_said": F.coalesce(g("message", "description"), F.lit("")), "_code": to_long(g("id", "eventid", "event id"))})
    text, code = F.col("_said"), F.col("_code")

    def f(*names: str) -> Column:
        found = []
        for n in names:
            found += [g(f"event_data.{n}", f"eventdata.{n}", f"data.{n}"), when_set(F.regexp_extract(text, rf"(?mi)^\s*{n}:\s?(.*)$", 1))]
        return F.coalesce(*found)

    kind = lookup(SYSMON_KINDS, code.cast("int"), F.lit("sysmon"))
    unknown = lambda c: F.coalesce(c, F.lit("?"))
    connect = F.concat(unknown(f("Image")), F.lit(" -> "), unknown(f("DestinationIp")), F.lit(":"), unknown(f("DestinationPort")))
    summary = (
        F.when(code == 1, f("CommandLine")).when(code == 3, connect).when(code == 22, F.concat(F.lit("DNS query "), unknown(f("QueryName"))))
        .when(code.isin(11, 23, 26), f("TargetFilename")).when(code.isin(12, 13, 14), f("TargetObject"))
        .otherwise(F.coalesce(f("Image"), F.get(F.filter(F.transform(F.split(text, r"[\r\n]+"), lambda x: F.btrim(x)), lambda x: x != ""), 0)))
    )
    lifted = {k: F.when(g(k).isNull(), f(k)) for k in SYSMON_LIFTED}
    rule = f("RuleName")
    return events(
        rows.withColumn("raw", _put(F.col("raw"), event_id=code, **lifted)), "microsoft", "sysmon",
        event_time=timestamp(F.coalesce(f("UtcTime"), g("timecreated", "time created", "date"))),
        log_type=kind,
        action=kind,
        severity=F.lower(g("leveldisplayname", "level")),
        src_ip=f("SourceIp"), dst_ip=f("DestinationIp"), src_port=f("SourcePort"), dst_port=f("DestinationPort"),
        protocol=F.lower(f("Protocol")),
        user_name=f("User"),
        host_name=F.coalesce(g("machinename", "computername", "computer"), f("Computer")),
        rule_name=F.coalesce(F.when(rule != "-", rule), F.concat(F.lit("Event "), code.cast("string"))),
        message=summary,
    )


def zeek_json(rows: DataFrame) -> DataFrame:
    rows = records(rows)
    return zeek_events(rows)


def zeek_events(rows: DataFrame) -> DataFrame:
    """Rows with a raw JSON record of a connection-oriented log; _path names the log, else its keys tell."""
    rows, g = with_flat(rows)
    web = F.coalesce(g("method"), g("uri"), g("host"), g("status_code")).isNotNull()
    path = F.coalesce(F.lower(g("_path")), F.when(g("query").isNotNull(), "dns").when(web, "http").otherwise("conn"))
    sizes = [to_long(g(k)) for k in ("orig_bytes", "resp_bytes", "request_body_len", "response_body_len")]
    rows = rows.withColumn("_log", path)
    path = F.col("_log")
    rows, action, ot = industrial.enriched(rows, path, g)
    protocol = ot["protocol"]
    action = F.when(protocol.isNotNull(), action).when(path == "dns", g("rcode_name")).when(path == "http", g("status_code")).otherwise(g("conn_state"))
    text = (
        F.when(protocol.isNotNull(), F.concat_ws(" ", protocol, action))
        .when(path == "dns", F.concat_ws(" ", F.lit("DNS"), g("qtype_name"), g("query")))
        .when(path == "http", F.concat_ws(" ", F.lit("HTTP"), g("method"), F.concat(F.coalesce(g("host"), F.lit("")), F.coalesce(g("uri"), F.lit("")))))
        .otherwise(F.coalesce(g("service"), g("conn_state"), path))
    )
    out = events(
        rows.withColumn("raw", _put(F.col("raw"), ot=ot)), "zeek", path,
        event_time=timestamp(g("ts")),
        log_type=F.coalesce(protocol, path),
        action=action,
        src_ip=g("id.orig_h"), dst_ip=g("id.resp_h"), src_port=g("id.orig_p"), dst_port=g("id.resp_p"),
        protocol=F.lower(g("proto")),
        app=g("service", "app"),
        user_name=g("user", "username"),
        host_name=g("server_name"),
        rule_name=g("uid"),
        bytes_total=F.when(F.coalesce(*sizes).isNotNull(), sum((F.coalesce(s, F.lit(0)) for s in sizes), F.lit(0))),
        message=text,
    )
    return out
