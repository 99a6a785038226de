"""Parsers of findings: cloud threat and posture findings, endpoint alerts, file audits, vulnerability scanners."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.ip import bind
from logweave.sources.event import events, lookup, timestamp, to_long, to_port, when_set
from logweave.sources.json_formats import _noted, _put, _result, records, with_flat
from logweave.sources.line_formats import found, syslog_parts

_HIDDEN = ("unknown", "unknownfuturevalue", "none", "notavailable")


def _items(raw: Column, *paths: str) -> Column:
    """The first of the paths that is an array of objects, as maps."""
    return F.coalesce(*[F.from_json(F.get_json_object(raw, p), "array<map<string,string>>") for p in paths], F.array().cast("array<map<string,string>>"))


def _bands(score: Column, bands: list[tuple[float, str]], lowest: str) -> Column:
    """The name of the first band that the score reaches."""

    def named(n: Column) -> Column:
        start = F.when(n.isNull(), F.lit(None).cast("string"))
        return reduce(lambda acc, b: acc.when(n >= b[0], b[1]), bands, start).otherwise(lowest)

    return bind(score, named)


def _maps(text: Column) -> Column:
    """An array of objects as maps."""
    return F.from_json(text, "array<map<string,string>>")


def _map(text: Column) -> Column:
    """An object as a map of its own keys; null for other texts."""
    return F.when(F.ltrim(text).startswith("{"), F.from_json(text, "map<string,string>"))


def _first(values: Column) -> Column:
    return F.get(F.filter(values, lambda v: v.isNotNull()), 0)


#: Actions that a finding may be of, and the spellings of an object's keys.
FINDING_ACTIONS = ("networkConnectionAction", "awsApiCallAction", "dnsRequestAction", "portProbeAction", "kubernetesApiCallAction", "rdsLoginAttemptAction")
SPELLINGS = ("upper", "lower")


def _spelled(key: str, spelling: str) -> str:
    return key[0].upper() + key[1:] if spelling == "upper" else key


def aws_guardduty(rows: DataFrame) -> DataFrame:
    """Findings in either spelling. Objects are opened once, level by level, and only those that are there."""
    rows = records(rows, "Findings", "findings")
    at = lambda m, key: F.try_element_at(m, F.lit(key))
    opened = {s: _map(at(_map(at(F.col("_top"), _spelled("service", s))), _spelled("action", s))) for s in SPELLINGS}
    rows = rows.withColumns({f"_{s}": m for s, m in opened.items()})
    each = [F.struct(F.lit(a == "portProbeAction").alias("probe"), *[_map(at(F.col(f"_{s}"), _spelled(a, s))).alias(s) for s in SPELLINGS]) for a in FINDING_ACTIONS]
    rows = rows.withColumn("_actions", F.filter(F.array(*each), lambda x: x["upper"].isNotNull() | x["lower"].isNotNull()))
    details = F.coalesce(*[_maps(at(F.get(F.filter("_actions", lambda x: x["probe"]), 0)[s], _spelled("portProbeDetails", s))) for s in SPELLINGS])
    rows, g = with_flat(rows.withColumn("_probe", F.get(details, 0)))
    kind = g("type")

    def side(name: str, *keys: str) -> Column:
        def there(spelling: str) -> Column:
            found_ = lambda text: F.coalesce(*[when_set(F.get_json_object(text, f"$.{_spelled(k, spelling)}")) for k in keys])
            sides = F.transform(F.filter("_actions", lambda x: ~x["probe"]), lambda x: at(x[spelling], _spelled(name, spelling)))
            return _first(F.transform(sides, found_))

        probed = [F.get_json_object(at(F.col("_probe"), n), f"$.{k2}") for n in (name, _spelled(name, "upper")) for k in keys for k2 in (k, _spelled(k, "upper"))]
        return F.coalesce(*[there(s) for s in SPELLINGS], F.when(F.col("_probe").isNotNull(), F.coalesce(*[when_set(c) for c in probed])))

    def detail(key: str) -> Column:
        listed = F.transform("_actions", lambda x: F.coalesce(*[at(x[s], _spelled(key, s)) for s in SPELLINGS]))
        return F.coalesce(*[g(f"service.action.{a}.{key}") for a in FINDING_ACTIONS], _first(listed))

    def inside(place: str, key: str) -> Column:
        """The first object of a list in the finding's resource."""
        path = lambda s: "".join(f".{_spelled(k, s)}" for k in place.split("."))
        listed = F.coalesce(*[_maps(F.get_json_object(at(F.col("_top"), _spelled("resource", s)), f"${path(s)}")) for s in SPELLINGS])
        return bind(F.get(listed, 0), lambda m: F.coalesce(*[at(m, _spelled(key, s)) for s in SPELLINGS]))

    rows = rows.withColumns({
        "_local": F.coalesce(side("localIpDetails", "ipAddressV4", "ipAddressV6"), inside("instanceDetails.networkInterfaces", "privateIpAddress")),
        "_remote": side("remoteIpDetails", "ipAddressV4", "ipAddressV6"), "_local_port": side("localPortDetails", "port"), "_remote_port": side("remotePortDetails", "port"),
        "_named": F.lower(side("localPortDetails", "portName")), "_blocked": detail("blocked"), "_type": g("service.action.actiontype"), "_way": F.upper(detail("connectionDirection")),
    })
    action_type, blocked, named = F.col("_type"), F.col("_blocked"), F.col("_named")
    out = F.coalesce((F.col("_way") == "OUTBOUND") | (F.upper(action_type) == "DNS_REQUEST"), F.lit(False))
    # the vendor's bands end at 3.9, 6.9 and 8.9
    banded = lambda n: F.when(n.isNull(), F.lower(g("severity"))).when(n <= 3.9, "low").when(n <= 6.9, "medium").when(n <= 8.9, "high").otherwise("very-high")
    score = g("severity").try_cast("double")
    purpose = F.split_part(kind, F.lit(":"), F.lit(1))
    lifted = {
        "category": purpose, "threat_purpose": purpose, "finding_type": kind, "finding_id": g("id"), "severity_score": score, "account_id": g("accountid"),
        "region": g("region"), "resource_type": g("resource.resourcetype"), "action_type": action_type, "domain": detail("domain"), "api": detail("api"),
    }
    return events(
        rows.withColumn("raw", _put(F.col("raw"), **{k: F.when(at(F.col("_top"), k).isNull(), v) for k, v in lifted.items()})), "aws", "guardduty",
        event_time=timestamp(g("updatedat", "service.eventlastseen", "createdat")),
        log_type=F.lit("threat"),
        severity=bind(score, banded),
        action=F.when(blocked == "true", "blocked").when(blocked == "false", "allowed").otherwise(F.replace(F.lower(action_type), F.lit("_"), F.lit("-"))),
        src_ip=F.when(out, F.col("_local")).otherwise(F.col("_remote")), dst_ip=F.when(out, F.col("_remote")).otherwise(F.col("_local")),
        src_port=F.when(out, F.col("_local_port")).otherwise(F.col("_remote_port")), dst_port=F.when(out, F.col("_remote_port")).otherwise(F.col("_local_port")),
        protocol=F.lower(detail("protocol")),
        app=F.coalesce(F.when(named != "unknown", named), F.lower(F.split_part(detail("serviceName"), F.lit("."), F.lit(1)))),
        user_name=g("resource.accesskeydetails.username", "resource.accesskeydetails.principalid"),
        host_name=F.coalesce(g("resource.instancedetails.instanceid"), inside("s3BucketDetails", "name"), g("resource.eksclusterdetails.name", "resource.rdsdbinstancedetails.dbinstanceidentifier", "accountid")),
        rule_name=kind,
        message=g("title", "description"),
    )


def aws_securityhub(rows: DataFrame) -> DataFrame:
    rows, g = with_flat(records(rows, "Findings", "findings"))
    weak = _items(F.col("raw"), "$.Vulnerabilities")
    resource = F.get(_items(F.col("raw"), "$.Resources"), 0)
    status = g("compliance.status")
    log_type = F.when(F.size(weak) > 0, "vulnerability").when(status.isNotNull(), "config").otherwise("threat")
    ids = F.transform(weak, lambda v: v["Id"])
    cve = F.coalesce(F.get(F.filter(ids, lambda i: i.rlike(r"(?i)^CVE-\d{4}-\d{4,}$")), 0), F.get(ids, 0))
    kind = F.coalesce(g("types"), g("findingproviderfields.types"))
    label = F.lower(g("severity.label", "findingproviderfields.severity.label"))
    score = to_long(g("severity.normalized", "findingproviderfields.severity.normalized"))
    control, object_ = g("compliance.securitycontrolid", "productfields.controlid"), F.try_element_at(resource, F.lit("Id"))
    workflow = g("workflow.status", "workflowstate")
    details = F.try_element_at(resource, F.lit("Details"))
    user = F.coalesce(*[F.get_json_object(details, p) for p in ("$.AwsIamAccessKey.PrincipalName", "$.AwsIamAccessKey.UserName", "$.AwsIamUser.UserName", "$.AwsIamRole.RoleName")])
    lifted = {
        "status": status, "object": object_, "category": F.split_part(kind, F.lit("/"), F.lit(1)), "cve": cve, "finding_type": kind, "control_id": control,
        "account_id": g("awsaccountid"), "resource_type": F.try_element_at(resource, F.lit("Type")), "severity_label": label, "workflow_status": workflow,
    }
    return events(
        rows.withColumn("raw", _put(F.col("raw"), **lifted)), "aws", "securityhub",
        event_time=timestamp(g("updatedat", "lastobservedat", "createdat", "firstobservedat")),
        log_type=log_type,
        severity=F.coalesce(label, _bands(score, [(90, "critical"), (70, "high"), (40, "medium"), (1, "low")], "informational")),
        action=F.lower(F.coalesce(status, workflow, g("recordstate"))),
        src_ip=g("network.sourceipv4", "network.sourceipv6"), dst_ip=g("network.destinationipv4", "network.destinationipv6"),
        src_port=g("network.sourceport"), dst_port=g("network.destinationport"),
        protocol=F.lower(g("network.protocol")),
        user_name=user,
        host_name=F.coalesce(object_, g("awsaccountid")),
        rule_name=F.coalesce(control, F.when(log_type == "threat", kind), g("title", "generatorid")),
        message=g("title", "description"),
    )


#: Providers of alerts and the log they stand for, then hints in order.
PROVIDERS = {
    "microsoftdefenderforendpoint": "endpoint", "microsoftdefenderforidentity": "identity", "microsoftdefenderforoffice365": "email",
    "microsoftdefenderforcloudapps": "cloud-apps", "microsoftdefenderforcloud": "cloud", "microsoftdefenderthreatintelligence": "xdr",
    "microsoft365defender": "xdr", "microsoftdefenderxdr": "xdr", "microsoftsentinel": "xdr", "azureadidentityprotection": "identity",
    "aadidentityprotection": "identity", "microsoftappgovernance": "cloud-apps", "datalossprevention": "dlp", "microsoftdatalossprevention": "dlp",
}
PROVIDER_HINTS = [
    ("office", "email"), ("exchange", "email"), ("email", "email"), ("identity", "identity"), ("cloudapp", "cloud-apps"), ("appgovernance", "cloud-apps"),
    ("dataloss", "dlp"), ("endpoint", "endpoint"), ("cloud", "cloud"), ("sentinel", "xdr"), ("xdr", "xdr"),
]
DISPOSITIONS = ("blocked", "prevented", "remediated", "quarantined", "cleaned", "detected", "allowed")


def defender_xdr(rows: DataFrame) -> DataFrame:
    """Alerts, and incidents followed by the alerts that are expanded in them, as events of their own."""
    rows = records(rows, "value")
    at = lambda m, key: F.try_element_at(m, F.lit(key))
    texts, empty = F.array().cast("array<string>"), F.array().cast("array<map<string,string>>")
    has = lambda *keys: F.coalesce(*[at(F.col("_top"), k) for k in keys]).isNotNull()
    incident = ~has("serviceSource", "evidence", "alertWebUrl", "providerAlertId") & has("incidentWebUrl", "displayName", "alerts")
    alerts = F.coalesce(F.from_json(at(F.col("_top"), "alerts"), "array<string>"), texts)
    inner = F.transform(alerts, lambda a: F.struct(a.alias("raw"), F.from_json(a, "map<string,string>").alias("_top")))
    rows = rows.withColumns({"incident": incident, "_inner": inner})
    shown = F.flatten(F.transform("_inner", lambda a: F.coalesce(_maps(at(a["_top"], "evidence")), empty)))
    one = lambda raw, top, first, seen: F.struct(raw.alias("raw"), top.alias("_top"), F.lit(first).alias("incident"), seen.alias("_shown"))
    # an incident has what its expanded alerts show, the first of them first
    own = F.when(F.col("incident"), one(F.col("raw"), F.col("_top"), True, shown)).otherwise(one(F.col("raw"), F.col("_top"), False, empty))
    expanded = F.when(F.col("incident"), F.transform("_inner", lambda a: one(a["raw"], a["_top"], False, empty))).otherwise(F.array().cast("array<struct<raw:string,_top:map<string,string>,incident:boolean,_shown:array<map<string,string>>>>"))
    rows = rows.select(F.explode(F.concat(F.array(own), expanded)).alias("x")).select("x.raw", "x._top", "x.incident", "x._shown")
    rows, g = with_flat(rows)
    rows = rows.withColumn("_own", F.coalesce(_maps(at(F.col("_top"), "evidence")), empty)).withColumn("_evidence", F.when(F.col("incident"), F.col("_shown")).otherwise(F.col("_own")))
    evidence = F.col("_evidence")

    def first_of(kind: str) -> Column:
        return F.get(F.filter(evidence, lambda e: F.lower(F.coalesce(at(e, "@odata.type"), F.lit(""))).contains(kind)), 0)

    def of(kind: str, *paths: str) -> Column:
        def test(one: Column, path: str) -> Column:
            head, _, rest = path.partition(".")
            scalar = lambda t: F.when(~t.rlike(r"^\s*[\[{]"), t)
            return when_set(F.get_json_object(at(one, head), f"$.{rest}") if rest else bind(at(one, head), scalar))

        return bind(first_of(kind), lambda one: F.coalesce(*[test(one, p) for p in paths]))

    outcomes = F.flatten(F.transform("_own", lambda e: F.array(*[F.lower(F.btrim(F.try_element_at(e, F.lit(k)))) for k in ("remediationStatus", "detectionStatus")])))
    outcomes = F.array_sort(F.filter(F.array_compact(outcomes), lambda o: ~o.isin(*_HIDDEN)))
    decisive = bind(outcomes, lambda o: F.coalesce(F.get(F.filter(F.array(*[F.lit(d) for d in DISPOSITIONS]), lambda d: F.array_contains(o, d)), 0), F.get(o, 0)))
    provider = F.regexp_replace(F.lower(g("servicesource", "detectionsource")), r"[ _]", "")
    hinted = reduce(lambda acc, h: acc.when(provider.contains(h[0]), h[1]), PROVIDER_HINTS[1:], F.when(provider.contains(PROVIDER_HINTS[0][0]), PROVIDER_HINTS[0][1]))
    log_type = F.when(F.col("incident"), "incident").otherwise(F.coalesce(lookup(PROVIDERS, provider), hinted, F.lit("alert")))
    hide = lambda c: F.when(~F.lower(c).isin(*_HIDDEN), F.lower(c))
    sender = of("analyzedmessage", "p2Sender.emailAddress", "p1Sender.emailAddress", "p2Sender", "p1Sender", "senderFromAddress")
    recipient = F.coalesce(of("analyzedmessage", "recipientEmailAddress"), of("mailbox", "primaryAddress", "upn"))

    def path_of(item: Column) -> Column:
        """Folder and name of a file's details."""
        folder, name = when_set(F.get_json_object(item, "$.filePath")), when_set(F.get_json_object(item, "$.fileName"))
        gap = F.when(folder.rlike(r"[\\/]$"), "").otherwise("\\")
        return F.when(folder.isNotNull() & name.isNotNull(), F.concat(folder, gap, name)).otherwise(F.coalesce(name, folder))

    def part_of(kind: str, key: str) -> Column:
        return at(first_of(kind), key)

    def label(account: Column) -> Column:
        """A principal name, or a name behind its domain."""

        def read(m: Column) -> Column:
            found_ = lambda *keys: F.coalesce(*[when_set(at(m, k)) for k in keys])
            name, domain = found_("accountName", "displayName"), found_("domainName")
            return F.coalesce(found_("userPrincipalName", "upn"), F.when(domain.isNotNull(), F.concat(domain, F.lit("\\"), name)), name)

        return bind(_map(account), lambda m: F.when(m.isNotNull(), read(m)))

    accounts = lambda items: F.get(F.filter(F.transform(items, lambda e: label(F.try_element_at(e, F.lit("userAccount")))), lambda x: x.isNotNull()), 0)
    registry = F.concat_ws("\\", *[of("registry", k) for k in ("registryHive", "registryKey", "registryValueName")])
    address, sent_from = of("ipevidence", "ipAddress"), of("analyzedmessage", "senderIp")
    lifted = {
        "CommandLine": of("processevidence", "processCommandLine"), "FileName": F.coalesce(of("fileevidence", "fileDetails.fileName"), of("processevidence", "imageFile.fileName")),
        "FilePath": path_of(part_of("fileevidence", "fileDetails")), "Image": path_of(part_of("processevidence", "imageFile")),
        "SHA256": F.coalesce(of("fileevidence", "fileDetails.sha256"), of("processevidence", "imageFile.sha256")),
        "SHA1": F.coalesce(of("fileevidence", "fileDetails.sha1"), of("processevidence", "imageFile.sha1")),
        "ProcessId": of("processevidence", "processId"), "ParentProcessId": of("processevidence", "parentProcessId"), "ParentImage": path_of(part_of("processevidence", "parentProcessImageFile")),
        "DeviceName": of("deviceevidence", "deviceDnsName", "hostName"), "DeviceId": of("deviceevidence", "mdeDeviceId", "azureAdDeviceId"), "OsPlatform": of("deviceevidence", "osPlatform"),
        "AccountName": accounts(evidence), "TargetObject": when_set(registry), "RegistryValue": of("registry", "registryValue"), "Url": of("urlevidence", "url"),
        "IpAddress": address, "subject": of("analyzedmessage", "subject"), "sender": sender, "recipient": recipient, "SenderIp": sent_from, "NetworkMessageId": of("analyzedmessage", "networkMessageId"),
        "mitre_techniques": F.array_join(F.from_json(at(F.col("_top"), "mitreTechniques"), "array<string>"), ","), "threat": g("threatdisplayname", "threatfamilyname"),
    }
    user = F.coalesce(accounts(F.col("_own")), lifted["AccountName"], recipient)
    title = g("title", "description")
    threat = g("threatdisplayname", "threatfamilyname")
    return events(
        rows.withColumn("raw", _put(F.col("raw"), **{k: F.when(at(F.col("_top"), k).isNull(), v) for k, v in lifted.items()})), "microsoft", "defender",
        event_time=timestamp(g("firstactivitydatetime", "createddatetime", "lastupdatedatetime")),
        log_type=log_type,
        severity=hide(g("severity")),
        action=F.coalesce(decisive, hide(g("status"))),
        src_ip=F.coalesce(address, sent_from),
        user_name=user,
        host_name=of("deviceevidence", "deviceDnsName", "hostName"),
        rule_name=g("title", "displayname"),
        message=F.when(F.col("incident"), _result(g("displayname", "title"), hide(g("classification")))).otherwise(_noted(title, threat)),
    )


_ENVELOPE = r"^(?:<\d{1,3}>)?(?:\d{1,2}\s+)?(\d{4}-\d\d-\d\dT\S+|[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(.*)$"


def _syslog_json(rows: DataFrame) -> DataFrame:
    """JSON behind an optional syslog header: raw, sent, from_host."""
    line = F.btrim("value", F.lit(" \t\r\n"))
    body = F.regexp_extract(line, r"(\{.*\})\s*$", 1)
    return rows.select(body.alias("raw"), found(line, _ENVELOPE, 1).alias("sent"), found(line, _ENVELOPE, 2).alias("from_host")).where(F.col("raw").startswith("{"))


def nutanix_files(rows: DataFrame) -> DataFrame:
    rows, g = with_flat(_syslog_json(rows))
    operation = g("operation", "audit_type", "event_type", "operationtype", "file_operation", "optype", "action")
    kind = g("alerttype", "anomalytype", "threattype", "detectiontype")
    ransom = F.coalesce(F.lower(F.concat_ws(" ", kind, g("category"))).contains("ransom"), F.lit(False)) | (operation.isNull() & kind.isNotNull())
    path = g("objectname", "object_name", "object", "objectpath", "path", "filepath", "file_path", "name", "target")
    old = g("oldobjectname", "old_object_name", "oldpath", "oldname", "sourcepath", "previouspath", "from")
    user = g("username", "user_name", "userwithdomain", "user", "actor", "principal", "account")
    share = F.coalesce(g("sharename", "share_name", "share", "exportname", "export", "sharepath"), F.lit("nutanix-files"))
    protocol, status = g("protocoltype", "protocol_type", "protocol", "proto", "accessprotocol"), g("status", "result", "operationstatus", "operation_status")
    spelled = F.regexp_replace(F.lower(operation), r"[\s_]+", "-")
    verb = (
        F.when(spelled.contains("rename"), "rename").when(spelled.contains("delete") | spelled.contains("remove"), "delete").when(spelled.contains("create") | spelled.contains("mkdir"), "create")
        .when(spelled.contains("write"), "write").when(spelled.contains("read"), "read").when(spelled.rlike("permission|security|acl"), "permission-change").otherwise(spelled)
    )
    body = F.when((verb == "rename") & old.isNotNull(), F.concat(F.lit("renamed "), old, F.lit(" -> "), path)).otherwise(F.concat_ws(" ", verb, path))
    said = F.concat_ws(" ", user, body, F.concat(F.lit("["), status, F.lit("]")), F.concat(F.lit("via "), protocol))
    count = g("affectedfiles", "affectedfilecount", "filecount", "impactedfiles")
    alarm = F.concat_ws(" ", F.lit("Data Lens ransomware/anomaly alert"), g("message", "description", "details", "reason", "alerttype", "anomalytype"), F.concat(F.lit("("), count, F.lit(" files affected)")))
    denied = F.coalesce(F.lower(status).rlike("den|fail|unauthor|forbid"), F.lit(False))
    return events(
        rows, "nutanix", F.when(ransom, "data-lens").otherwise("files"),
        event_time=timestamp(F.coalesce(g("audittimestampusecs", "eventtimeusecs", "eventtimestamp", "audit_timestamp", "operationdate", "timestamp", "time"), F.col("sent"))),
        log_type=F.when(ransom, "ransomware-alert").otherwise("file-audit"),
        severity=F.when(ransom, "critical").when(denied, "warning").otherwise("informational"),
        action=F.when(ransom, "ransomware").otherwise(verb),
        src_ip=g("clientip", "client_ip", "ipaddress", "sourceip", "remoteip"),
        protocol=F.when(~ransom, F.lower(protocol)),
        app=share,
        user_name=user,
        host_name=F.coalesce(g("fileservername", "fileserver", "file_server", "server", "fsvm", "hostname", "host"), F.col("from_host")),
        rule_name=path,
        message=F.substring(F.when(ransom, alarm).otherwise(said), 1, 2000),
    )


def nutanix_pc(rows: DataFrame) -> DataFrame:
    """Audit JSON, API audits (k=v joined by ||) and flow lines (K=V), told apart by tag or shape; the rest is syslog."""
    line = F.btrim("value", F.lit(" \t\r\n"))
    rows = rows.select(line.alias("value")).where(F.length("value") > 0)
    rows = rows.withColumns({"sent": found(F.col("value"), _ENVELOPE, 1), "from_host": found(F.col("value"), _ENVELOPE, 2)})
    v = F.col("value")
    audit, api = v.rlike(r"\{.*\}\s*$"), v.contains("||") & v.contains("=")
    flow = ~audit & ~api & v.rlike(r"\bSRC=\S+.*\bDST=\S+")
    first, g = with_flat(rows.where(audit).withColumn("raw", F.regexp_extract("value", r"(\{.*\})\s*$", 1)))
    entity = F.get(_items(F.col("raw"), "$.affectedEntityList", "$.affected_entity_list"), 0)
    target = F.when(F.size(F.map_keys(entity)) > 0, F.concat_ws(":", F.coalesce(entity["entityType"], entity["entity_type"], entity["type"]), F.coalesce(entity["name"], entity["uuid"])))
    kind = F.lower(g("recordtype", "record_type", "type"))
    a = events(
        first, "nutanix", "prism-central",
        event_time=timestamp(F.coalesce(g("creationtimestampusecs", "creation_timestamp_usecs", "operationstarttimeusecs", "timestamp"), F.col("sent"))),
        log_type=F.when(kind.contains("login"), "authentication").otherwise("audit"),
        severity=F.lower(g("severity")),
        action=g("operationtype", "operation_type", "operation"),
        src_ip=g("clientip", "client_ip", "sessionipaddress", "ip"),
        user_name=g("username", "user_name", "user"),
        host_name=F.coalesce(g("clustername", "cluster_name"), F.col("from_host")),
        rule_name=target,
        message=F.coalesce(g("defaultmsg", "default_msg", "message"), F.concat_ws(" ", g("operationtype", "operation_type"), target)),
    )
    second = rows.where(api).withColumn("_m", F.expr(r"str_to_map(regexp_replace(regexp_extract(value, '([A-Za-z_]+=.*)$', 1), '\\s*\\|\\|\\s*', '\u001f'), '\u001f', '=')")).withColumn("raw", F.to_json("_m"))
    k = lambda *names: F.coalesce(*[when_set(F.try_element_at("_m", F.lit(n))) for n in names])
    b = events(
        second, "nutanix", "prism-central",
        event_time=timestamp(F.coalesce(k("time", "timestamp"), F.col("sent"))),
        log_type=F.lit("api_audit"),
        action=k("httpMethod"),
        src_ip=k("clientIp", "clientIP", "sourceIp"),
        user_name=k("userName", "username", "user"),
        host_name=F.col("from_host"),
        rule_name=k("restEndpoint"),
        message=F.concat_ws(" ", k("httpMethod"), k("restEndpoint")),
    )
    pairs = r"\b([A-Z][A-Z_]+)=(\S+)"
    third = rows.where(flow).withColumn("_m", F.map_from_arrays(F.array_distinct(F.regexp_extract_all("value", F.lit(pairs), F.lit(1))), F.slice(F.regexp_extract_all("value", F.lit(pairs), F.lit(2)), 1, F.size(F.array_distinct(F.regexp_extract_all("value", F.lit(pairs), F.lit(1)))))))
    third = third.withColumn("raw", F.to_json("_m"))
    octets = [to_long(k("ORIG")), to_long(k("REPLY"))]
    c = events(
        third, "nutanix", "prism-central",
        event_time=timestamp(F.col("sent")),
        log_type=F.lit("flow"),
        action=F.lower(k("ACTION", "STATUS")),
        src_ip=k("SRC"), dst_ip=k("DST"), src_port=k("SPORT"), dst_port=k("DPORT"),
        protocol=F.lower(k("PROTO")),
        host_name=F.col("from_host"),
        rule_name=k("POLICY", "RULE"),
        bytes_total=F.when(F.coalesce(*octets).isNotNull(), sum((F.coalesce(o, F.lit(0)) for o in octets), F.lit(0))),
        message=F.col("value"),
    )
    rest = rows.where(~audit & ~api & ~flow)
    p = syslog_parts(F.col("value"))
    d = events(rest.withColumn("raw", F.to_json(F.struct(F.col("value").alias("line")))), "nutanix", "prism-central", event_time=timestamp(p["timestamp"]), log_type=p["facility"], severity=p["severity"], host_name=p["host"], app=p["app"], message=p["message"])
    return a.unionByName(b).unionByName(c).unionByName(d)


# -- vulnerability scanners ------------------------------------------------------------------------------------------

#: States of findings in one vocabulary.
STATES = {"open": "open", "active": "open", "new": "open", "vulnerable": "open", "vulnerable-exploited": "open", "vulnerable-version": "open", "re-opened": "reopened", "reopened": "reopened", "resurfaced": "reopened", "fixed": "fixed", "remediated": "fixed", "not-vulnerable": "fixed", "potential": "potential", "vulnerable-potential": "potential"}


def cvss_severity(score: Column) -> Column:
    """The band of a base score that the text starts with; null outside 0 to 10."""
    n = F.regexp_extract(score, r"^\s*(-?\d+(?:\.\d+)?)", 1).try_cast("double")
    return _bands(bind(n, lambda n: F.when(n.between(0, 10), n)), [(9.0, "critical"), (7.0, "high"), (4.0, "medium"), (0.1, "low")], "informational")


def cves(*sources: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(F.concat_ws(" ", *sources), F.lit(r"(?i)CVE-\d{4}-\d{4,7}"), F.lit(0)), F.upper))


def _cve_keys(found_: Column) -> dict[str, Column]:
    return {"cve": when_set(F.array_join(found_, ",")), "cve_id": F.get(found_, 0)}


def _port(value: Column) -> Column:
    p = to_port(value)
    return F.when(p > 0, p)


def tenable(rows: DataFrame) -> DataFrame:
    rows, g = with_flat(records(rows, "vulnerabilities", "findings", "data"))
    score, state = g("plugin.cvss3_base_score", "plugin.cvss_base_score"), F.lower(g("state"))
    own = lookup({"info": "informational", "none": "informational"}, F.lower(g("severity")), F.lower(g("severity")))
    family = g("plugin.family")
    keys = _cve_keys(cves(F.get_json_object("raw", "$.plugin.cve"), F.get_json_object("raw", "$.plugin.cves")))
    keys |= {"category": family, "plugin_family": family, "cvss": score.try_cast("double"), "plugin_id": g("plugin.id")}
    return events(
        rows.withColumn("raw", _put(F.col("raw"), **keys)), "tenable", "tenable_io",
        event_time=timestamp(g("last_found", "indexed", "scan.started_at", "first_found")),
        log_type=F.lit("vulnerability"),
        severity=F.coalesce(cvss_severity(score), own),
        action=lookup(STATES, state, state),
        dst_ip=g("asset.ipv4", "asset.ipv6"),
        dst_port=_port(g("port.port")),
        protocol=F.lower(g("port.protocol")),
        host_name=g("asset.fqdn", "asset.hostname", "asset.netbios_name", "asset.ipv4", "asset.uuid"),
        rule_name=g("plugin.name", "plugin.synopsis"),
        message=g("plugin.name", "plugin.synopsis", "plugin.description"),
    )


def rapid7(rows: DataFrame) -> DataFrame:
    rows, get = with_flat(records(rows, "resources", "data", "vulnerabilities"))

    def g(*names: str) -> Column:
        return F.coalesce(*[get(f"finding.{n}", f"vulnerability.{n}", n) for n in names])

    result = F.get(_items(F.col("raw"), "$.finding.results", "$.results"), 0)
    score = g("cvss.v3.score", "cvss.v2.score", "cvssv3score", "cvss_v3_score", "cvssscore", "cvss_score")
    # scores nested four levels deep lie below the flat map
    score = F.coalesce(score, *[F.get_json_object("raw", p) for p in ("$.vulnerability.cvss.v3.score", "$.vulnerability.cvss.v2.score")])
    status = F.lower(F.coalesce(g("status"), F.try_element_at(result, F.lit("status"))))
    ident = F.coalesce(get("vulnerability.id"), g("id"))
    own = lookup({"severe": "high", "moderate": "medium", "info": "informational"}, F.lower(get("vulnerability.severity", "severity")), F.lower(get("vulnerability.severity", "severity")))
    listed = F.coalesce(F.get_json_object("raw", "$.vulnerability.categories"), F.get_json_object("raw", "$.categories"))
    category = F.coalesce(F.array_join(F.from_json(listed, "array<string>"), ", "), listed)
    keys = _cve_keys(cves(F.get_json_object("raw", "$.vulnerability.cves"), F.get_json_object("raw", "$.cves"), ident)) | {"category": when_set(category), "cvss": score.try_cast("double"), "vuln_id": ident}
    return events(
        rows.withColumn("raw", _put(F.col("raw"), **keys)), "rapid7", "insightvm",
        event_time=timestamp(F.coalesce(get("finding.since", "since", "asset.lastscanend", "asset.last_scan_end"), g("modified", "published"))),
        log_type=F.lit("vulnerability"),
        severity=F.coalesce(cvss_severity(score), own),
        action=lookup(STATES, status, status),
        dst_ip=get("asset.ip", "ip"),
        dst_port=_port(F.try_element_at(result, F.lit("port"))),
        protocol=F.lower(F.try_element_at(result, F.lit("protocol"))),
        host_name=get("asset.hostname", "asset.host_name", "asset.ip", "ip"),
        rule_name=F.coalesce(g("title"), ident),
        message=F.coalesce(g("title"), ident),
    )


_QUALYS_LEVELS = {1: "informational", 2: "low", 3: "medium", 4: "high", 5: "critical"}


def qualys(rows: DataFrame) -> DataFrame:
    """Hosts and their detections in XML, one document a row. Documents with a document type declaration are refused."""
    docs = rows.where(~F.col("value").rlike(r"(?i)<!DOCTYPE[^>]*\[|<!ENTITY"))
    hosts = docs.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<HOST>(.*?)</HOST>"), F.lit(1))).alias("h"))
    rows = hosts.select(F.regexp_replace("h", r"(?s)<DETECTION_LIST>.*</DETECTION_LIST>", "").alias("h"), F.explode(F.regexp_extract_all("h", F.lit(r"(?s)<DETECTION>(.*?)</DETECTION>"), F.lit(1))).alias("d"))

    def tag(part: str, *names: str) -> Column:
        out = []
        for n in names:
            text = F.regexp_extract(part, rf"(?s)<{n}>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{n}>", 1)
            out.append(when_set(F.replace(F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))))
        return F.coalesce(*out)

    score = tag("d", "CVSS3_BASE", "CVSS_BASE", "CVSS3_SCORE", "CVSS_SCORE")
    qid, title, status = tag("d", "QID"), tag("d", "VULN_TITLE", "TITLE"), F.lower(tag("d", "STATUS"))
    cve = _cve_keys(cves(F.col("d")))
    number = F.regexp_extract(score, r"^\s*(\d+(?:\.\d+)?)", 1).try_cast("double")
    names = {"qid": "QID", "type": "TYPE", "severity": "SEVERITY", "port": "PORT", "protocol": "PROTOCOL", "results": "RESULTS", "status": "STATUS", "title": "TITLE", "category": "CATEGORY", "first_found_datetime": "FIRST_FOUND_DATETIME", "last_found_datetime": "LAST_FOUND_DATETIME"}
    raw = F.struct(*[tag("d", t).alias(k) for k, t in names.items()], tag("h", "ID").alias("host_id"), tag("h", "IP").alias("ip"), tag("h", "DNS").alias("dns"), tag("h", "OS").alias("os"), cve["cve"].alias("cve"), cve["cve_id"].alias("cve_id"), number.alias("cvss"))
    return events(
        rows.withColumn("raw", F.to_json(raw)), "qualys", "vmdr",
        event_time=timestamp(F.coalesce(tag("d", "LAST_FOUND_DATETIME", "LAST_PROCESSED_DATETIME"), tag("h", "LAST_SCAN_DATETIME"), tag("d", "FIRST_FOUND_DATETIME"))),
        log_type=F.lit("vulnerability"),
        severity=F.coalesce(cvss_severity(score), lookup(_QUALYS_LEVELS, to_long(tag("d", "SEVERITY")).cast("int"))),
        action=lookup(STATES, status, status),
        dst_ip=tag("h", "IP"),
        dst_port=_port(tag("d", "PORT")),
        protocol=F.lower(tag("d", "PROTOCOL")),
        host_name=tag("h", "DNS", "NETBIOS", "IP", "ID"),
        rule_name=F.coalesce(title, F.concat(F.lit("QID "), qid)),
        message=F.when(title.isNotNull() & qid.isNotNull(), F.concat(F.lit("QID "), qid, F.lit(": "), title)).otherwise(F.coalesce(title, F.concat(F.lit("QID "), qid))),
    )
