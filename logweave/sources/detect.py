"""Format sniffing over a sample of a file's text, on the driver, and the registry of parsers."""

from __future__ import annotations

import json
import re

from logweave.sources import json_formats as j
from logweave.sources import line_formats as t
from logweave.sources import scanner_formats as s
from logweave.sources import zeek as z

SAMPLE_CHARS = 16_384

#: Formats that read rows with the column value; header CSVs (paloalto_csv, crowdstrike_csv) read their own columns.
PARSERS = {
    "generic_json": j.generic_json, "aws_cloudtrail": j.aws_cloudtrail, "azure_activity": j.azure_activity, "entra_signin": j.entra_signin,
    "gcp_audit": j.gcp_audit, "github_audit": j.github_audit, "gitlab_audit": j.gitlab_audit, "m365_audit": j.m365_audit,
    "okta_system_log": j.okta_system_log, "netflow": j.netflow, "crowdstrike_json": j.crowdstrike_json, "suricata_eve": j.suricata_eve,
    "windows_security": j.windows_security, "sysmon": j.sysmon, "zeek_json": j.zeek_json, "zeek_tsv": z.zeek_tsv,
    "fortinet_fortigate": t.fortinet_fortigate, "linux_auditd": t.linux_auditd, "web_access": t.web_access, "cef": t.cef, "leef": t.leef,
    "cisco_asa": t.cisco_asa, "cisco_ftd": t.cisco_ftd, "cisco_ios": t.cisco_ios, "generic_syslog": t.generic_syslog, "meraki": t.meraki,
    "paloalto_syslog": t.paloalto_syslog, "paloalto_csv": t.paloalto_csv, "crowdstrike_csv": t.crowdstrike_csv,
    "aws_guardduty": s.aws_guardduty, "aws_securityhub": s.aws_securityhub, "defender_xdr": s.defender_xdr, "nutanix_files": s.nutanix_files,
    "nutanix_pc": s.nutanix_pc, "qualys": s.qualys, "tenable": s.tenable, "rapid7": s.rapid7,
}

#: Patterns in order; the first that is found in the sample names the format.
TEXT_SIGNS = [
    (r"(?i)CEF:\s*\d+\s*\|", "cef"),
    (r"(?i)LEEF:\s*\d", "leef"),
    (r"(?m)^#separator|^#fields\t", "zeek_tsv"),
    (r"%(?:FTD|NGIPS)-(?:[\w-]*-)?\d-43000[1-5]:|SFIMS", "cisco_ftd"),
    (r"(?i)%(?:ASA|FTD|ASASM|FWSM|PIX)-\d-\d+:", "cisco_asa"),
    (r"%[A-Z][A-Z0-9_]*-\d-[A-Z_][A-Z0-9_]*:", "cisco_ios"),
    (r"type=\S+\s+msg=audit\(", "linux_auditd"),
    (r"(?s)devname=.*logid=|logid=.*devname=", "fortinet_fortigate"),
    (r"(?i)<HOST_LIST_VM_DETECTION_OUTPUT|<HOST_LIST>|<DETECTION_LIST>", "qualys"),
    (r"(?m),(?:TRAFFIC|THREAT|SYSTEM|CONFIG|GLOBALPROTECT|DECRYPTION|AUTHENTICATION),", "paloalto_syslog"),
    (r"(?i)consolidated_audit|api_audit|\bSRC=\S+ DST=\S+.* ORIG=", "nutanix_pc"),
    (r"(?i)<\d{1,3}>.*\"(?:audit_event|object_name|share_name)\"", "nutanix_files"),
    (r"(?m)^(?:<\d{1,3}>)?\d+\s+\S+\s+\S+\s+(?:flows|urls|ids-alerts|events|security_event|firewall)\s", "meraki"),
    (r'(?m)^\S+ \S+ \S+ \[[^\]]+\] "[A-Z]+ [^"]*" \d{3} ', "web_access"),
    (r"(?m)^<\d{1,3}>", "generic_syslog"),
]
#: Keys that a JSON record of a format has, in order: the first set that is wholly there names it.
JSON_SIGNS = [
    ({"eventSource", "eventName"}, "aws_cloudtrail"),
    ({"SchemaVersion", "ProductArn"}, "aws_securityhub"),
    ({"schemaVersion", "service", "severity", "type"}, "aws_guardduty"),
    ({"serviceSource"}, "defender_xdr"),
    ({"incidentWebUrl"}, "defender_xdr"),
    ({"operationName", "resourceId"}, "azure_activity"),
    ({"userPrincipalName", "appDisplayName"}, "entra_signin"),
    ({"protoPayload"}, "gcp_audit"),
    ({"AuditData"}, "m365_audit"),
    ({"Operation", "Workload"}, "m365_audit"),
    ({"eventType", "published"}, "okta_system_log"),
    ({"actor", "action", "@timestamp"}, "github_audit"),
    ({"entity_type", "details"}, "gitlab_audit"),
    ({"flow_version"}, "netflow"),
    ({"event_type", "flow_id"}, "suricata_eve"),
    ({"event_type", "src_ip", "dest_ip"}, "suricata_eve"),
    ({"event_simpleName"}, "crowdstrike_json"),
    ({"metadata", "event"}, "crowdstrike_json"),
    ({"id.orig_h"}, "zeek_json"),
    ({"plugin", "asset"}, "tenable"),
    ({"vulnerabilities", "ip"}, "rapid7"),
    ({"ProviderName", "Message"}, "windows_security"),
]
CSV_SIGNS = [({"receive time", "source address"}, "paloalto_csv"), ({"detectname"}, "crowdstrike_csv"), ({"hostname", "tactic"}, "crowdstrike_csv"), ({"timecreated", "message"}, "windows_security")]
WRAPPERS = ("Records", "records", "value", "entries", "events", "resources", "Findings", "findings", "data", "logs", "flows")


def _first_record(text: str) -> dict | None:
    try:
        found = json.JSONDecoder().raw_decode(text)[0]
    except ValueError:
        # a sample may end within a long array: the first object of it will do
        m = re.search(r"\{", text[1:])
        if not m:
            return None
        try:
            found = json.JSONDecoder().raw_decode(text[1 + m.start() :])[0]
        except ValueError:
            return None
    if isinstance(found, list):
        found = found[0] if found else None
    for w in WRAPPERS:
        if isinstance(found, dict) and isinstance(found.get(w), list) and found[w] and isinstance(found[w][0], dict):
            return found[w][0]
    return found if isinstance(found, dict) else None


def sniff(text: str) -> str:
    """The format of a sample; generic_syslog if nothing tells."""
    sample = text[:SAMPLE_CHARS].lstrip("﻿ \t\r\n")
    if sample[:1] in "{[" and sample:
        record = _first_record(sample)
        if record is not None:
            if "Sysmon" in str(record.get("ProviderName", "")) + str(record.get("LogName", "")):
                return "sysmon"
            for keys, name in JSON_SIGNS:
                if keys <= set(record):
                    return name
            return "generic_json"
    for pattern, name in TEXT_SIGNS:
        if re.search(pattern, sample):
            return name
    header = {h.strip().strip('"').lower() for h in sample.split("\n", 1)[0].split(",")}
    for keys, name in CSV_SIGNS:
        if keys <= header:
            return name
    return "generic_syslog"
