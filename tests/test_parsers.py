"""One record of each format, with the fields that it must give."""

import json

import pytest

from logweave.sources.detect import PARSERS, sniff
from logweave.sources.event import EVENT_SCHEMA

J = json.dumps
CASES = {
    "generic_json": (J({"@timestamp": "2024-01-02T03:04:05Z", "source": {"ip": "10.0.0.1", "port": 5}, "event": {"action": "go", "category": ["a", "b"]}, "user": {"name": "ann"}}), {"vendor": "json", "src_ip": "10.0.0.1", "src_port": 5, "action": "go", "log_type": "a", "user_name": "ann"}),
    "aws_cloudtrail": (J({"Records": [{"eventTime": "2024-01-02T03:04:05Z", "eventSource": "iam.amazonaws.com", "eventName": "CreateUser", "sourceIPAddress": "1.2.3.4", "userIdentity": {"arn": "arn:x"}, "errorCode": "Denied"}]}), {"log_type": "iam", "action": "failed", "user_name": "arn:x", "rule_name": "CreateUser", "src_ip": "1.2.3.4"}),
    "azure_activity": (J({"records": [{"time": "2024-01-02T03:04:05Z", "operationName": {"value": "VM/write"}, "resultType": "Success", "callerIpAddress": "1.2.3.4", "identity": {"claims": {"name": "ann"}}, "level": "Information", "resourceId": "/x", "category": "Administrative"}]}), {"action": "VM/write", "message": "VM/write (Success)", "severity": "informational", "user_name": "ann", "log_type": "administrative"}),
    "entra_signin": (J([{"createdDateTime": "2024-01-02T03:04:05Z", "userPrincipalName": "a@x", "appDisplayName": "Mail", "ipAddress": "1.2.3.4", "status": {"errorCode": 50126, "failureReason": "Bad password"}, "riskLevelDuringSignIn": "high"}]), {"action": "failure", "log_type": "signin", "severity": "high", "message": "Sign-in to Mail — Bad password"}),
    "gcp_audit": (J({"timestamp": "2024-01-02T03:04:05Z", "severity": "NOTICE", "protoPayload": {"methodName": "v1.delete", "serviceName": "compute", "authenticationInfo": {"principalEmail": "a@x"}, "requestMetadata": {"callerIp": "1.2.3.4"}, "resourceName": "r"}}), {"action": "v1.delete", "src_ip": "1.2.3.4", "user_name": "a@x", "severity": "notice"}),
    "github_audit": (J({"@timestamp": 1704164645000, "action": "repo.destroy", "actor": "ann", "actor_ip": "1.2.3.4", "repo": "o/r"}), {"log_type": "repo", "message": "repo.destroy on o/r", "rule_name": "o/r"}),
    "gitlab_audit": (J({"created_at": "2024-01-02T03:04:05Z", "entity_type": "Project", "details": {"add": "user_access", "author_name": "ann", "ip_address": "1.2.3.4", "target_details": "bob"}}), {"action": "add user_access", "message": "add user_access — bob", "log_type": "project"}),
    "m365_audit": (J({"Identity": "x", "AuditData": J({"CreationTime": "2024-01-02T03:04:05", "Operation": "UserLoggedIn", "Workload": "AzureAD", "ClientIP": "1.2.3.4:99", "UserId": "a@x", "ResultStatus": "Success"})}), {"action": "UserLoggedIn", "src_ip": "1.2.3.4", "src_port": 99, "message": "UserLoggedIn (Success)", "log_type": "azuread"}),
    "okta_system_log": (J({"published": "2024-01-02T03:04:05Z", "eventType": "user.session.start", "severity": "WARN", "displayMessage": "Login", "outcome": {"result": "FAILURE", "reason": "BAD"}, "actor": {"alternateId": "a@x"}, "client": {"ipAddress": "1.2.3.4"}, "target": [{"type": "AppInstance", "displayName": "App"}]}), {"action": "failure", "severity": "warning", "message": "Login — BAD", "app": "App"}),
    "netflow": (J({"flows": [{"flow_version": "IPFIX", "src_ip": "10.0.0.1", "dst_ip": "10.0.0.2", "src_port": 1, "dst_port": 70000, "protocol_number": 89, "bytes": 5, "out_bytes": 6, "packets": 2, "end_time": 1704164645}]}), {"product": "ipfix", "protocol": "89", "bytes_total": 11, "dst_port": None, "message": "89 10.0.0.1:1 -> 10.0.0.2:70000 2 pkts 11 bytes"}),
    "crowdstrike_json": (J({"metadata": {"eventType": "DetectionSummaryEvent"}, "event": {"DetectName": "Bad", "SeverityName": "High", "ComputerName": "pc", "UserName": "ann", "LocalIP": "10.0.0.1", "Tactic": "Execution"}}), {"log_type": "detection", "host_name": "pc", "rule_name": "Execution", "message": "Bad"}),
    "suricata_eve": (J({"timestamp": "2024-01-02T03:04:05+0000", "flow_id": 1, "event_type": "alert", "src_ip": "1.2.3.4", "dest_ip": "5.6.7.8", "proto": "TCP", "alert": {"signature": "ET X", "severity": 1, "action": "blocked"}}), {"severity": "high", "action": "blocked", "message": "ET X", "protocol": "tcp"}),
    "windows_security": (J({"Id": 4625, "ProviderName": "p", "MachineName": "pc", "Message": "An account failed.\r\nSubject:\r\n\tAccount Name:\t-\r\nTarget:\r\n\tAccount Name:\tann\r\n\tAccount Domain:\tCORP\r\n\tSource Network Address:\t10.0.0.9"}), {"action": "failed-logon", "user_name": "CORP\\ann", "src_ip": "10.0.0.9", "rule_name": "Event 4625", "message": "An account failed."}),
    "sysmon": (J({"Id": 3, "ProviderName": "Microsoft-Windows-Sysmon", "Message": "Network connection:\r\nUtcTime: 2024-01-02 03:04:05.000\r\nImage: C:\\x.exe\r\nUser: CORP\\ann\r\nProtocol: TCP\r\nSourceIp: 10.0.0.1\r\nDestinationIp: 8.8.8.8\r\nDestinationPort: 443"}), {"log_type": "network-connect", "dst_ip": "8.8.8.8", "dst_port": 443, "message": "C:\\x.exe -> 8.8.8.8:443", "user_name": "CORP\\ann"}),
    "zeek_json": (J({"_path": "dns", "ts": 1704164645.5, "uid": "C1", "id.orig_h": "10.0.0.1", "id.resp_h": "10.0.0.2", "id.orig_p": 5, "id.resp_p": 53, "proto": "udp", "query": "x.org", "qtype_name": "A", "rcode_name": "NOERROR"}), {"log_type": "dns", "action": "NOERROR", "message": "DNS A x.org", "rule_name": "C1"}),
    "zeek_tsv": ("#separator \\x09\n#unset_field\t-\n#path\tmodbus\n#fields\tts\tuid\tid.orig_h\tid.orig_p\tid.resp_h\tid.resp_p\tfunc\n1704164645.1\tC2\t10.0.0.1\t5\t10.0.0.2\t502\tWRITE_MULTIPLE_REGISTERS\n#path\tconn\n#fields\tts\tproto\tconn_state\n1704164646\ttcp\t-", {"log_type": "modbus", "action": "write-registers", "dst_port": 502}),
    "fortinet_fortigate": ('date=2024-01-02 time=03:04:05 devname="f w" logid="1" type="traffic" subtype="forward" proto=17 srcip=10.0.0.1 sentbyte=5 msg="a b"', {"protocol": "udp", "bytes_total": 5, "host_name": "f w", "message": "a b"}),
    "linux_auditd": ("type=EXECVE msg=audit(1704164645.123:45): argc=2 a0=\"curl\" a1=\"-O\" key=\"exec\"", {"action": "process-create", "message": "curl -O", "rule_name": "exec", "log_type": "execve"}),
    "web_access": ('1.2.3.4 - ann [02/Jan/2024:03:04:05 +0000] "GET /a HTTP/1.1" 404 12 "-" "curl"', {"action": "GET", "severity": "warning", "user_name": "ann", "bytes_total": 12}),
    "cef": ("<1>Jan 2 03:04:05 h CEF:0|A\\|B|P|1|77|Name|9|src=1.2.3.4 act=block msg=x y\\=z suser=ann", {"vendor": "a|b", "severity": "very-high", "message": "x y=z", "action": "block"}),
    "leef": ("<13>Jan  2 03:04:05 host1 LEEF:2.0|V|P|1|ev|x5E|src=1.2.3.4^usrName=ann^sev=5^cat=Authentication", {"vendor": "v", "severity": "medium", "user_name": "ann", "log_type": "authentication", "host_name": "host1"}),
    "cisco_asa": ("<166>Jan 02 2024 03:04:05 fw1 : %ASA-6-302013: Built outbound TCP connection 1 for outside:8.8.8.8/443 (8.8.8.8/443) to inside:10.0.0.1/999 (10.0.0.1/999)", {"src_ip": "10.0.0.1", "dst_ip": "8.8.8.8", "dst_port": 443, "action": "allow", "log_type": "302013", "host_name": "fw1"}),
    "cisco_ftd": ("<113>2024-01-02T03:04:05Z ftd1 %FTD-1-430003: AccessControlRuleAction: Allow, SrcIP: 10.0.0.1, DstIP: 8.8.8.8, SrcPort: 9, DstPort: 443, Protocol: tcp, InitiatorBytes: 5, ResponderBytes: 7, AccessControlRuleName: out", {"log_type": "connection", "action": "allow", "bytes_total": 12, "rule_name": "out", "product": "firepower"}),
    "cisco_ios": ("<189>1001: R1: Jan 02 2024 03:04:05.123 UTC: %SEC-6-IPACCESSLOGP: list 101 denied tcp 1.2.3.4(44) -> 10.0.0.1(22), 1 packet", {"action": "deny", "src_ip": "1.2.3.4", "dst_port": 22, "host_name": "R1", "log_type": "sec"}),
    "generic_syslog": ("<85>Jan 15 10:01:12 host app[22]: hello", {"log_type": "authpriv", "severity": "notice", "host_name": "host", "app": "app", "message": "hello"}),
    "meraki": ("<134>1 2024-01-02T03:04:05Z MX flows src=1.2.3.4 dst=10.0.0.1 protocol=tcp/ip sport=4 dport=5 pattern: deny all", {"action": "deny", "protocol": "tcp", "src_port": 4, "message": "deny all", "log_type": "flows"}),
    "paloalto_syslog": (",".join(["h", "2024/01/02 03:04:05", "SER", "TRAFFIC", "end", "0", "2024/01/02 03:04:05", "10.0.0.1", "8.8.8.8", "", "", '"rule, one"', "ann", "", "ssl", "", "a", "b", "", "", "", "", "", "", "5", "443", "", "", "", "tcp", "allow", "900", "400", "500"]), {"log_type": "end", "rule_name": "rule, one", "bytes_total": 900, "dst_port": 443, "host_name": "SER"}),
    "aws_guardduty": (J({"schemaVersion": "2.0", "id": "f", "type": "Recon:EC2/Portscan", "severity": 5.5, "title": "T", "accountId": "1", "updatedAt": "2024-01-02T03:04:05Z", "resource": {"instanceDetails": {"instanceId": "i-1"}}, "service": {"action": {"actionType": "NETWORK_CONNECTION", "networkConnectionAction": {"connectionDirection": "INBOUND", "blocked": True, "protocol": "TCP", "remoteIpDetails": {"ipAddressV4": "1.2.3.4"}, "localPortDetails": {"port": 22, "portName": "SSH"}}}}}), {"severity": "medium", "action": "blocked", "src_ip": "1.2.3.4", "dst_port": 22, "app": "ssh", "host_name": "i-1", "log_type": "threat"}),
    "aws_securityhub": (J({"Findings": [{"SchemaVersion": "x", "ProductArn": "a", "Id": "1", "Title": "T", "AwsAccountId": "9", "Severity": {"Normalized": 70}, "Compliance": {"Status": "FAILED", "SecurityControlId": "S3.4"}, "Resources": [{"Id": "bucket", "Type": "B"}], "Types": ["Software/X"]}]}), {"log_type": "config", "severity": "high", "action": "failed", "rule_name": "S3.4", "host_name": "bucket"}),
    "defender_xdr": (J({"value": [{"incidentWebUrl": "u", "displayName": "Inc", "severity": "high", "status": "active", "alerts": [{"serviceSource": "microsoftDefenderForEndpoint", "title": "Mal", "severity": "low", "evidence": [{"@odata.type": "#x.deviceEvidence", "deviceDnsName": "pc"}, {"@odata.type": "#x.processEvidence", "processCommandLine": "run", "detectionStatus": "blocked"}]}]}]}), {"log_type": "incident", "rule_name": "Inc", "severity": "high"}),
    "nutanix_files": ('<14>Jan 2 03:04:05 fs1 {"object_name": "/a", "operation": "FILE_DELETE", "user_name": "ann", "client_ip": "10.0.0.1", "status": "DENIED", "share_name": "s"}', {"action": "delete", "severity": "warning", "log_type": "file-audit", "host_name": "fs1", "rule_name": "/a"}),
    "nutanix_pc": ("<14>Jan 2 03:04:05 pc1 flow: SRC=10.0.0.1 DST=10.0.0.2 SPORT=5 DPORT=6 PROTO=TCP ACTION=Drop ORIG=3 REPLY=4", {"log_type": "flow", "bytes_total": 7, "action": "drop", "dst_port": 6}),
    "qualys": ("<X><HOST_LIST><HOST><ID>1</ID><IP>10.0.0.1</IP><DNS><![CDATA[pc]]></DNS><DETECTION_LIST><DETECTION><QID>5</QID><SEVERITY>5</SEVERITY><PORT>0</PORT><STATUS>New</STATUS><TITLE>Bad &amp; worse CVE-2024-1234</TITLE><CVSS_BASE>8.8 (AV:N)</CVSS_BASE></DETECTION></DETECTION_LIST></HOST></HOST_LIST></X>", {"severity": "high", "dst_port": None, "action": "open", "host_name": "pc", "message": "QID 5: Bad & worse CVE-2024-1234"}),
    "tenable": (J({"asset": {"fqdn": "pc", "ipv4": "10.0.0.1"}, "plugin": {"id": 1, "name": "N", "cvss3_base_score": 9.8, "cve": ["CVE-2024-1", "cve-2024-12345"], "family": "F"}, "port": {"port": 443, "protocol": "TCP"}, "state": "REOPENED", "severity": "low"}), {"severity": "critical", "action": "reopened", "dst_port": 443, "rule_name": "N"}),
    "rapid7": (J({"asset": {"ip": "10.0.0.1", "hostname": "pc"}, "finding": {"status": "vulnerable", "results": [{"port": 80, "protocol": "tcp"}]}, "vulnerability": {"id": "v1", "title": "T", "severity": "Severe", "cvss": {"v3": {"score": 4.2}}, "cves": ["CVE-2024-77777"]}}), {"severity": "medium", "action": "open", "dst_port": 80, "host_name": "pc"}),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_format(spark, name):
    text, want = CASES[name]
    rows = PARSERS[name](spark.createDataFrame([(text,), ("",), (None,)], "value string"))
    assert [f.name for f in rows.schema] == [f.name for f in EVENT_SCHEMA]
    first = rows.where("raw is not null").first()
    assert {k: first[k] for k in want} == want
    json.loads(first.raw)


def test_nested_alerts_are_events(spark):
    rows = PARSERS["defender_xdr"](spark.createDataFrame([(CASES["defender_xdr"][0],)], "value string")).collect()
    assert [(r.log_type, r.action, r.host_name) for r in rows][1] == ("endpoint", "blocked", "pc")


def test_header_csv(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('Receive Time,Type,Source address,Destination Port,Severity\n2024/01/02 03:04:05,THREAT,10.0.0.1,443,High\n,,,,\n')
    row = PARSERS["paloalto_csv"](spark.read.csv(str(path), header=True)).collect()
    assert [(r.log_type, r.src_ip, r.dst_port, r.severity) for r in row] == [("threat", "10.0.0.1", 443, "high")]
    path.write_text("DetectName,SeverityName,Hostname,Tactic\nBad,High,pc,Execution\n")
    assert PARSERS["crowdstrike_csv"](spark.read.csv(str(path), header=True)).first().log_type == "detection"


@pytest.mark.parametrize("name", sorted(set(CASES) - {"rapid7"}))
def test_sniffing(name):
    assert sniff(CASES[name][0]) == name


def test_times(spark):
    from pyspark.sql import functions as F

    from logweave.sources.event import timestamp

    want = "2024-01-02 03:04:05"
    texts = ["1704164645", "1704164645000", "1704164645000000", "2024-01-02T03:04:05Z", "2024-01-02 04:04:05+01:00", "2024/01/02 03:04:05", "02/Jan/2024:03:04:05 +0000", "Jan 02 2024 03:04:05", "Jan  2 03:04:05", "2024-01-02 03:04:05,000"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(timestamp(F.col("t"), 2024).cast("string")).collect()]
    assert [g and g[:19] for g in got] == [want] * len(texts)
    none = spark.createDataFrame([("x",), ("",), (None,), ("2024",)], "t string").select(timestamp(F.col("t"))).collect()
    assert [r[0] for r in none] == [None] * 4
