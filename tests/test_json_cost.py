"""How often the parsers of JSON logs read a record's text, and that reading it less gives the same."""

import json

import pytest

from logweave.sources.detect import PARSERS
from logweave.sources.json_formats import records, with_flat


#: Most lookups and searches in the plan of all columns but the record and the time; each is evaluated once a row.
MOST = {"aws_guardduty": (60, 60), "generic_json": (120, 6), "tenable": (40, 6), "sysmon": (200, 6), "zeek_json": (400, 6), "defender_xdr": (80, 45)}


@pytest.mark.parametrize("name", list(MOST))
def test_values_are_computed_once(spark, name):
    rows = spark.createDataFrame([('{"a":1}',)], "value string")
    plan = PARSERS[name](rows).drop("raw", "event_time")._jdf.queryExecution().optimizedPlan().toString()
    lookups, searches = MOST[name]
    assert plan.count("element_at(_m#") <= lookups
    assert plan.count("get_json_object(") <= searches


def test_tags_are_searched_once(spark):
    rows = spark.createDataFrame([("<HOST></HOST>",)], "value string")
    plan = PARSERS["qualys"](rows).drop("raw", "event_time")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") <= 60


def test_flat_keys(spark):
    doc = '{"A":{"B":{"C":{"d":1}},"b.c":" x "},"a.b":"","a":[{"x":1},[2]," 3 ",4],"n":null,"l":[],"U":1.50,"w":"  ","W":"late","q":{"Q":[true]}}'
    rows = spark.createDataFrame([(doc,), ("[" + doc + ",1,null]",), ('{"records":[' + doc + "]}",), (r'{"records":[' + doc + "]}",), ('{"records":[]',), (None,)], "value string")
    kept, g = with_flat(records(rows, "records"))
    out = [r.asDict() for r in kept.select(*[g(k).alias(k.replace(".", "_")) for k in ("a", "a.b.c", "u", "w", "q.q", "n", "l", "A.b")]).collect()]
    want = {"a": "3", "a_b_c": "x", "u": "1.5", "w": None, "q_q": "true", "n": None, "l": None, "A_b": None}
    assert out == [want] * 4


def test_findings_of_either_spelling(spark):
    lower = {"title": "t", "severity": 7, "service": {"action": {"awsApiCallAction": {"remoteIpDetails": {"ipAddressV6": "2001:db8::1"}}, "networkConnectionAction": {
        "connectionDirection": "outbound", "blocked": False, "protocol": "TCP", "localIpDetails": {"ipAddressV4": " "}, "remotePortDetails": {"port": 99}}}},
        "resource": {"instanceDetails": {"networkInterfaces": [{"privateIpAddress": "10.0.0.9"}]}, "s3BucketDetails": [{"name": "b"}]}}
    upper = {"Title": "T", "Severity": 9.5, "Service": {"Action": {"ActionType": "PORT_PROBE", "PortProbeAction": {"Blocked": True, "PortProbeDetails": [
        {"LocalPortDetails": {"Port": 22, "PortName": "SSH"}, "RemoteIpDetails": {"IpAddressV4": "1.2.3.4"}}]}}}, "Resource": {"S3BucketDetails": [{"Name": "B"}]}}
    rows = spark.createDataFrame([(json.dumps(lower),), (json.dumps({"Findings": [upper]}),), ('{"service":{"action":7},"Service":"x"}',)], "value string")
    kept = ["severity", "action", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "app", "host_name"]
    out = {tuple(r) for r in PARSERS["aws_guardduty"](rows).select(*kept).collect()}
    assert out == {
        ("high", "allowed", "10.0.0.9", "2001:db8::1", None, 99, "tcp", None, "b"),
        ("very-high", "blocked", "1.2.3.4", None, None, 22, None, "ssh", "B"),
        (None, None, None, None, None, None, None, None, None),
    }
