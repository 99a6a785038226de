"""Envelopes of an event collector against a decoder of the same rules."""

import json
import random

from pyspark.sql import functions as F

from logweave.sources import envelopes as env


def found(spark, *bodies):
    rows = env.envelopes(spark.createDataFrame([(b,) for b in bodies], "value string"))
    return sorted(json.dumps(json.loads(r.envelope), sort_keys=True) for r in rows.collect())


def want(*objects):
    return sorted(json.dumps(o, sort_keys=True) for o in objects)


def test_bodies_of_every_shape(spark):
    a, b, c = {"event": "a } { [ \" \\ é", "time": 1}, {"event": {"x": ["}{", {"y": None}]}}, {"event": '{"event": "inner"}{"event": "x"}'}
    texts = [json.dumps(x) for x in (a, b, c)]
    for body in ("".join(texts), "\n".join(texts), ",\n".join(texts), "[" + ", ".join(texts) + "]", " \r\n" + " ".join(json.dumps(x, indent=2) for x in (a, b, c))):
        assert found(spark, body) == want(a, b, c)
    assert found(spark, texts[0], None, "", "  ", "12", '"x"', "[]", "[1, 2]") == want(a)


def test_a_broken_envelope_costs_itself(spark):
    a, b = {"event": "a"}, {"event": "b"}
    assert found(spark, '{"event": bad}' + json.dumps(b)) == want(b)
    assert found(spark, json.dumps(a) + '{"event": "x"' + json.dumps(b)) == want(a, b)
    assert found(spark, json.dumps(a) + "}}]" + json.dumps(b)) == want(a, b)
    assert found(spark, 'noise " {"' + json.dumps(a)) in (want(a), [])
    assert found(spark, "{" * 101 + "}" * 101 + json.dumps(a), json.dumps(b)) == want(b)
    assert found(spark, json.dumps({"event": "{" * 500})) == want({"event": "{" * 500})


def test_many_random_bodies(spark):
    rng = random.Random(4)
    value = lambda d: rng.choice([1, -2.5, True, None, "", "}{", '"', "\\", "é\n", [1, "]"], {"k": "{"}]) if d else {rng.choice("ab"): value(1) for _ in range(rng.randrange(3))}
    bodies, wanted = [], []
    for _ in range(60):
        objects = [{"event": value(rng.randrange(2)), "host": "h"} for _ in range(rng.randrange(5))]
        bodies.append(rng.choice(["", "\n", ", "]).join(json.dumps(o, ensure_ascii=rng.random() < 0.5) for o in objects))
        wanted += objects
    assert found(spark, *bodies) == want(*wanted)


def test_routes(spark):
    cases = [
        ({"sourcetype": "cisco:asa", "event": "%ASA-1-2: x"}, "cisco_asa", "%ASA-1-2: x"),
        ({"sourcetype": "cisco:asa", "event": '{"a": 1}', "host": "h"}, "generic_json", {"message": '{"a": 1}', "host": "h", "sourcetype": "cisco:asa"}),
        ({"sourcetype": "cisco:asa", "event": {"a": 1}}, "generic_json", {"a": 1, "sourcetype": "cisco:asa"}),
        ({"sourcetype": "suricata:eve", "event": {"host": "own", "n": 5}, "fields": {"n": 6, "m": "7"}, "host": "meta", "time": 12.5}, "suricata_eve", {"host": "meta", "n": 5, "m": "7", "sourcetype": "suricata:eve", "time": 12.5}),
        ({"sourcetype": "suricata:eve", "event": "plain"}, "generic_json", {"message": "plain", "sourcetype": "suricata:eve"}),
        ({"sourcetype": "XmlWinEventLog:Microsoft-Windows-Sysmon/Operational", "event": '{"Id": 1}'}, "sysmon", '{"Id": 1}'),
        ({"sourcetype": "unheard", "event": "x", "index": ""}, "generic_json", {"message": "x", "sourcetype": "unheard"}),
        ({"event": 5}, "generic_json", {"message": "5"}),
        ({"event": "", "fields": {"f": [1]}}, "generic_json", {"f": [1]}),
        ({"event": " "}, None, None),
        ({"host": "x"}, None, None),
        ({"event": {}}, "generic_json", {}),
    ]
    for case, form, value in cases:
        rows = env.routed(spark.createDataFrame([(json.dumps(case),)], "envelope string")).collect()
        assert [r.format for r in rows] == ([form] if form else []), case
        if form:
            assert rows[0].value == value if isinstance(value, str) else json.loads(rows[0].value) == value, (case, rows[0].value)


def test_raw_bodies(spark):
    rows = spark.createDataFrame([("one\r\n\n two \n", "syslog", None), (None, "syslog", "h")], "value string, sourcetype string, host string")
    got = [json.loads(r.envelope) for r in env.raw_envelopes(rows).collect()]
    assert got == [{"event": "one", "sourcetype": "syslog"}, {"event": " two ", "sourcetype": "syslog"}]
    assert {r.format for r in env.routed(env.raw_envelopes(rows)).collect()} == {"generic_syslog"}
    names = spark.createDataFrame([("PAN:threat", "paloalto_syslog"), ("json_suricata", "suricata_eve"), ("WinEventLog:Security", "windows_security"), ("x", None), (None, None), ("", None)], "s string, f string")
    assert names.where(~env.format_of(F.col("s")).eqNullSafe(F.col("f"))).count() == 0
