"""Rules, ingest actions, enrichment, stories and streams on small tables."""

import datetime as dt
import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from logweave.errors import ConfigError
from logweave.functions import ip
from logweave.operators import analytics, correlate, enrich, ingest, killchain, severity, sigma
from logweave.streaming import runner

EVENT = "id long, event_time timestamp, vendor string, product string, log_type string, severity string, action string, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, app string, user_name string, host_name string, rule_name string, bytes_total long, message string, raw string"


def event(i=1, **kw):
    base = dict.fromkeys([c.split()[0] for c in EVENT.split(", ")]) | {"id": i, "event_time": dt.datetime(2024, 1, 1), "vendor": "v", "raw": "{}"} | kw
    return tuple(base.values())


def fires(spark, detection, row, **kw):
    rows = spark.createDataFrame([row], EVENT)
    rule = sigma.Rule.parse({"id": "r", "title": "r", "detection": detection} | kw)
    compiled = sigma.compile_rules([rule], rows.columns, {}, spark)
    assert not compiled.disabled, compiled.disabled
    return sigma.matches(rows, compiled).first().rule_ids == ["r"]


@pytest.mark.parametrize(
    ("detection", "row", "want"),
    [
        ({"s": {"CommandLine|contains|all": ["-enc", "HIDDEN"]}, "condition": "s"}, {"raw": '{"commandline": "powershell -Enc x -w hidden"}'}, True),
        ({"s": {"EventID": 4625}, "condition": "s"}, {"raw": '{"event_id": 4625}'}, True),
        ({"s": {"ot.operation": ["write"]}, "condition": "s"}, {"raw": '{"ot": {"operation": "WRITE"}}'}, True),
        ({"s": {"tags": "b*"}, "condition": "s"}, {"raw": '{"tags": ["abc", "bcd"]}'}, True),
        ({"s": {"user|re": "^A.n$"}, "condition": "s"}, {"user_name": "aXn"}, True),
        ({"s": {"user|re|cased": "^A.n$"}, "condition": "s"}, {"user_name": "aXn"}, False),
        ({"s": {"src_ip|cidr": "2001:db8::/32"}, "condition": "s"}, {"src_ip": "2001:DB8::1"}, True),
        ({"s": {"src_ip|cidr": "10.0.0.0/8"}, "condition": "s"}, {"src_ip": "::ffff:10.1.2.3"}, True),
        ({"s": {"bytes_total|gt": 5}, "condition": "s"}, {"bytes_total": None}, False),
        ({"s": {"message|base64offset|contains": "secret"}, "condition": "s"}, {"message": "eHNlY3JldHk="}, True),
        ({"s": {"message|windash|contains": " -s"}, "condition": "s"}, {"message": "cmd /s"}, True),
        ({"s": {"app": None}, "condition": "s"}, {}, True),
        ({"s": {"app|exists": False}, "condition": "s"}, {"app": "x"}, False),
        ({"k": ["needle", "other"], "condition": "k"}, {"raw": '{"deep": {"x": "a NEEDLE"}}'}, True),
        ({"a": {"vendor": "v"}, "b": {"app": "x"}, "condition": "a and not b"}, {}, True),
        ({"a1": {"vendor": "v"}, "a2": {"app": "x"}, "condition": "1 of a*"}, {}, True),
        ({"a1": {"vendor": "v"}, "a2": {"app": "x"}, "condition": "all of them"}, {}, False),
        ({"a": {"vendor": "v"}, "condition": "a and missing"}, {}, False),
        ({"a": [{"vendor": "nope"}, {"app": "y"}], "condition": "a"}, {"app": "Y"}, True),
        ({"a": {"message": "a?c*"}, "condition": "a"}, {"message": "abcdef\nx"}, True),
    ],
)
def test_rules(spark, detection, row, want):
    assert fires(spark, detection, event(**row)) is want


def test_bad_rules_are_disabled_alone(spark):
    rows = spark.createDataFrame([event(action="x")], EVENT)
    make = lambda i, d, **kw: sigma.Rule.parse({"id": i, "detection": d} | kw)
    rules = [make("good", {"s": {"action": "x"}}), make("re", {"s": {"a|re": "("}}), make("mod", {"s": {"a|nope": 1}}), make("net", {"s": {"src_ip|cidr": "x/y"}}), make("model", {"s": {"a": 1}}, datamodels="nope")]
    compiled = sigma.compile_rules(rules, rows.columns, {}, spark)
    assert set(compiled.disabled) == {"re", "mod", "net", "model"} and sigma.matches(rows, compiled).first().rule_ids == ["good"]
    found = sigma.alerts(rows.unionByName(rows), compiled)
    assert found.count() == 1 and sigma.new_alerts(found, found).count() == 0


def test_lint_and_import():
    assert any("missing" in x for x in sigma.lint({"title": "t", "tags": ["attack.t1110"], "detection": {"a": {"x": 1}, "condition": "a or missing"}}))
    docs = [{"id": "1", "logsource": {"product": "windows"}, "detection": {"s": {"a": 1}, "condition": "s"}}, {"id": "1"}, {"id": "2", "logsource": {"category": "x"}}, {"id": "3", "status": "deprecated"}, {"id": "4", "correlation": {}}]
    rules, skipped = sigma.import_foreign(docs, set())
    assert [r.id for r in rules] == ["1"] and set(skipped) == {"1", "2", "3", "4"}


def test_keys_of_addresses(spark):
    texts = ["1.2.3.4", "01.2.3.4", "256.1.1.1", "::", "::1", "2001:db8::8:800:200C:417A", "::ffff:1.2.3.4", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1::2::3", "fe80::1%eth0", "64:ff9b::10.0.0.1", "x", "", None, ":1", "12345::"]
    rng = random.Random(1)
    texts += [str(ipaddress.ip_address(rng.getrandbits(128))) for _ in range(100)] + [str(ipaddress.IPv6Address(rng.getrandbits(20) << rng.choice([0, 64, 108]))) for _ in range(100)]
    got = [r.k for r in spark.createDataFrame([(t,) for t in texts], "t string").select(ip.key(F.col("t")).alias("k")).collect()]
    for t, k in zip(texts, got, strict=True):
        try:
            want = ip.key_of((t or "").split("%")[0])
        except ValueError:
            want = None
        assert k == want, t


def test_scopes(spark):
    want = {"10.1.1.1": "private", "8.8.8.8": "public", "100.64.0.1": "cgnat", "127.0.0.1": "loopback", "224.1.1.1": "multicast", "198.51.100.7": "documentation", "0.0.0.0": "reserved", "::1": "loopback", "fe80::2": "link-local", "2606::1": "public", "fd00::1": "private", "x": None}
    rows = spark.createDataFrame([(k,) for k in want], "t string").select("t", ip.scope(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in rows} == want


def test_longest_prefix_equals_brute_force(spark):
    rng = random.Random(2)
    nets = [(f"10.{rng.randrange(4)}.{rng.randrange(256)}.0/{rng.choice([9, 13, 16, 22, 24, 31])}", f"n{i}") for i in range(30)] + [("2001:db8::/33", "six")]
    nets = list({str(ipaddress.ip_network(c, strict=False)): (str(ipaddress.ip_network(c, strict=False)), n) for c, n in nets}.values())
    texts = [f"10.{rng.randrange(5)}.{rng.randrange(256)}.{rng.randrange(256)}" for _ in range(300)] + ["2001:db8::5", "2001:db8:8000::1", "bad", None]
    rows = spark.createDataFrame([(t,) for t in texts], "a string")
    got = {r.a: r.z for r in enrich.longest_prefix(rows, "a", enrich.networks(spark, nets), "z").collect()}
    for t in set(texts) - {None, "bad"}:
        hits = [(ipaddress.ip_network(c).prefixlen, n) for c, n in nets if ipaddress.ip_address(t) in ipaddress.ip_network(c)]
        assert got[t] == (max(hits)[1] if hits else None)


def test_ranges_are_flattened():
    rng = random.Random(4)
    for _ in range(50):
        ranges = [(a, a + rng.randrange(12), f"l{i % 3}") for i, a in enumerate(rng.randrange(40) for _ in range(8))]
        flat = enrich.flatten_ranges(ranges)
        for x in range(60):
            hits = [(b - a, i, label) for i, (a, b, label) in enumerate(ranges) if a <= x <= b]
            assert [label for a, b, label in flat if a <= x <= b] == ([min(hits)[2]] if hits else [])
        assert all(p[1] < q[0] for p, q in zip(flat, flat[1:]))


def test_indicators(spark):
    rows = spark.createDataFrame([(1, "see http://Evil.example/x, and 10.1.2.3."), (2, "hash " + "ab" * 16), (3, "mail a@bad.example.com bad.example.com"), (4, None)], "id int, t string")
    iocs = spark.createDataFrame([("http://evil.example/x", "url", "high"), ("10.1.0.0/16", "cidr", "low"), ("ab" * 16, "hash", "high"), ("bad.example.com", "domain", "medium")], "indicator string, ioc_type string, severity string")
    got = sorted((r.id, r.indicator) for r in enrich.ioc_matches(rows, "id", F.col("t"), iocs).collect())
    assert got == [(1, "10.1.0.0/16"), (1, "http://evil.example/x"), (2, "ab" * 16), (3, "bad.example.com")]
    lines = spark.createDataFrame([("# c",), ("1.2.3.4 # x",), ("1.2.3.4",), ("Bad.Example",), ("1.0.0.0/8",), ("??",)], "value string")
    feed = enrich.feed(lines, "f")
    assert sorted((r.indicator, r.ioc_type) for r in feed.collect()) == [("1.0.0.0/8", "cidr"), ("1.2.3.4", "ip"), ("bad.example", "domain")]
    assert enrich.classify("1.0.0.0/8") == "cidr" and enrich.classify("zz") is None
    assert enrich.replace_feed(feed, feed.limit(1), "f").count() == 1


def test_indicators_keep_every_network(spark, monkeypatch):
    monkeypatch.setattr(enrich, "BROADCAST_ROWS", 3)
    rows = spark.createDataFrame([(i, f"from 10.{i}.2.3 on") for i in range(12)], "id int, t string")
    iocs = spark.createDataFrame([(f"10.{i}.0.0/16", "cidr", None if i == 4 else f"s{i}") for i in range(12)] + [("10.0.0.0/99", "cidr", "low")], "indicator string, ioc_type string, severity string")
    got = sorted((r.id, r.indicator, r.severity) for r in enrich.ioc_matches(rows, "id", F.col("t"), iocs).collect())
    assert got == [(i, f"10.{i}.0.0/16", None if i == 4 else f"s{i}") for i in range(12)]
    assert enrich.ioc_matches(rows, "id", F.col("t"), iocs.limit(0)).count() == 0


def test_network_columns_equal_the_constants(spark):
    rng = random.Random(8)
    texts = [f"{ipaddress.ip_address(rng.getrandbits(32))}/{rng.randrange(33)}" for _ in range(80)] + [f"{ipaddress.ip_address(rng.getrandbits(128))}/{rng.randrange(129)}" for _ in range(80)]
    texts += [" 10.1.2.3/08 ", "10.1.2.3", "2001:DB8::1", "10.1.2.3/255.255.240.0", "10.1.2.3/0.0.15.255", "10.1.2.3/0.0.0.0", "::/0", "::ffff:0:0/90"]
    texts += ["10.1.2.3/33", "::1/129", "10.1.2.3/", "10.1.2.3/8/8", "10.1.2.3/255.0.255.0", "::1/255.0.0.0", "x/8", "", "10.1.2.3/-1", "10.1.2.3/99999999999"]
    rows = spark.createDataFrame([(t,) for t in texts] + [("::ffff:10.1.2.3/104",), (None,)], "t string").select("t", ip.networked(F.col("t")).alias("n"))
    got = {r.t: r.n and tuple(r.n) for r in rows.collect()}
    for t in texts:
        try:
            want = ip.network(t)
        except ValueError:
            want = None
        assert got[t] == want, t
    assert got["::ffff:10.1.2.3/104"] == ip.network("10.1.2.3/8") and got[None] is None


def test_actions_in_order(spark):
    rows = spark.createDataFrame([event(1, user_name="alice", message="alice (alicebob) says alice", src_ip="1.1.1.1", raw='{"alice": "alice", "pin": 1234, "q": "x"}', action="a"), event(2, action="b")], EVENT)
    acts = [ingest.Action.parse(d) for d in (
        {"id": "m", "action": "mask", "when": {"action": "A"}, "mask": {"fields": ["user_name", "src_ip"], "raw": ["pin"]}, "order": 1},
        {"id": "d", "action": "drop", "when": {"user_name": {"contains": "alice"}}, "order": 2},
        {"id": "r", "action": "route", "when": {"action": ["b"]}, "route": {"vendor": "w"}, "order": 3},
    )]
    a, b = ingest.apply_actions(rows, acts).orderBy("id").collect()
    assert a.user_name == "[redacted]" and a.src_ip is None and a.message == "[redacted] (alicebob) says [redacted]"
    assert a.raw == '{"alice": "[redacted]", "pin": "[redacted]", "q": "x"}' and b.vendor == "w" and b.applied == ["r"]
    for bad in ({"id": "x", "action": "nope"}, {"id": "x", "action": "sample", "sample": {}}, {"id": "x", "action": "sample", "sample": {"rate": 0}}, {"id": "x", "action": "mask", "mask": {"fields": ["zz"]}}):
        with pytest.raises(ConfigError):
            ingest.Action.parse(bad)


def test_pairs_and_accounting(spark):
    row = spark.createDataFrame([("a=1 b=\"x y\" a=2",)], "t string").select(ingest.pairs(F.col("t")).alias("m")).first()
    assert row.m == {"a": "2", "b": "x y"}
    assert ingest.accounting(10, 3, 5) == {"total": 10, "inserted": 5, "dropped": 3, "duplicates": 2}


def test_stories(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, t, "ann", "h1", None, "high", ["credential access"], ["T1"]), (2, t + dt.timedelta(minutes=50), None, "h1", "1.1.1.1", "low", ["attack.lateral_movement"], ["T2"]), (3, t + dt.timedelta(minutes=90), "bob", None, "1.1.1.1", None, ["exfiltration"], []), (4, t, "zed", None, None, "critical", ["impact"], ["T3"]), (5, t + dt.timedelta(hours=9), "ann", None, None, "low", ["impact"], ["T3"])]
    alerts = spark.createDataFrame(rows, "alert_id long, event_time timestamp, user_name string, host_name string, src_ip string, level string, tactics array<string>, techniques array<string>")
    (story,) = killchain.stories(killchain.chains(alerts, 3600)).collect()
    assert story.chain_id == 1 and story.alert_count == 3 and story.severity == "high" and story.stages == ["credential-access", "lateral-movement", "exfiltration"]
    assert story.pivots == ["host h1", "ip 1.1.1.1"]
    done = spark.createDataFrame([(story.signature,)], "signature string")
    assert killchain.ranked(killchain.stories(killchain.chains(alerts)), done).count() == 0


def test_severity_order(spark):
    rows = spark.createDataFrame([("Low",), ("critical",), (None,), ("odd",)], "s string")
    assert [r[0] for r in rows.select(severity.rank(F.col("s"))).collect()] == [1, 4, 2, 2]
    assert rows.agg(severity.highest(F.col("s"))).first()[0] == "critical" and rows.limit(0).agg(severity.highest(F.col("s"))).first()[0] == "medium"


def test_correlations_validate():
    with pytest.raises(ConfigError):
        correlate.Correlation.parse({"id": "x", "window_s": 1, "threshold": 1, "group_by": ["nope"]})
    rule = correlate.Correlation.parse({"id": "x", "window_s": 60, "threshold": 2, "group_by": "user_name", "distinct": "user_name"})
    assert rule.counted is None
    assert analytics.retention_cutoff(dt.date(2024, 5, 1), 1) == "2021-05"


def test_streams_equal_batches(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([event(i, event_time=t + dt.timedelta(seconds=20 * i), action="deny" if i % 3 else "allow", user_name=f"u{i % 4}", raw=f'{{"n": {i % 90}}}') for i in range(120)], EVENT)
    src = str(tmp_path / "in")
    for k in range(4):
        rows.where((F.col("id") % 4) == k).coalesce(1).write.mode("append").parquet(src)
    store, mark = str(tmp_path / "store"), str(tmp_path / "mark")
    for _ in range(2):  # the second run finds nothing new
        runner.to_store(runner.read_events(spark, src, rows.schema, files_per_batch=1), store, mark).awaitTermination(120)
    want = ingest.chain(rows, batch_time=t).select("dedup_hash").collect()
    assert sorted(r.dedup_hash for r in runner.stored(spark, store).collect()) == sorted(r.dedup_hash for r in want)
    rule = correlate.Correlation("c", "c", 300, 3, ("user_name",), {"action": "deny"})
    out = str(tmp_path / "alerts")
    ordered = str(tmp_path / "ordered")
    rows.coalesce(1).write.parquet(ordered)
    for days in (1, 2):  # later events move the watermark past the last windows
        late = rows.where("id = 1").withColumn("event_time", F.lit(t + dt.timedelta(days=days)))
        late.coalesce(1).write.mode("append").parquet(ordered)
    runner.correlate_to(runner.read_events(spark, ordered, rows.schema, files_per_batch=1), rule, out, str(tmp_path / "m2"), slide_s=300).awaitTermination(120)
    got = {(r.window_start, r.user_name, r.n) for r in spark.read.parquet(out).collect()}
    assert got == {(r.bucket, r.user_name, r.n) for r in correlate.buckets(rows, rule).collect()}


def test_rules_read_raw_keys_at_any_depth(spark):
    deep = "x"
    for k in range(16, 0, -1):
        deep = f'{{"k{k}": {deep if k < 16 else chr(34) + "Found" + chr(34)}}}'
    path = ".".join(f"k{k}" for k in range(1, 17))
    assert fires(spark, {"s": {path: "found"}, "condition": "s"}, event(raw=deep))
    assert fires(spark, {"s": {"a.B.c|contains": "ell"}, "condition": "s"}, event(raw='{"A": {"b": {"C": "Hello", "d": {}}}}'))
    assert fires(spark, {"k": ["hello"], "condition": "k"}, event(raw='{"a": {"b": {"c": ["x", "say Hello"]}}}'))
    assert not fires(spark, {"s": {"a|exists": True}, "condition": "s"}, event(raw='{"a": {"b": 1}}'))
    assert fires(spark, {"s": {"a": "{odd"}, "condition": "s"}, event(raw='{"a": "{odd", "b": null}'))


def test_masked_values_do_not_stay_elsewhere(spark):
    rows = [
        event(1, user_name="al", message="runas al, al.x (pal)", raw='{"who": "CORP\\\\al", "al": 1}', src_ip="10.1.2.3"),
        event(2, user_name="jdoe.smith", message="abcjdoe.smithxyz", raw='{"url": "/u/jdoe.smith2"}', src_ip="10.1.2.3"),
        event(3, user_name="-x", message="a-x -xb", src_ip=None),
    ]
    act = ingest.Action.parse({"id": "m", "action": "mask", "mask": {"fields": ["user_name", "src_ip"], "method": "hash", "salt": "s", "raw": ["pi+n"]}})
    a, b, c = ingest.apply_actions(spark.createDataFrame(rows, EVENT), [act]).orderBy("id").collect()
    assert a.message == f"runas {a.user_name}, {a.user_name}.x (pal)" and a.raw == f'{{"who": "CORP\\\\{a.user_name}", "al": 1}}'
    assert b.message == f"abc{b.user_name}xyz" and b.raw == f'{{"url": "/u/{b.user_name}2"}}'
    assert c.message == f"a{c.user_name} -xb" and c.src_ip is None
    assert a.src_ip == b.src_ip and ipaddress.ip_address(a.src_ip) in ipaddress.ip_network("100.64.0.0/10")
    act = ingest.Action.parse({"id": "m", "action": "mask", "mask": {"raw": ["p.n"]}})
    assert ingest.apply_actions(spark.createDataFrame([event(raw='{"pin": 1, "p.n": 2}')], EVENT), [act]).first().raw == '{"pin": 1, "p.n": "[redacted]"}'


def test_ranges_of_both_versions(spark):
    rng = random.Random(3)
    lines = ["start,end,country", "2001:db8::/32,DE", "2001:db8:5::,2001:db8:9:ffff::1,FR", "10.0.0.0/8,US", "::/0,XX", "10.0.0.1,::1,no", "1.2.3.4,ZZ"]
    ranges = enrich.csv_ranges(lines)
    assert len(ranges) == 4
    table = enrich.range_table(spark, enrich.flatten_ranges(ranges))
    assert table.count() < 3000
    addresses = [str(ipaddress.IPv6Address((0x20010DB8 << 96) + rng.getrandbits(96))) for _ in range(60)] + [str(ipaddress.IPv6Address(rng.getrandbits(128))) for _ in range(20)]
    addresses += ["2001:db8:5::", "2001:db8:9:ffff::1", "2001:db8:9:ffff::2", "10.9.8.7", "11.0.0.0", "x"]
    rows = spark.createDataFrame([(a,) for a in addresses] + [(None,)], "a string")
    got = {r.a: r.c for r in enrich.range_label(rows, "a", table, "c").collect()}

    def want(a):
        try:
            x = ipaddress.ip_address(a)
        except ValueError:
            return None
        if x.version == 4:
            return "US" if x in ipaddress.ip_network("10.0.0.0/8") else None
        if ipaddress.ip_address("2001:db8:5::") <= x <= ipaddress.ip_address("2001:db8:9:ffff::1"):
            return "FR"
        return "DE" if x in ipaddress.ip_network("2001:db8::/32") else "XX"

    assert got == {a: want(a) for a in addresses} | {None: None}


def test_events_that_touch_indicators(spark):
    rows = [
        event(1, src_ip="10.1.2.3", raw='{"a": {"b": "see bad.example.com"}, "evil.example": 1}'),
        event(2, dst_ip="2001:DB8:0::1", message="10.1.9.9 and " + "AB" * 16),
        event(3, src_ip="10.1.2.4", user_name="x"),
        event(4, raw=None),
    ]
    iocs = [("10.1.2.3", "ip", "f", "low"), ("10.1.0.0/16", "cidr", "g", "medium"), ("10.0.0.0/8", "cidr", "g", "high"), ("2001:db8::1", "ip", "f", "critical"), ("Bad.example.com", "domain", "f", "high"), ("evil.example", "domain", "f", "high"), ("ab" * 16, "hash", "h", None)]
    matches = enrich.ti_matches(spark.createDataFrame(rows, EVENT), spark.createDataFrame(iocs, "indicator string, ioc_type string, source string, severity string"))
    got = sorted((r.id, r.indicator, r.ioc_type) for r in matches.collect())
    assert got == [(1, "10.1.2.3", "ip"), (1, "bad.example.com", "domain"), (2, "10.1.0.0/16", "cidr"), (2, "2001:db8::1", "ip"), (2, "ab" * 16, "hash"), (3, "10.1.0.0/16", "cidr")]
    alerts = {r.id: (r.level, len(r.indicators)) for r in enrich.ti_alerts(matches).collect()}
    assert alerts == {1: ("high", 2), 2: ("critical", 3), 3: ("medium", 1)}


def test_replayed_batches_keep_their_time(spark, tmp_path):
    path = str(tmp_path / "times" / "0")
    first = runner.batch_time(spark, path)
    assert runner.batch_time(spark, path) == first and runner.batch_time(spark, path + "1") >= first


def test_chains_equal_brute_force(spark):
    rng, t = random.Random(6), dt.datetime(2024, 1, 1)
    rows = [(i, t + dt.timedelta(seconds=rng.randrange(4000)), f"u{rng.randrange(12)}", rng.choice([None, "", f"h{rng.randrange(9)}"]), f"ip{rng.randrange(30)}") for i in range(60)]
    alerts = spark.createDataFrame(rows, "alert_id long, event_time timestamp, user_name string, host_name string, src_ip string")
    group = {r[0]: {r[0]} for r in rows}
    for column in (2, 3, 4):
        for value in {r[column] for r in rows if r[column]}:
            same = sorted((r[1], r[0]) for r in rows if r[column] == value)
            for (t1, a), (t2, b) in zip(same, same[1:]):
                if (t2 - t1).total_seconds() <= 300 and group[a] is not group[b]:
                    group[a] |= group[b]
                    for x in group[b]:
                        group[x] = group[a]
    got = {r.alert_id: r.chain_id for r in killchain.chains(alerts, 300).collect()}
    assert got == {i: min(g) for i, g in group.items()} and len(set(got.values())) > 3
