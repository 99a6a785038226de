"""Registries as CSV, retention and layers."""

import datetime as dt
import json

from pyspark.sql import functions as F

from logweave.operators import analytics, registries


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_aliases_have_one_spelling(spark):
    cases = [
        ("hostname", "WKS-01..", "wks-01"), ("fqdn", " A.B. ", "a.b"), ("hostname", ".", None), ("ip", "::FFFF:10.1.1.1", "10.1.1.1"), ("ip", "010.1.1.1", None),
        ("ip", "2001:DB8:0:0::1", "2001:db8::1"), ("cidr", "10.1.1.5/24", "10.1.1.0/24"), ("cidr", "2001:db8::5/33", "2001:db8::/33"), ("cidr", "10.0.0.0/99", None),
        ("mac", "AABB.CCDD.EEFF", "aa:bb:cc:dd:ee:ff"), ("mac", "aa-bb", None), ("email", "A@B.c", "a@b.c"), ("upn", "ab", None), ("sam", "CORP/JDoe", "corp\\jdoe"), ("cn", "  ", None),
    ]
    for kind, raw, want in cases:
        assert spark.range(1).select(registries.alias(kind, F.lit(raw)).alias("x")).first().x == want, (kind, raw)
    cells = {"a;b, c": ["a", "b, c"], "x|Y,z": ["x", "y,z"], "A , b": ["a", "b"], "": [], " One ": ["one"]}
    assert {c: spark.range(1).select(registries.several(F.lit(c)).alias("x")).first().x for c in cells} == cells


GOOD = '''Asset_ID,display_name,criticality,category,watchlist,enabled,hostname,ip,cidr,mac,notes
a1,"One, ""first""",HIGH,web;db,,,WKS-01;wks-02.,10.0.0.1,,AA-BB-CC-DD-EE-FF,"two
lines"
,,,,,,,,,,
a2,,criticl,,vip|x,No,,,10.1.1.5/24,,
a3,,,,,,,,,,
'''


def test_an_import_is_whole_or_nothing(spark, tmp_path):
    table = registries.registry(spark, str(tmp_path / "t"), "asset", buckets=3)
    done = registries.load(table, write(tmp_path / "good.csv", GOOD), "asset")
    assert done.ok and [r.line for r in done.without_alias.collect()] == [5]
    rows = {r.asset_id: r for r in table.read().collect()}
    assert rows["a1"].display_name == 'One, "first"' and rows["a1"].notes == "two\nlines" and rows["a1"].category == ["web", "db"] and rows["a1"].enabled
    assert [(a.type, a.value) for a in rows["a1"].aliases] == [("hostname", "wks-01"), ("hostname", "wks-02"), ("ip", "10.0.0.1"), ("mac", "aa:bb:cc:dd:ee:ff")]
    assert (rows["a2"].criticality, rows["a2"].enabled, rows["a2"].watchlist, rows["a3"].criticality) == ("unknown", False, ["vip", "x"], "medium")
    before = table.manifest()
    bad = GOOD.replace("a3,,", "a4,,low") + "a5,,,,,,,1.2.3,,,\na1,,,,,,,,,,\n,named,,,,,,,,,\n"
    faults = registries.load(table, write(tmp_path / "bad.csv", bad), "asset").faults.collect()
    assert sorted(r.fault for r in faults) == ["row 6: '1.2.3' is not a valid ip", "row 7: asset_id 'a1' appears twice (also on row 2)", "row 8: asset_id is empty"]
    for text in ("asset_id,criticallity\na,b\n", "name\nx\n", "asset_id\n"):
        assert not registries.load(table, write(tmp_path / "worse.csv", text), "asset").ok
    assert table.manifest() == before
    registries.load(table, write(tmp_path / "edit.csv", "asset_id,criticality,hostname\na3,critical,new\n"), "asset")
    assert {r.asset_id: r.criticality for r in table.read().collect()} == {"a1": "high", "a2": "unknown", "a3": "critical"}
    assert sorted(r.alias for r in registries.alias_rows(table).collect()) == ["10.0.0.1", "aa:bb:cc:dd:ee:ff", "new", "wks-01", "wks-02"]


def test_an_export_reads_back_the_same(spark, tmp_path):
    for kind, text in (("asset", GOOD), ("identity", "identity_id,display_name,priority,email,upn,sam,employee_id,cn,watchlist\ni1,Ann,low,A@x.org;b@x.org,a@x.org,CORP\\Ann,7,Ann A,vip\ni2,,,,,,,,\n")):
        one, two = (registries.registry(spark, str(tmp_path / f"{kind}{i}"), kind, buckets=2) for i in (1, 2))
        assert registries.load(one, write(tmp_path / f"{kind}.csv", text), kind).ok
        out = str(tmp_path / f"{kind}-out")
        registries.export(one, kind).coalesce(1).write.csv(out, header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        assert registries.load(two, out, kind).ok
        plain = lambda t: sorted(json.dumps(r.asDict(recursive=True), sort_keys=True) for r in t.read().collect())
        assert plain(one) == plain(two)


def test_months_are_dropped_whole(spark, tmp_path):
    rows = spark.createDataFrame([(m,) for m in ("2019-12", "2020-01", "2023-06")], "m string").selectExpr("1 as x", "m as event_month")
    rows.write.partitionBy("event_month").parquet(str(tmp_path / "s"))
    assert analytics.drop_expired(spark, str(tmp_path / "s"), dt.date(2023, 6, 5), 1) == ["2019-12", "2020-01"]
    assert [r.event_month for r in spark.read.parquet(str(tmp_path / "s")).collect()] == ["2023-06"]


def test_a_layer_is_of_one_domain(spark):
    found = spark.createDataFrame([("T1110", 2, "high"), ("t0855", 1, "low")], "technique string, rules long, highest string")
    layers = {d: json.loads(analytics.navigator_layer(found, domain=d).first().layer) for d in ("enterprise-attack", "ics-attack")}
    assert {d: [t["techniqueID"] for t in v["techniques"]] for d, v in layers.items()} == {"enterprise-attack": ["T1110"], "ics-attack": ["t0855"]}
