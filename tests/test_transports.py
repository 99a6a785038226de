from logweave.sources.envelopes import envelopes, routed
from logweave.sources.transports import LONGEST_MESSAGE, export_csv, framed, frames, ingested_before, parse_mixed, syslog_streams


def test_envelopes_are_split_and_parsed(spark):
    text = '{"sourcetype": "cisco:ios", "event": "R1: %SEC-6-X: list 1 denied tcp 1.2.3.4(44) -> 10.0.0.1(22)", "time": 1704164645}\n{"event": {"action": "go", "user": "ann"}} {"event": "<13>Jan  2 03:04:05 h app: hi"}{"host": "x"}'
    rows = routed(envelopes(spark.createDataFrame([(text,), (None,)], "value string")))
    assert sorted(r.format for r in rows.collect()) == ["cisco_ios", "generic_json", "generic_json"]
    got = {(r.vendor, r.action, r.user_name, r.host_name, r.message) for r in parse_mixed(rows).collect()}
    assert {g[:4] for g in got} == {("cisco", "deny", None, "R1"), ("json", "go", "ann", None), ("json", None, None, None)}
    assert "<13>Jan  2 03:04:05 h app: hi" in {g[4] for g in got}
    assert parse_mixed(rows.limit(0)).count() == 0


def test_exports_are_no_formulas(spark, tmp_path):
    path = str(tmp_path / "x")
    export_csv(spark.createDataFrame([("=1+1", ["a"], 3)], "a string, b array<string>, c int"), path)
    assert [tuple(r) for r in spark.read.csv(path, header=True).collect()] == [("'=1+1", '["a"]', "3")]


def test_streams_are_framed(spark):
    counted = b"".join(b"%d %s" % (len(m), m) for m in (b"<13>a\nb", b"<14>c"))
    assert frames(counted) == ["<13>a\nb", "<14>c"]
    assert frames(b"12 Jun plain\n\n7 <13>abc<9>rest\nlast") == ["12 Jun plain", "<13>abc", "<9>rest", "last"]
    assert frames(b"<13>x\n50 <13>cut off") == ["<13>x"]
    assert [(len(t), n) for t, n in framed(b"x" * (LONGEST_MESSAGE + 5) + b"\nshort")] == [(LONGEST_MESSAGE, 5), (5, 0)]
    assert frames(b"") == [] and frames(b"\xff\n") == ["\ufffd"]
    rows = spark.createDataFrame([(bytearray(counted),), (None,), (bytearray(b""),)], "content binary")
    assert sorted(r.value for r in syslog_streams(rows).collect()) == ["<13>a\nb", "<14>c"]


def test_content_is_known_again(spark):
    files = spark.createDataFrame([("p1", bytearray(b"x")), ("p2", bytearray(b"y")), ("p3", bytearray(b"x"))], "path string, content binary")
    first = ingested_before(files, spark.createDataFrame([], "batch_id long, sha256 string"))
    assert {r.batch_id for r in first.collect()} == {None}
    batches = first.where("path = 'p1'").select("sha256").selectExpr("7L as batch_id", "sha256")
    again = ingested_before(files, batches.unionByName(batches.selectExpr("9L as batch_id", "sha256")))
    assert {(r.path, r.batch_id) for r in again.collect()} == {("p1", 7), ("p2", None), ("p3", 7)}
