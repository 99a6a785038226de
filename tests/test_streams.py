"""Streams of mixed formats and their accounting."""

import datetime as dt
import json

import pytest

from logweave.operators import ingest
from logweave.sources.envelopes import envelopes, routed
from logweave.sources.transports import parse_mixed
from logweave.streaming import runner

LINES = [
    [("cisco_ios", "<189>1: R1: %SEC-6-X: list 1 denied tcp 1.2.3.4(44) -> 10.0.0.1(22)"), ("generic_json", '{"action": "go", "user": "ann"}')],
    [("generic_syslog", "<13>Jan  2 03:04:05 h app: hi"), ("unheard", "x"), ("generic_json", '{"action": "stop"}')],
]


def plain(df):
    return sorted(json.dumps(r.asDict(), sort_keys=True, default=str) for r in df.collect())


def test_mixed_formats_are_dispatched_and_sinks_called_once(spark, tmp_path):
    for i, lines in enumerate(LINES):
        spark.createDataFrame(lines, "format string, value string").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    called = {"one": [], "two": []}

    def one(events, number):
        called["one"].append(number)
        events.write.mode("append").parquet(str(tmp_path / "one"))

    def two(events, number):
        called["two"].append(number)
        if called["two"] == [0]:
            raise RuntimeError("lost")
        events.write.mode("append").parquet(str(tmp_path / "two"))

    def start():
        rows = spark.readStream.schema("format string, value string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        return runner.dispatch(rows, {"one": one, "two": two}, str(tmp_path / "mark"))

    with pytest.raises(Exception, match="lost"):
        start().awaitTermination(120)
    start().awaitTermination(120)
    assert called == {"one": [0, 1], "two": [0, 0, 1]}
    batch = parse_mixed(spark.createDataFrame(sum(LINES, []), "format string, value string"))
    for name in called:
        assert plain(spark.read.schema(batch.schema).parquet(str(tmp_path / name))) == plain(batch)


def test_batches_are_accounted_for_in_one_pass(spark, tmp_path):
    rows = parse_mixed(spark.createDataFrame([("generic_json", json.dumps({"action": a, "n": i % 7, "timestamp": f"2024-01-0{1 + i % 3}T00:00:00Z"})) for i in range(40) for a in ("go", "drop")], "format string, value string"))
    drop = ingest.Action.parse({"id": "d", "action": "drop", "when": {"action": "drop"}})
    new, counts = runner.store_batch(rows, str(tmp_path / "s"), dt.datetime(2024, 1, 1), actions=[drop])
    assert counts == {"total": 80, "inserted": 21, "dropped": 40, "duplicates": 19} and new.count() == 21
    _, again = runner.store_batch(rows.limit(10), str(tmp_path / "s"), dt.datetime(2024, 1, 1), actions=[drop])
    assert again["total"] == 10 and again["inserted"] == 0 and again["total"] == again["inserted"] + again["dropped"] + again["duplicates"]
    for i in range(2):
        rows.where(f"event_time >= '2024-01-0{i + 1}'").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    told, src = {}, str(tmp_path / "in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
    runner.to_store(stream, str(tmp_path / "s2"), str(tmp_path / "m2"), actions=[drop], account=told.__setitem__).awaitTermination(120)
    assert all(c["total"] == c["inserted"] + c["dropped"] + c["duplicates"] for c in told.values())
    assert sum(c["inserted"] for c in told.values()) == runner.stored(spark, str(tmp_path / "s2")).count() == 21 and len(told) == 2


def test_envelopes_become_events(spark):
    body = "".join(json.dumps(x) for x in ({"sourcetype": "cisco:ios", "event": LINES[0][0][1]}, {"event": {"action": "go"}}))
    events = parse_mixed(routed(envelopes(spark.createDataFrame([(body,)], "value string")))).collect()
    assert sorted((r.vendor, r.action) for r in events) == [("cisco", "deny"), ("json", "go")]
