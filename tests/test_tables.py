"""Tables that are changed in place, against a dictionary."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from logweave.errors import ConfigError
from logweave.operators import analytics, casework
from logweave.operators.tables import Conflict, Table


def rows_of(table):
    return {(r.k, r.g): (r.a, r.b) for r in table.read().collect()}


def test_changes_equal_a_dictionary(spark, tmp_path, monkeypatch):
    rng, table, want = random.Random(3), Table(spark, str(tmp_path / "t"), ["k", "g"], "k long, g string, a long, b string", buckets=5), {}
    assert rows_of(table) == {} and table.manifest() == (0, {})
    for step in range(8):
        kind = rng.choice(["upsert", "upsert", "part", "set", "delete", "fails"])
        new = {(rng.choice([None, *range(12)]), rng.choice([None, "x"])): (rng.randrange(100), f"s{step}") for _ in range(rng.randrange(1, 9))}
        df = spark.createDataFrame([(*k, *v) for k, v in new.items()], table.schema)
        if kind == "upsert":
            table.upsert(df, {"a": lambda was, now: was + now})
            want |= {k: (v[0] + (want[k][0] if k in want else 0), v[1]) for k, v in new.items()}
        elif kind == "part":
            table.upsert(df.drop("b"))
            want |= {k: (v[0], want[k][1] if k in want else None) for k, v in new.items()}
        elif kind == "set":
            table.change(F.col("a") % 2 == 0, {"b": F.concat(F.lit("e"), F.col("b"))})
            want = {k: (a, None if b is None else "e" + b) if a % 2 == 0 else (a, b) for k, (a, b) in want.items()}
        elif kind == "delete":
            table.delete(F.col("a") % 3 == 0)
            want = {k: v for k, v in want.items() if v[0] % 3}
        else:
            before = table.manifest()
            with monkeypatch.context() as m:
                m.setattr(Table, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
                with pytest.raises(OSError):
                    table.upsert(df)
            assert table.manifest() == before
        assert rows_of(table) == want, kind
    again = Table(spark, str(tmp_path / "t"), ["k", "g"], table.schema, buckets=5)
    assert rows_of(again) == want


def test_readers_and_writers_do_not_meet(spark, tmp_path, monkeypatch):
    table = Table(spark, str(tmp_path), ["k"], "k long, a long", buckets=3)
    table.upsert(spark.createDataFrame([(i, 1) for i in range(9)], table.schema))
    old = table.read()
    table.upsert(spark.createDataFrame([(i, 2) for i in range(9)], table.schema))
    assert {r.a for r in old.collect()} == {1} and {r.a for r in table.read().collect()} == {2}
    stale = table.manifest()
    table.upsert(spark.createDataFrame([(1, 3)], table.schema))
    monkeypatch.setattr(table, "manifest", lambda: stale)
    with pytest.raises(Conflict):
        table.upsert(spark.createDataFrame([(1, 4)], table.schema))
    monkeypatch.undo()
    (tmp_path / "manifests" / f"{table.manifest()[0] + 1:012d}.json").write_text('{"buck')
    assert {r.k: r.a for r in table.read().collect()}[1] == 3
    with pytest.raises(ConfigError):
        table.change(F.lit(True), {"k": F.lit(1)})


T = dt.datetime(2024, 1, 1)


def test_casework(spark, tmp_path):
    alerts = Table(spark, str(tmp_path / "a"), ["alert_id"], "alert_id long, level string, status string, assignee string, case_id long", buckets=4)
    cases = Table(spark, str(tmp_path / "c"), ["case_id"], "case_id long, title string, severity string, status string, updated_at timestamp, closed_at timestamp", buckets=4)
    found = spark.createDataFrame([(1, "low", "new"), (2, "critical", "new"), (3, "high", "new")], "alert_id long, level string, status string")
    casework.store_alerts(alerts, found)
    casework.set_status(alerts, [1], "closed")
    casework.set_assignee(alerts, [2, 3], "ann")
    casework.store_alerts(alerts, found)
    cases.upsert(spark.createDataFrame([(7, "x", "medium", "open"), (8, "y", "low", "open")], "case_id long, title string, severity string, status string"))
    casework.add_to_case(alerts, cases, 7, [1, 3], T)
    casework.add_to_case(alerts, cases, 8, [99], T)
    assert {r.alert_id: (r.status, r.assignee, r.case_id) for r in alerts.read().collect()} == {1: ("closed", None, 7), 2: ("new", "ann", None), 3: ("new", "ann", 7)}
    casework.update_case(cases, 8, T, status="closed", title="")
    assert {r.case_id: (r.title, r.severity, r.status, r.closed_at) for r in cases.read().collect()} == {7: ("x", "high", "open", None), 8: (None, "low", "closed", T)}
    casework.update_case(cases, 8, T, status="open")
    casework.remove_from_case(alerts, [3])
    assert [r.closed_at for r in cases.read().where("case_id = 8").collect()] == [None] and alerts.read().where("case_id = 7").count() == 1


def test_counters_and_indicators(spark, tmp_path):
    table = Table(spark, str(tmp_path / "s"), ["suppression_id"], "suppression_id string, name string, hit_count long, last_hit timestamp", buckets=2)
    table.upsert(spark.createDataFrame([("1", "one"), ("2", "two")], "suppression_id string, name string"))
    muted = spark.createDataFrame([("1",), ("1",), (None,), ("9",)], "suppression_id string")
    casework.count_suppressions(table, muted, T)
    casework.count_suppressions(table, muted, T)
    assert {r.suppression_id: (r.name, r.hit_count) for r in table.read().collect()} == {"1": ("one", 4), "2": ("two", None)}
    iocs = Table(spark, str(tmp_path / "i"), ["indicator", "ioc_type"], "indicator string, ioc_type string, source string, severity string, description string, added_at timestamp, enabled boolean", buckets=2)
    make = lambda *rows: spark.createDataFrame(rows, "indicator string, ioc_type string, source string, severity string, description string")
    casework.upsert_indicators(iocs, make(("a", "ip", "f", "low", None), ("b", "ip", "g", "low", None)), T)
    iocs.change(F.col("indicator") == "a", {"enabled": F.lit(False)})
    casework.replace_indicators(iocs, "g", make(("a", "ip", "g", "high", "d"), ("c", "ip", "g", "low", None)), T + dt.timedelta(days=1))
    assert {r.indicator: (r.source, r.severity, r.enabled) for r in iocs.read().collect()} == {"a": ("g", "high", True), "c": ("g", "low", True)}


def test_baselines_batch_by_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(T + dt.timedelta(minutes=rng.randrange(9999)), rng.choice(["u1", "u2", None]), f"h{rng.randrange(5)}", "10.0.0.1") for _ in range(90)]
    schema = "event_time timestamp, user_name string, host_name string, src_ip string"
    known = Table(spark, str(tmp_path), ["entity_type", "entity_value"], "entity_type string, entity_value string, first_seen timestamp, last_seen timestamp, event_count long", buckets=4)
    for at in range(0, 90, 30):
        casework.update_baselines(known, spark.createDataFrame(rows[at : at + 30], schema))
    plain = lambda df: sorted(tuple(r) for r in df.select(*known.schema.names).collect())
    assert plain(known.read()) == plain(analytics.entities(spark.createDataFrame(rows, schema)))
