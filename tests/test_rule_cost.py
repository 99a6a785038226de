"""That rules are evaluated once a row, and that records without objects are read as before."""

from pyspark.sql import functions as F

from logweave.operators import sigma


def test_rules_are_evaluated_once(spark):
    rows = spark.createDataFrame([(1, '{"k":1}', "a"), (2, None, "b")], "id long, raw string, action string")
    rows = rows.select("*", *[F.lit(None).cast("string").alias(c) for c in ("vendor", "src_ip", "dst_ip", "user_name", "host_name", "message")], F.lit(None).cast("timestamp").alias("event_time"))
    rules = [sigma.Rule.parse({"id": n, "title": n, "detection": {"s": {"action": v}, "condition": "s"}}) for n, v in (("r1", "a"), ("r2", "x"), ("r3", "A"))]
    found = sigma.alerts(rows, sigma.compile_rules(rules, rows.columns))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("array_sort(") == 1
    assert sorted((r.rule_id, r.event_id) for r in found.collect()) == [("r1", 1), ("r3", 1)]


def test_flat_raw(spark):
    docs = ['{"A":1,"b":"{x","c":[1]}', '{"A":{"B":{"c":1}},"d":"t"}', "{}", "no", None]
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, raw string")
    out = {r.i: None if r.f is None else [tuple(e) for e in r.f] for r in rows.select("i", sigma.flat_raw(F.col("raw")).alias("f")).collect()}
    assert out == {0: [("a", "1"), ("b", "{x"), ("c", "[1]")], 1: [("d", "t"), ("a.b.c", "1")], 2: [], 3: [], 4: []}
