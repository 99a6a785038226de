"""Indicators are looked for without a shuffle of all that events mention."""

from logweave.operators import enrich


def test_observables_of_a_row_are_distinct_without_a_shuffle(spark):
    rows = spark.createDataFrame([(1, "10.0.0.1", "10.0.0.1 saw 10.0.0.1 and a.example.com"), (1, "10.0.0.1", "again a.example.com")], "id long, src_ip string, message string")
    seen = enrich._observed(rows, "id")
    plan = seen._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan
    assert sorted(tuple(r) for r in seen.where("ioc_type = 'ip'").collect()) == [(1, "ip", "10.0.0.1")] * 2
    assert enrich.event_observables(rows).count() == 2
    iocs = spark.createDataFrame([("10.0.0.1", "ip", "f", "high"), ("a.example.com", "domain", "f", "low")], "indicator string, ioc_type string, source string, severity string")
    assert sorted(r.indicator for r in enrich.ti_matches(rows, iocs).collect()) == ["10.0.0.1", "a.example.com"]
