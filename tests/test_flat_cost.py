"""Values of flat JSON records are trimmed in one pass."""

from logweave.sources.json_formats import flat, records


def test_values_are_trimmed_in_one_pass(spark):
    rows = spark.createDataFrame([('{"a":" x ","b":" ","c":{"d":"y"}}',)], "value string")
    kept = flat(records(rows))
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("array(trim(") <= 1
    assert kept.first()["_m"] == {"a": "x", "b": None, "c.d": "y"}
