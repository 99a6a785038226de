"""Chains read alerts more than once; what makes the alerts must run once."""

import datetime as dt

from pyspark.sql import functions as F

from logweave.operators import killchain


def test_alerts_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(user):
        made.add(1)
        return user

    at = dt.datetime(2024, 1, 1)
    rows = [(i, at + dt.timedelta(minutes=30 * i), f"u{i // 4}", "h", None) for i in range(20)]
    alerts = spark.createDataFrame(rows, "alert_id long, event_time timestamp, user_name string, host_name string, src_ip string")
    alerts = alerts.withColumn("user_name", seen("user_name")).withColumn("host_name", F.lit(None).cast("string"))
    out = {r.alert_id: r.chain_id for r in killchain.chains(alerts, 3600).select("alert_id", "chain_id", "user_name").collect()}
    assert out == {i: i // 4 * 4 for i in range(20)}
    assert made.value == 20
