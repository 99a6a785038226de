"""The events table of the catalogue as security events, in both engines."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions.text import token_array

AS_OF = dt.datetime(2024, 1, 31)

#: Columns of the adapter, as SQL that Spark and DuckDB read alike.
COLUMNS = {
    "id": "event_id",
    "event_time": "ts",
    "vendor": "CASE WHEN event_id % 4 = 0 THEN 'cisco' ELSE 'app' END",
    "product": "CASE WHEN event_id % 4 = 0 THEN 'asa' WHEN event_id % 3 = 0 THEN 'web' ELSE 'mobile' END",
    "log_type": "CASE WHEN event_type = 'view' THEN 'http' WHEN event_type = 'signup' THEN 'signin' "
    "WHEN event_type = 'click' AND event_id % 2 = 0 THEN 'modbus' ELSE event_type END",
    "severity": "CASE WHEN value > 100 THEN 'high' WHEN value > 20 THEN 'medium' ELSE 'low' END",
    "action": "CASE WHEN event_type = 'error' THEN 'failed-logon' WHEN event_type = 'view' THEN 'deny' ELSE 'allow' END",
    "src_ip": "concat('10.', user_id % 4, '.', user_id % 7, '.', user_id % 200)",
    "dst_ip": "concat('198.51.', event_id % 5, '.', event_id % 250)",
    "src_port": "CAST(1024 + event_id % 5000 AS INT)",
    "dst_port": "CAST(CASE event_id % 4 WHEN 0 THEN 22 WHEN 1 THEN 443 WHEN 2 THEN 3389 ELSE 502 END AS INT)",
    "protocol": "CASE WHEN event_id % 2 = 0 THEN 'tcp' ELSE 'udp' END",
    "app": "CASE WHEN event_id % 6 = 1 THEN NULL ELSE concat('svc-', event_id % 6) END",
    "user_name": "concat('u', user_id)",
    "host_name": "concat('h', user_id % 17)",
    "rule_name": "CASE WHEN event_id % 5 = 0 THEN concat('Rule_', event_id % 11, '%') END",
    "bytes_total": "CAST(floor(value * 100) AS BIGINT)",
    "message": "concat(event_type, ' by u', user_id)",
    "raw": "props",
}

SQL = "SELECT " + ", ".join(f"{v} AS {k}" for k, v in COLUMNS.items()) + " FROM events"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = rows.selectExpr(*[f"{v} AS {k}" for k, v in COLUMNS.items()])
    text = F.concat_ws(" ", "vendor", "product", "log_type", "severity", "action", "user_name", "host_name", "message", "raw")
    return rows.withColumn("search_tokens", token_array(text))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flat(df: DataFrame) -> DataFrame:
    """Arrays as sorted, comma-joined text, which both engines compare alike."""
    out = []
    for c, kind in df.dtypes:
        x = F.col(f"`{c}`")
        out.append(F.array_join(F.array_sort(F.transform(x, lambda v: v.cast("string"))), ",").alias(c) if kind.startswith("array") else x)
    return df.select(*out)
