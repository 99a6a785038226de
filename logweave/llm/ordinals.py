"""Gapless numbers within groups of any size: rows are dealt over salts, numbered there, and shifted by the salts' counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm.common import same_rows, written


def numbered(df: DataFrame, group: list[str], order: list[Column], out: str, salts: int, *, ties: bool = False) -> DataFrame:
    """Adds column out: a long from 0 without gaps in each group. No task holds more than one salt of a group.

    The hash of order picks the salt. Where many rows may be equal in order, ties deals these over the salts by their
    places in the table, so that they do not stay together; which of them takes which number is then chance. The salted
    rows are stored, since they are read twice.
    """
    salt = F.pmod(F.xxhash64(*order), F.lit(salts))
    if ties:
        salt = F.pmod(salt + F.pmod(F.monotonically_increasing_id(), F.lit(salts)), F.lit(salts))
    df = written(df.withColumn("_salt", salt.cast("int")), "salted")
    counts = df.groupBy(*group, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.col("_salt").alias("_s"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
    )
    inside = Window.partitionBy(*group, "_salt").orderBy(*order)
    rows = df.withColumn("_i", F.row_number().over(inside) - 1)
    keys = [F.col(g) for g in group], [F.col(f"_g{i}") for i in range(len(group))]
    joined = rows.join(starts, same_rows(*keys) & (F.col("_salt") == F.col("_s")))
    return joined.withColumn(out, (F.col("_start") + F.col("_i")).cast("long")).drop(
        *[f"_g{i}" for i in range(len(group))], "_salt", "_s", "_start", "_i"
    )
