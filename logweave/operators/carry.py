"""Last values carried forward along an order, without one task holding a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def carried(rows: DataFrame, group: list[str], block: str, order: str, names: list[str]) -> DataFrame:
    """rows with each name's last value that is not null up to the row, in the order of (block, order) within its group.

    A group is worked on in its blocks, which are its unit of skew: within each by a window, then from block to block by
    each block's last values, one row a block. None of the keys may be null.
    """
    within = Window.partitionBy(*group, block).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.groupBy(*group, block).agg(*[F.max_by(n, F.when(F.col(n).isNotNull(), F.col(order))).alias(f"_{n}") for n in names])
    before = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*group, block, *[F.last(f"_{n}", ignorenulls=True).over(before).alias(f"_{n}") for n in names])
    here = rows.withColumns({n: F.last(n, ignorenulls=True).over(within) for n in names})
    return here.join(ends, [*group, block]).withColumns({n: F.coalesce(n, f"_{n}") for n in names}).drop(*[f"_{n}" for n in names])
