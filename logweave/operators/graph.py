"""Connected components as a DataFrame iteration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.scratch import written

#: From so many edges on, minima and half rounds are stored before they are joined.
LARGE = 200_000


def _least(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's least neighbour. A large table is stored, so that the joins with it have bare shuffles below them,
    which adaptive execution can split where one node has many edges."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return written(least, "least") if large else least


def _large_star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's larger neighbours are hung on the least node of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both, large).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node and its smaller neighbours are hung on the least of them. Edges run from the larger node u to v."""
    least = _least(edges, large)
    hung = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component): the least node that each node of an edge (a, b) reaches, by alternating large and small
    stars. Minima are combined before the shuffle, and in tables of LARGE edges or more the joins split a hub's rows."""
    now = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    mark = F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    seen = tuple(now.agg(*mark).first())
    while True:
        large = seen[0] >= LARGE
        half = _large_star(now, large)
        now = written(_small_star(written(half, "large-stars") if large else half, large), "stars")
        after = tuple(now.agg(*mark).first())
        if after == seen:
            break
        seen = after
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
