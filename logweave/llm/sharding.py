"""Sharding by best-fit-decreasing bin packing, law "bytes": shards of nearly equal size.

Equal texts form a group that stays together. Group sizes are counted into size classes (exact up to 65,536
bytes, 16 significant bits above, hence under 1.7 million classes for any input), and the driver packs
the counted classes: a class of equal sizes fills the tightest bin that still takes one of them, found in a
balanced search tree, as often as it goes, then the next one. That is best-fit-decreasing, item by item, in bulk.
The plan names ranges of numbers within classes, and a join carries it to the rows.

A group larger than an even share cannot stay together without breaking the law: it is cut into pieces of at
most that share. A single text above the share has a shard of its own as far as shards remain.

Defined cases: null and empty texts are two groups of size 16 a row; repeated rows are copies like any others;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import same_rows, spread, written
from logweave.llm.ordinals import numbered

OVERHEAD = 16
SALTS = 256
PER_SALT = 200_000
#: Plans are broadcast up to this many rows of 32 bytes.
BROADCAST_ROWS = 200_000


class BinTree:
    """A treap of (room, bin): successor, insert and remove in O(log bins)."""

    def __init__(self) -> None:
        self.root = None

    @staticmethod
    def _split(node, key):
        if node is None:
            return None, None
        k, pri, left, right = node
        if k < key:
            a, b = BinTree._split(right, key)
            return (k, pri, left, a), b
        a, b = BinTree._split(left, key)
        return a, (k, pri, b, right)

    @staticmethod
    def _merge(a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            return a[0], a[1], a[2], BinTree._merge(a[3], b)
        return b[0], b[1], BinTree._merge(a, b[2]), b[3]

    def insert(self, room: int, at: int) -> None:
        low, high = self._split(self.root, (room, at))
        node = ((room, at), zlib.crc32(b"%d" % at), None, None)
        self.root = self._merge(self._merge(low, node), high)

    def remove(self, room: int, at: int) -> None:
        low, rest = self._split(self.root, (room, at))
        _, high = self._split(rest, (room, at + 1))
        self.root = self._merge(low, high)

    def tightest(self, size: int):
        """The fullest bin with room for size, or None."""
        node, best = self.root, None
        while node is not None:
            if node[0][0] >= size:
                best, node = node[0], node[2]
            else:
                node = node[3]
        return best

    def emptiest(self):
        node = self.root
        while node[3] is not None:
            node = node[3]
        return node[0]


def best_fit_decreasing(classes: list[tuple[int, int]], bins: int) -> list[tuple[int, int, int, int]]:
    """Packs (size, count) classes into bins of an even share. Returns (size, from, to, bin), numbers of a class from 0.

    Items of at least an even share take a bin each, while any are left, and the share of the rest is even among the
    other bins. An item that fits nowhere goes to the emptiest bin; there are fewer of those than bins, since each is
    larger than any room left.
    """
    classes = sorted(((s, n) for s, n in classes if n), reverse=True)
    rest, left, plan, free = sum(s * n for s, n in classes), bins, [], 0
    small = []
    for size, n in classes:
        alone = 0
        while alone < n and left > 1 and size * left >= rest:
            plan.append((size, alone, alone + 1, free))
            alone, free, left, rest = alone + 1, free + 1, left - 1, rest - size
        if alone < n:
            small.append((size, alone, n))
    share, tree = -(-rest // left), BinTree()
    for b in range(free, bins):
        tree.insert(share, b)
    for size, at, n in small:
        while at < n:
            hit = tree.tightest(size)
            room, b = hit or tree.emptiest()
            take = min(n - at, max(1, room // size)) if hit else 1
            tree.remove(room, b)
            tree.insert(room - take * size, b)
            plan.append((size, at, at + take, b))
            at += take
    return plan


def _class(size):
    drop = F.greatest(F.lit(0), F.length(F.bin(size)) - 16)
    up = F.call_function("shiftleft", F.lit(1).cast("long"), drop) - 1
    return F.call_function("shiftleft", F.call_function("shiftright", size + up, drop), drop)


def shard(docs: DataFrame, shards: int = 40, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document with size, text_crc32, its shard and its slot in the shard."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = written(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.octet_length(body) + OVERHEAD).cast("long").alias("size"),
            F.crc32(body).alias("text_crc32"),
            F.xxhash64(F.col(text)).alias("h"),
        ),
        "shard-rows",
    )
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    share = max(1, -(-total // shards))
    salts = spread(count, PER_SALT, SALTS)
    group = ["h", "text_crc32", "size"]
    per = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(share) / F.col("size"))).cast("long")
    units = (
        rows.groupBy(*group)
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("per", F.when(F.col("copies") * F.col("size") > share, per).otherwise(F.col("copies")))
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / F.col("per")))))
        .withColumn("docs", F.least(F.col("per"), F.col("copies") - F.col("piece") * F.col("per")))
        .withColumn("class", _class(F.col("docs") * F.col("size")))
    )
    units = written(units, "shard-units")
    classes = [(r[0], r[1]) for r in units.groupBy("class").count().toLocalIterator()]
    plan = best_fit_decreasing(classes, shards)
    plan_df = spark.createDataFrame(plan, "class long, lo long, hi long, shard int")
    if len(plan) <= BROADCAST_ROWS:
        plan_df = F.broadcast(plan_df)
    placed = numbered(units, ["class"], [F.col("h"), F.col("text_crc32"), F.col("piece")], "at", salts)
    placed = placed.join(plan_df, "class").where((F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi")))
    placed = written(placed.select(*group, "piece", "per", "copies", "shard"), "shard-placed")
    cut = placed.where((F.col("piece") == 0) & (F.col("copies") > F.col("per"))).select(*group, "per")
    # documents of cut groups are numbered to find their piece; there are fewer such groups than twice the shards
    whole = rows.join(F.broadcast(cut), group, "left")
    in_cut = numbered(whole.where(F.col("per").isNotNull()), group, [F.col("doc_id")], "nth", salts, ties=True)
    keyed = whole.where(F.col("per").isNull()).select("doc_id", *group, F.lit(0).cast("long").alias("piece"))
    keyed = keyed.unionByName(in_cut.select("doc_id", *group, F.floor(F.col("nth") / F.col("per")).alias("piece")))
    to = placed.select(*[F.col(c).alias(f"_{c}") for c in [*group, "piece"]], "shard")
    at = same_rows([F.col(c) for c in [*group, "piece"]], [F.col(f"_{c}") for c in [*group, "piece"]])
    dealt = keyed.join(to, at).select("doc_id", "size", "text_crc32", "h", "shard")
    per_shard = spread(count, PER_SALT * shards, 64)
    return numbered(dealt, ["shard"], [F.col("doc_id"), F.col("h")], "slot", per_shard, ties=True).drop("h")


def op3_shard(docs: DataFrame) -> DataFrame:
    return shard(docs, 40).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
