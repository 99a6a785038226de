"""Line dedup over the suffix array of line ids, in DataFrame functions only.

The corpus is one sequence of line ids, hashes, in order of (document id, row, line); blank lines are left out and a
document's end is one of the sequence. Prefix doubling sorts its suffixes: the rank of a suffix in round k tells where
its first 2^k lines stand among those of all others. A round sorts the pairs of ranks of lines i and i + 2^k by a range
partition; numbers that rise with the partition and the row are the next ranks. Suffixes of one rank are an interval of
the suffix array whose longest common prefix is at least 2^k lines. Intervals of one suffix end a run, and their
suffixes leave the rounds. Rounds end at the longest prefix that min_words words can need.

For each line the shortest block from it and the shortest block to it of at least min_words words are looked up. The
suffixes with a common prefix of the block's m lines, 2^k <= m < 2^(k+1), are those that agree in the ranks of round k
of the block's first and last 2^k lines: an interval too, with the block's copies. A block that is not the first of
its interval is deleted. The union of these blocks is exactly the lines of the maximal repeated runs of at least
min_words words, less their first copies. Since the first place of every line stays, no content is lost.

Intervals are counted and stored before they are joined, so that the joins have bare shuffles below them, which
adaptive execution splits where one interval is large. Positions are numbers of document and line in one long: up to
2^26 lines that are not blank in a document, 2^37 documents.

Defined cases: a null text stays null, an empty or blank one stays as it is; lines are compared without white
space at their ends; of repeated rows one stays whole (any of them, if they differ in other columns only); null ids
come first in the order; input columns pass through, except that those named n_lines, n_removed or removed_lines are
replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm.common import same_rows, written

MIN_WORDS = 50
LINE_BITS = 26


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows (d, t, r, i, at, h1, h2, w): the i-th line that is not blank of row r, at its place in the text, its id and
    its words; d is the document's id and t the hash of its text."""
    keyed = docs.select(
        F.col(doc_id).alias("d"),
        F.xxhash64(F.col(text)).alias("t"),
        F.monotonically_increasing_id().alias("r"),
        F.col(text).alias("x"),
    )
    # places and lines are exploded together, so that nothing but keys stands beside them on a row
    trimmed = F.transform(F.split("x", "\n", -1), lambda x, at: F.struct(at.alias("at"), F.btrim(x, F.lit(" \t\r\f\x0b")).alias("line")))
    rows = keyed.select("d", "t", "r", F.posexplode_outer(F.filter(trimmed, lambda x: x["line"] != "")).alias("i", "l")).where("i is not null")
    return rows.select(
        "d",
        "t",
        "r",
        "i",
        "l.at",
        F.xxhash64("l.line").alias("h1"),
        F.xxhash64(F.lit(7), "l.line").alias("h2"),
        F.size(F.split("l.line", r"\s+")).alias("w"),
    )


def _in_order(df: DataFrame, keys: list[str], out: str) -> DataFrame:
    """df, one row for each key, with a long that rises with the keys: rows are dealt by ranges of keys and sorted."""
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(out, F.monotonically_increasing_id())


def _positions(lines: DataFrame) -> DataFrame:
    """Stored rows (pos, d, t, r, at, h1, h2, w) of the lines that occur twice or more."""
    often = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    repeated = written(lines.join(written(often, "line-counts"), ["h1", "h2"]), "repeated-lines")
    rows = written(_in_order(repeated.select("d", "r").distinct(), ["d", "r"], "_o").drop("d"), "row-order")
    # the numbers of a partition begin where those before it end: one count for each partition goes to the driver
    part = F.shiftright("_o", 33)
    counts = sorted((x[0], x[1]) for x in rows.groupBy(part.alias("_part")).count().collect())
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total - (p << 33)))
        total += n
    starts = lines.sparkSession.createDataFrame(starts, "_p long, _start long")
    rows = rows.join(F.broadcast(starts), part == F.col("_p")).select("r", (F.col("_o") + F.col("_start")).alias("o"))
    pos = F.col("o") * (1 << LINE_BITS) + F.col("i")
    return written(repeated.join(rows, "r").select(pos.alias("pos"), "d", "t", "r", "at", "h1", "h2", "w"), "positions")


def _intervals(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Stored rows (keys, first, rank): the first position and the rank of each key that two or more suffixes have."""
    classes = df.groupBy(*keys).agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return written(_in_order(classes, keys, "rank"), name)


def _blocks(lines: DataFrame, min_words: int) -> DataFrame:
    """Rows (pos, m): the shortest blocks of at least min_words words from and to each line of a repeated stretch."""
    row = F.shiftright("pos", LINE_BITS)
    in_row = Window.partitionBy("o").orderBy("pos")
    # lines that follow each other differ from their numbers by the same
    lines = lines.select("pos", "w", row.alias("o")).withColumn("seg", F.col("pos") - F.row_number().over(in_row))
    stretch = Window.partitionBy("o", "seg")
    lines = lines.withColumn("upto", F.sum("w").over(stretch.orderBy("pos"))).withColumn("all", F.sum("w").over(stretch))
    lines = lines.withColumn("before", F.col("upto") - F.col("w"))
    # the lines whose words are still too few: each has a word at least, so that there are less than min_words
    on = F.count(F.lit(1)).over(stretch.orderBy("before").rangeBetween(1, min_words - 1)) + 1
    back = F.count(F.lit(1)).over(stretch.orderBy("upto").rangeBetween(1 - min_words, -1)) + 1
    each = lines.withColumn("on", on).withColumn("back", back)
    ahead = F.when(F.col("all") - F.col("before") >= min_words, F.struct("pos", F.col("on").alias("m")))
    behind = F.when(F.col("upto") >= min_words, F.struct((F.col("pos") - F.col("back") + 1).alias("pos"), F.col("back").alias("m")))
    return each.select(F.explode_outer(F.array(ahead, behind)).alias("x")).where("x is not null").select("x.pos", F.col("x.m").cast("int").alias("m")).distinct()


def suffix_ranks(positions: DataFrame, longest: int) -> list[DataFrame]:
    """For each round k with 2^k <= longest, stored rows (pos, rank) of the suffixes whose first 2^k lines occur again."""
    first = _intervals(positions, ["h1", "h2"], "intervals0").drop("first")
    out = [written(positions.join(first, ["h1", "h2"]).select("pos", "rank"), "ranks0")]
    size = 1
    while 2 * size <= longest:
        ahead = Window.partitionBy(F.shiftright("pos", LINE_BITS)).orderBy("pos")
        # suffixes whose prefix does not repeat have left, so the row size further on may not be the line size further
        # on; where the longer prefix repeats, all lines between are there
        pairs = out[-1].withColumn("next", F.lead("rank", size).over(ahead)).withColumn("j", F.lead("pos", size).over(ahead))
        pairs = pairs.where(F.col("j") == F.col("pos") + size).select("pos", F.col("rank").alias("prev"), "next")
        both = _intervals(pairs, ["prev", "next"], "intervals").drop("first")
        size *= 2
        out.append(written(pairs.join(both, ["prev", "next"]).select("pos", "rank"), "ranks"))
    return out


def repeated_lines(lines: DataFrame, min_words: int) -> DataFrame:
    """Rows (d, t, r, at): the lines to delete, of the stored table of lines."""
    positions = _positions(lines)
    blocks = written(_blocks(positions, min_words), "blocks")
    longest = blocks.agg(F.max("m")).first()[0] or 0
    if not longest:
        return lines.select("d", "t", "r", "at").limit(0)
    rounds = suffix_ranks(positions, longest)
    ranks = rounds[0].withColumn("k", F.lit(0))
    for k, level in enumerate(rounds[1:], 1):
        ranks = ranks.unionByName(level.withColumn("k", F.lit(k)))
    k = F.length(F.bin("m")) - 1
    last = F.col("pos") + F.col("m") - F.call_function("shiftleft", F.lit(1).cast("long"), F.col("k"))
    here = blocks.withColumn("k", k).join(ranks.withColumnRenamed("rank", "a"), ["k", "pos"]).withColumn("at", last)
    here = here.join(ranks.select("k", F.col("pos").alias("at"), F.col("rank").alias("z")), ["k", "at"])
    here = written(here.select("pos", "m", "a", "z"), "placed-blocks")
    copies = _intervals(here, ["m", "a", "z"], "block-intervals").drop("rank")
    late = here.join(copies, ["m", "a", "z"]).where(F.col("pos") != F.col("first"))
    covered = late.select(F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("m") - 1)).alias("pos")).distinct()
    return covered.join(positions, "pos").select("d", "t", "r", "at")


def _per_text(lines: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows (_d, _t, _n, _first, _late): of the _n rows with an equal id and text, the lines that the first loses and
    those that each other one loses."""
    per_row = gone.groupBy("d", "t", "r").agg(F.array_sort(F.collect_set("at")).alias("gone"))
    rows = lines.where("i = 0").groupBy(F.col("d").alias("_d"), F.col("t").alias("_t"))
    rows = rows.agg(F.count(F.lit(1)).alias("_n"), F.min("r").alias("_r"))
    met = per_row.join(rows, same_rows([F.col("d"), F.col("t")], [F.col("_d"), F.col("_t")]))
    return met.groupBy("_d", "_t", "_n").agg(
        F.max(F.when(F.col("r") == F.col("_r"), F.col("gone"))).alias("_first"),
        F.max(F.when(F.col("r") != F.col("_r"), F.col("gone"))).alias("_late"),
    )


def line_dedup(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS
) -> DataFrame:
    """docs with text less its repeated runs, and n_lines, n_removed and the array removed_lines.

    The texts are shuffled once, by a merge join at any size: the deletions grow with the corpus.
    """
    lines = written(_lines(docs, doc_id, text), "lines")
    gone = written(_per_text(lines, repeated_lines(lines, min_words)), "gone")
    # a row's own columns are kept in one, apart from those that the join adds
    keyed = docs.select(F.struct("*").alias("_row"), F.xxhash64(F.col(text)).alias("_h"))
    row_id, body = F.col("_row").getField(doc_id), F.col("_row").getField(text)
    cond = same_rows([row_id, F.col("_h")], [F.col("_d"), F.col("_t")])
    if gone.where("_n > 1").limit(1).count():
        # of the rows that repeat an id and a text, the one with the least number is the first
        twice = gone.where("_n > 1").select("_d", "_t")
        many = written(keyed.join(twice, cond, "left_semi").withColumn("_r", F.monotonically_increasing_id()), "repeated-rows")
        least = written(many.groupBy(row_id.alias("_a"), F.col("_h").alias("_b")).agg(F.min("_r").alias("_m")), "first-rows")
        many = many.join(least, same_rows([row_id, F.col("_h")], [F.col("_a"), F.col("_b")]))
        many = many.select("_row", "_h", F.when(F.col("_r") == F.col("_m"), 1).otherwise(2).alias("_k"))
        single = keyed.join(twice, cond, "left_anti")
        keyed = single.withColumn("_k", F.lit(1)).unionByName(many)
    else:
        keyed = keyed.withColumn("_k", F.lit(1))
    met = keyed.join(gone.hint("merge"), cond, "left")
    gone_here = F.when(F.col("_k") == 1, F.col("_first")).otherwise(F.col("_late"))
    met = met.select("_row", gone_here.alias("_gone"), F.split(body, "\n", -1).alias("_split"))
    left = F.array_except(F.sequence(F.lit(0), F.size("_split") - 1), F.col("_gone"))
    new = F.array_join(F.transform(left, lambda i: F.get(F.col("_split"), i)), "\n")
    added = {
        "n_lines": F.coalesce(F.size("_split"), F.lit(0)).cast("long"),
        "n_removed": F.coalesce(F.size("_gone"), F.lit(0)).cast("long"),
        "removed_lines": F.coalesce("_gone", F.array().cast("array<int>")),
    }
    own = [F.col("_row").getField(c).alias(c) for c in docs.columns if c != text and c not in added]
    changed = F.when(F.col("_gone").isNotNull(), new).otherwise(body).alias(text)
    at = [c for c in docs.columns if c not in added].index(text)
    return met.select(*own[:at], changed, *own[at:], *[c.alias(name) for name, c in added.items()])


def op2_line_dedup(docs: DataFrame) -> DataFrame:
    return line_dedup(docs.select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_removed", F.array_join("removed_lines", ",").alias("removed_lines"), "text"
    )
