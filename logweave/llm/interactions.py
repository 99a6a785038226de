"""Audit of how document filters interact: what each removes in every order of them, alone and beside the others.

Failure flags are worked out once for each document. Documents are counted by flags and part, and a CUBE over the five
flags and the part runs on these counts, of which there are at most 32 for each part. In a grouping set the flags that
are grouped by are a subset of the filters; its row with all of them false counts the documents that pass every filter
of the subset: its survivors. Each step of each order joins the survivors of the filters before it with those of the
filters up to it. All the rest is differences of survivors.

Texts above LONG_TEXT bytes are read in runs of whole words, whose different words are counted by a shuffle, so that no
array grows with a text. Equal texts are met by 128 bits of hash; the smallest id of each text that occurs twice or more
is stored before it is joined, so that adaptive execution can split a text that a third of the documents have.

Defined cases: a null text is an empty one, and fails A only, or E too; a null part is the empty string's part; a null
id is neither smaller than another nor has it a smaller one, and has no labels; rows with equal ids count each, and are
not smaller than each other; a document is good (toxic) if any of its label rows says 1; an empty table has no parts
and gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import LONG_TEXT, RUN_WORDS, UPPER, word_runs, written

FILTERS = "ABCDE"
LEAST_WORDS = 200
DISTINCT_PERCENT = 50
CAPS_PERCENT = 3
MARKS = "#$%&*|"
SPACE = r"\x20\x09-\x0D"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACE}]+", -1), "")


def word_counts(texts: DataFrame, *, long_text: int = LONG_TEXT, run_words: int = RUN_WORDS) -> DataFrame:
    """texts, which have columns h1, h2 and text, with n_words and n_distinct in place of text; stored."""
    keys = [c for c in texts.columns if c != "text"]
    runs = word_runs(F.col("text"), SPACE, 1, long_text=long_text, run_words=run_words)
    rows = texts.withColumn("_long", F.octet_length("text") > long_text).select(*keys, "_long", F.posexplode_outer(runs).alias("_c", "_x"))
    rows = rows.select(*keys, "_long", "_c", _words(F.col("_x.run")).alias("_w"))
    rows = rows.select(*keys, "_long", "_c", F.size("_w").cast("long").alias("n_words"), F.array_distinct("_w").alias("_w"))
    rows = rows.withColumn("n_distinct", F.size("_w").cast("long")).withColumn("_w", F.when(F.col("_long"), F.col("_w")))
    rows = written(rows, "word-runs")
    short = rows.where(~F.col("_long")).select(*keys, "n_words", "n_distinct")
    long = rows.where("_long")
    if not long.limit(1).count():
        return short
    # words and runs are those of a text, however many documents have it
    n_words = long.groupBy("h1", "h2", "_c").agg(F.max("n_words").alias("n")).groupBy("h1", "h2").agg(F.sum("n").alias("n_words"))
    each = long.select("h1", "h2", F.explode_outer("_w").alias("w")).where("w is not null").distinct()
    n_distinct = each.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_distinct"))
    counts = written(n_words.join(n_distinct, ["h1", "h2"], "left").fillna(0, ["n_distinct"]), "long-texts")
    return short.unionByName(long.where("_c = 0").select(*keys).join(counts, ["h1", "h2"]).select(*keys, "n_words", "n_distinct"))


def failures(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", part: str = "lang", **runs) -> DataFrame:
    """Rows (doc_id, part, n_words, n_distinct, n_caps, n_points, A, B, C, D, E): what the five filters see in each
    document, and whether it fails them."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), body.alias("text"))
    rows = rows.select(
        "doc_id",
        "part",
        F.xxhash64("text").alias("h1"),
        F.xxhash64(F.lit(7), "text").alias("h2"),
        F.length("text").cast("long").alias("n_points"),
        (F.length("text") - F.length(F.translate("text", UPPER, ""))).cast("long").alias("n_caps"),
        F.col("text").rlike(f"[{MARKS}]").alias("D"),
        "text",
    )
    counted = word_counts(rows, **runs)
    firsts = counted.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    met = counted.join(written(firsts, "first-ids"), ["h1", "h2"], "left")
    return met.select(
        "doc_id",
        "part",
        "n_words",
        "n_distinct",
        "n_caps",
        "n_points",
        (F.col("n_words") < LEAST_WORDS).alias("A"),
        (100 * F.col("n_distinct") < DISTINCT_PERCENT * F.col("n_words")).alias("B"),
        (100 * F.col("n_caps") > CAPS_PERCENT * F.col("n_points")).alias("C"),
        "D",
        F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False)).alias("E"),
    )


def survivors(flagged: DataFrame, filters: list[str], part: str, measures: list[str]) -> DataFrame:
    """Rows (part, mask, n, measures): the documents of a part, and the sums of their measures, that pass all filters of
    the subset whose bits are set in mask. A subset that none passes has no row. Stored."""
    total = [F.sum(m).alias(m) for m in ("n", *measures)]
    counts = flagged.withColumn("n", F.lit(1).cast("long")).groupBy(*filters, part).agg(*total)
    cube = counts.cube(*filters, part).agg(*total, F.grouping(part).alias("_all"), *[F.grouping(f).alias(f"_g_{f}") for f in filters])
    passed = reduce(Column.__and__, [(F.col(f"_g_{f}") == 1) | ~F.col(f) for f in filters], F.col("_all") == 0)
    mask = reduce(Column.__add__, [(1 - F.col(f"_g_{f}").cast("int")) * (1 << i) for i, f in enumerate(filters)])
    return written(cube.where(passed).select(F.col(part).alias("part"), mask.alias("mask"), "n", *measures), "survivors")


def steps(filters: list[str]) -> list[tuple[str, int, str, int, int, int, int]]:
    """Rows (filter_order, step, filter, before, upto, alone, others): every step of every order, with the subsets of
    the filters before it, up to it, of itself and of all others, as masks."""
    bit, every, out = {f: 1 << i for i, f in enumerate(filters)}, (1 << len(filters)) - 1, []
    for order in permutations(filters):
        before = 0
        for k, f in enumerate(order, 1):
            out.append(("".join(order), k, f, before, before | bit[f], bit[f], every ^ bit[f]))
            before |= bit[f]
    return out


def audit(flagged: DataFrame, filters: list[str], *, part: str = "part", lost: dict[str, str] | None = None) -> DataFrame:
    """One row for each part, order of the filters and step of it: filter_order, step, filter, kept, removed, redundant,
    unique_fails, shapley, and for each name of lost the sum of that measure over what the step removes.

    flagged has a boolean for each filter (true: fails), the part and the measures; up to seven filters.
    """
    lost = lost or {}
    found = survivors(flagged, filters, part, list(lost.values()))
    spark = flagged.sparkSession
    plan = spark.createDataFrame(steps(filters), "filter_order string, step int, filter string, _before int, _upto int, _alone int, _others int")
    every = (1 << len(filters)) - 1
    values = ["n", *lost.values()]
    subsets = found.where("mask = 0").select("part", F.col("n").alias("_all"), F.explode(F.sequence(F.lit(0), F.lit(every))).alias("mask"))
    subsets = written(subsets.join(found, ["part", "mask"], "left").fillna(0, values), "subsets")
    # at most 5,040 orders of seven steps, met by each part's subsets
    rows = subsets.join(F.broadcast(plan), F.col("mask") == F.col("_before")).withColumn("_every", F.lit(every))
    rows = rows.drop("mask").withColumnsRenamed({c: f"_before_{c}" for c in values})
    for at in ("_upto", "_alone", "_others", "_every"):
        side = subsets.select(F.col("part").alias("_p"), F.col("mask").alias("_m"), *[F.col(c).alias(f"{at}_{c}") for c in values])
        rows = rows.join(side, (F.col("part") == F.col("_p")) & (F.col(at) == F.col("_m"))).drop("_p", "_m")

    def passed(at: str, what: str = "n") -> Column:
        return F.col(f"{at}_{what}").cast("long")

    removed = passed("_before") - passed("_upto")
    rows = rows.select(
        "part",
        "filter_order",
        "step",
        "filter",
        passed("_upto").alias("kept"),
        removed.alias("removed"),
        (F.col("_all") - passed("_alone") - removed).alias("redundant"),
        (passed("_others") - passed("_every")).alias("unique_fails"),
        *[(passed("_before", m) - passed("_upto", m)).alias(name) for name, m in lost.items()],
    )
    rows = written(rows, "steps")
    shares = rows.groupBy(F.col("part").alias("_p"), F.col("filter").alias("_f")).agg(F.sum("removed").alias("shapley"))
    return rows.join(shares, (F.col("part") == F.col("_p")) & (F.col("filter") == F.col("_f"))).drop("_p", "_f")


def labelled(flagged: DataFrame, labels: DataFrame) -> DataFrame:
    """flagged with the longs good and toxic, 1 for documents that a row of labels calls so."""
    says = [F.max(F.when(F.col(c) == 1, 1).otherwise(0)).cast("long").alias(out) for c, out in (("quality", "good"), ("toxic", "toxic"))]
    known = written(labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_d")).agg(*says), "labels")
    return flagged.join(known, F.col("doc_id") == F.col("_d"), "left").drop("_d").fillna(0, ["good", "toxic"])


def op11_filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    flagged = labelled(failures(docs), labels.select("doc_id", "quality", "toxic"))
    out = audit(flagged, list(FILTERS), lost={"good_lost": "good", "toxic_lost": "toxic"})
    return out.select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
