"""Benchmark decontamination by winnowing, in DataFrame functions only.

Every 13-word window of a text holds eight consecutive 6-word grams; the least of their hashes is the
window's fingerprint. Equal windows choose equal grams, so a passage that a document and a benchmark item
share over 13 words or more always meets in the join of fingerprints. Each meeting is then extended: the
windows around the gram are compared word by word along the diagonal, and only equal ones count.
Items of fewer than 13 words are one window each; their whole length is the gram.

Long texts are read in runs of whole words that overlap by a window less a word, so that no array grows with a text.
Hits are rows (document, first word, word behind the last, item) from the join to the last count.

Defined cases: a null or word-less text has no words, no hits and is not contaminated; a null or word-less
item matches nothing; an item id that is null is written as "null"; repeated document rows give one result
row each, repeated items count once; other columns of the inputs are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm.common import LONG_TEXT, RUN_WORDS, lower_ascii, same_rows, word_runs, written

WINDOW = 13
GRAM = 6
PER_WINDOW = WINDOW - GRAM + 1
#: Low bits of a fingerprint hold the gram's position in its run of words. A text of up to LONG_TEXT bytes is one run.
POSITION_BITS = 20
POSITION_MASK = (1 << POSITION_BITS) - 1
#: What separates words: in the text as it is, and when A-Z is lower-cased.
SPACE = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fingerprints of the benchmark are broadcast up to this many rows of about 250 bytes; beyond it they are shuffled.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """Words of a text: lower-cased A-Z, digits and everything beyond ASCII."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS, -1), "")


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _starts(n: Column) -> Column:
    """0 .. n - 1; empty if n is not above 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _grams(hashes: Column, size: int) -> Column:
    """Per start position, the hash of that many words with the position in its low bits."""

    def gram(i: Column) -> Column:
        key = F.xxhash64(*[F.get(hashes, i + k) for k in range(size)], F.lit(size))
        return key.bitwiseAND(F.lit(~POSITION_MASK)).bitwiseOR(i.cast("long"))

    return F.transform(_starts(F.size(hashes) - (size - 1)), gram)


def _winnow(grams: Column) -> Column:
    """The least gram of each window, once."""
    starts = _starts(F.size(grams) - (PER_WINDOW - 1))
    return F.array_distinct(F.transform(starts, lambda i: F.least(*[F.get(grams, i + k) for k in range(PER_WINDOW)])))


def _fingerprints(df: DataFrame, short: list[int], out: str) -> DataFrame:
    """Adds the array of fingerprints of column wh; short: lengths of items below a window, whose grams all count."""
    df = df.withColumn("_grams", _grams(F.col("wh"), GRAM)).withColumn(out, _winnow(F.col("_grams"))).drop("_grams")
    for size in short:
        df = df.withColumn(out, F.concat(out, _grams(F.col("wh"), size)))
    return df


def _key(packed: Column) -> Column:
    return F.shiftright(packed, POSITION_BITS)


def _pos(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(POSITION_MASK)).cast("int")


def _runs(docs: DataFrame, doc_id: str, text: str, long_text: int, run_words: int) -> DataFrame:
    """Rows (doc_id, thash, c, own, wh): of the c-th run of a text's words, how many are its own, and the hashes of
    these and of the WINDOW - 1 words behind them."""
    # what is worked out of the text stands below the runs, so that these do not carry it
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("thash"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    each = word_runs(F.col("text"), SPACE, WINDOW - 1, long_text=long_text, run_words=run_words)
    runs = keyed.select("doc_id", "thash", F.posexplode_outer(each).alias("c", "x"))
    joined = F.when(F.col("x.next").isNull(), F.col("x.run")).otherwise(F.concat_ws(" ", "x.run", "x.next"))
    runs = runs.select("doc_id", "thash", F.coalesce("c", F.lit(0)).alias("c"), F.col("x.next").isNull().alias("last"), word_hashes(joined).alias("wh"))
    return runs.select("doc_id", "thash", "c", F.when(F.col("last"), F.size("wh")).otherwise(F.lit(run_words)).alias("own"), "wh")


def benchmark_fingerprints(
    bench: DataFrame, id_col: str, text_col: str, long_text: int = LONG_TEXT, run_words: int = RUN_WORDS
) -> tuple[DataFrame, list[int]]:
    """Rows (key, item, ipos, win, first, near): near holds the item's words around the gram, first is the place of its first word."""
    items = bench.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).alias("t")).distinct()
    items = _runs(items, "item", "t", long_text, run_words).where((F.size("wh") > 0) & ((F.col("c") == 0) | (F.size("wh") >= WINDOW)))
    items = items.select(F.col("doc_id").alias("item"), "wh")
    short = sorted(
        r[0] for r in items.where(F.size("wh") < WINDOW).select(F.size("wh").alias("n")).distinct().collect()
    )  # at most twelve lengths
    long_items = _fingerprints(items.where(F.size("wh") >= WINDOW), [], "fp").withColumn("win", F.lit(WINDOW))
    parts = [long_items]
    for size in short:
        parts.append(
            items.where(F.size("wh") == size).withColumn("fp", _grams(F.col("wh"), size)).withColumn("win", F.lit(size))
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.select("item", "wh", "win", F.explode_outer("fp").alias("p")).where("p is not null").select(
        "item", "wh", "win", _key(F.col("p")).alias("key"), _pos(F.col("p")).alias("ipos")
    )
    first = F.greatest(F.lit(0), F.col("ipos") - (PER_WINDOW - 1))
    return out.select(
        "key",
        "item",
        "ipos",
        "win",
        first.alias("first"),
        F.slice("wh", first + 1, WINDOW + PER_WINDOW + 1).alias("near"),
    ).distinct(), short


def _met_words(df: DataFrame) -> DataFrame:
    """For column wh, and p on rows that met, adds dpos, the gram's place, and around, the document's words from place
    afirst on that windows with this gram can hold. A few words ride on in place of the whole run of words."""
    df = df.withColumn("dpos", _pos(F.col("p")))
    df = df.withColumn("afirst", F.greatest(F.lit(0), F.col("dpos") - (PER_WINDOW - 1)))
    around = F.slice("wh", F.col("afirst") + 1, WINDOW + PER_WINDOW - 1)
    return df.withColumn("around", F.when(F.col("p") != -1, around)).drop("wh")


def _equal_windows() -> Column:
    """Starts, in the document, of the windows around a met gram that equal the item's."""
    shift = F.col("dpos") - F.col("ipos")
    lo = F.greatest(F.col("first"), F.col("afirst") - shift)
    hi = F.least(
        F.col("ipos"),
        F.col("first") + F.size("near") - F.col("win"),
        F.col("afirst") + F.size("around") - shift - F.col("win"),
    )
    found = F.filter(
        F.sequence(lo, hi),
        lambda j: F.slice(F.col("around"), j + shift - F.col("afirst") + 1, F.col("win"))
        == F.slice(F.col("near"), j - F.col("first") + 1, F.col("win")),
    )
    spans = F.transform(
        found, lambda j: F.struct((j + shift).alias("s"), (j + shift + F.col("win")).alias("e"))
    )
    return F.when(lo <= hi, spans)


def meetings(
    docs: DataFrame,
    bench: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    broadcast_rows: int = BROADCAST_ROWS,
    long_text: int = LONG_TEXT,
    run_words: int = RUN_WORDS,
) -> DataFrame:
    """Rows (doc_id, thash, c, own, item, s, e), stored: for each run of words of each document one without an item, and
    for each window of an item that occurs in it, at the words s to e - 1 of the document, one with the item.

    One pass over the documents. The benchmark's fingerprints are broadcast if there are at most broadcast_rows
    of them; otherwise both sides are shuffled by fingerprint and the words of runs that met are joined back.

    Generated code holds all rows that it makes of one run of words until it is left. Hence what leaves it are met
    fingerprints with the words around them, stored before each is paired with the items that have it.
    """
    fps, short = benchmark_fingerprints(bench, item_id, item_text, long_text, run_words)
    fps = written(fps, "fingerprints")
    small = fps.limit(broadcast_rows + 1).count() <= broadcast_rows
    base = _runs(docs, doc_id, text, long_text, run_words)
    # the first row of each run stands for itself; its key is outside the fingerprints' range and evenly dealt
    mark = F.col("p") == -1
    prints = _fingerprints(base, short, "fp").select(
        "doc_id", "thash", "c", "own", "wh", F.explode_outer(F.concat(F.array(F.lit(-1).cast("long")), F.col("fp"))).alias("p")
    )
    key = F.when(mark, F.lit(1 << 60) + F.pmod(F.col("thash"), F.lit(1 << 20))).otherwise(_key(F.col("p")))
    prints = prints.withColumn("key", key)
    if small:
        keys = F.broadcast(fps.select("key", F.lit(True).alias("known")).distinct())
        met = _met_words(prints.join(keys, "key", "left").where(mark | F.col("known")).drop("known"))
        met = written(met, "met").join(F.broadcast(fps), "key", "left")
    else:
        met = written(prints.drop("wh").join(fps, "key", "left").where(mark | F.col("item").isNotNull()), "met")
        at = ["doc_id", "thash", "c"]
        wanted = met.where(~mark).select(*[F.col(k).alias(f"_{k}") for k in at]).distinct()
        same = same_rows([F.col(k) for k in at], [F.col(f"_{k}") for k in at])
        rows = base.join(wanted, same).groupBy(*[f"_{k}" for k in at]).agg(F.first("wh").alias("wh"))
        met = _met_words(met.join(rows, same, "left").drop(*[f"_{k}" for k in at]))
    met = met.select(
        "doc_id",
        "thash",
        "c",
        F.when(mark, F.col("own")).alias("own"),
        F.when(~mark, F.col("item")).alias("item"),
        F.when(~mark, _equal_windows()).alias("spans"),
    )
    # a condition on the array would be moved below and compute it twice
    met = met.select("doc_id", "thash", "c", "own", "item", F.explode_outer("spans").alias("x")).where("own is not null or x is not null")
    first = F.col("c").cast("long") * run_words
    return written(met.select("doc_id", "thash", "c", "own", "item", (first + F.col("x.s")).alias("s"), (first + F.col("x.e")).alias("e")), "meetings")


def contamination(docs: DataFrame, bench: DataFrame, **kw) -> DataFrame:
    """Per document row: doc_id, thash (the text's hash), n_words, n_hit (words inside occurring windows), items (those
    whose windows occur, sorted) and spans, the longest stretches [s, e) of hit words. Arguments as those of meetings()."""
    met = meetings(docs, bench, **kw)
    by = ["doc_id", "thash"]
    runs = F.sum("own").cast("long").alias("_words"), F.count(F.when(F.col("c") == 0, 1)).alias("_rows")
    rows = met.where("own is not null").groupBy(*by).agg(*runs)
    hits = met.where("item is not null")
    # windows from one word on are combined before the shuffle; a document's are then read in order, never held
    ends = hits.groupBy(*by, "s").agg(F.max("e").alias("e"))
    before = Window.partitionBy(*by).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("reach", F.max("e").over(before))
    begins = F.col("reach").isNull() | (F.col("s") > F.col("reach"))
    upto = Window.partitionBy(*by).orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("stretch", F.sum(begins.cast("int")).over(upto))
    ends = ends.groupBy(*by, "stretch").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    spans = ends.groupBy(*by).agg(F.sum(F.col("e") - F.col("s")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("s", "e"))).alias("spans"))
    items = hits.select(*by, "item").distinct().groupBy(*by).agg(F.array_sort(F.collect_list("item")).alias("items"))
    found = spans.join(items.withColumnsRenamed({b: f"_{b}" for b in by}), same_rows([F.col(b) for b in by], [F.col(f"_{b}") for b in by]))
    found = found.select(*[F.col(b).alias(f"_{b}") for b in by], "n_hit", "spans", "items")
    out = rows.join(found, same_rows([F.col(b) for b in by], [F.col(f"_{b}") for b in by]), "left")
    out = out.select(
        *by,
        F.expr("_words div _rows").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<s:bigint,e:bigint>>")).alias("spans"),
        "_rows",
    )
    return out.withColumn("_one", F.explode(F.array_repeat(F.lit(1), F.col("_rows").cast("int")))).drop("_one", "_rows")


def decontaminate(docs: DataFrame, bench: DataFrame, **kw) -> DataFrame:
    """contamination() with n_items and contaminated: at least a word of twenty is hit."""
    return contamination(docs, bench, **kw).select(
        "doc_id",
        "thash",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        "items",
        "spans",
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def op1_decontaminate(docs: DataFrame, bench: DataFrame) -> DataFrame:
    out = decontaminate(docs, bench)
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )
