"""Near duplicates by fast similarity sketching, banding and exact verification.

Sketch: in round i every shingle is hashed with seed i to a bin and a value, and a bin that no earlier round has
filled keeps its least value; from round COORDINATES on, round COORDINATES + b throws every shingle into bin b, so that
all coordinates are filled. Coordinates agree with the probability of the Jaccard similarity, with the concentration
of independent samples. Bands of ROWS coordinates are candidates' buckets: at a similarity of 0.85 a pair shares none
of the BANDS bands with probability (1 - 0.85^6)^32 < 3e-7, at 0.3 it shares one with 2 %.

Links are confirmed on the full sets of 64-bit shingle hashes. Groups are not expanded into pairs. Equal texts are
one node. In each bucket the members are compared with its leader, the one that shares most buckets with others, which
in a group of copies is the text they come from. Where members stay in different components, _rest() finds all
pairs that may still link them by an index of their differences from the leader; no link is lost to the shortcut.

Long texts are sketched in runs of whole words and their sketches merged; the sets themselves are rows until the
confirmation, which holds two at a time.

Defined cases: null, empty and blank texts have no shingles and are linked with nothing, not even each other;
rows of equal text are linked; different texts under one id are linked only if they are similar; rows without an id
are linked like others, but a group's id is the smallest that is there, or null, so that the column group tells groups
without ids apart; ids are of any type that can be compared; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm.common import LONG_TEXT, RUN_WORDS, lower_ascii, same_rows, small_batches, word_runs, written
from logweave.operators.graph import components

WORDS = 5
SIMILARITY = 80
BANDS, ROWS = 32, 6
COORDINATES = BANDS * ROWS
BLANK = r"\x20\x09-\x0D"
SPACE = f"[{BLANK}]+"
#: Shingles that are sketched at once, unless one text has more.
BLOCK = 400_000
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: A row's id and two hashes of its text.
KEYS = ["doc_id", "h", "h2", "c"]


def shingles(text: Column, words: int, whole: Column | None = None) -> Column:
    """Distinct hashes of the runs of that many words; a shorter text is one run, or has none if whole is false."""
    # the word array is bound once, in a one-element transform, for the places that use it
    hashes = F.transform(
        F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SPACE, -1), ""), lambda w: F.xxhash64(w)
    )

    def runs(h: Column) -> Column:
        n = F.size(h)
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), n - words))
        each = F.array_distinct(F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(words)])))
        some = n > 0 if whole is None else (n >= words) | ((n > 0) & whole)
        return F.when(some, each).otherwise(F.array().cast("array<long>"))

    return F.get(F.transform(F.array(hashes), runs), 0)


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finalizer of x under a seed."""
    x = x + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketches(values: np.ndarray, sizes: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """Row d holds the sketch of the d-th set; values has the sets one after another. Sets must not be empty."""
    values = values.astype(np.uint64, copy=False)
    out = np.full(len(sizes) * coordinates, _EMPTY, np.uint64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    for r in range(2 * coordinates):
        h = _mix(values, r + 1)
        if r < coordinates:
            at = doc * coordinates + (((h >> np.uint64(32)) * np.uint64(coordinates)) >> np.uint64(32)).astype(np.int64)
        else:
            at = doc * coordinates + (r - coordinates)
        # values of a later round are larger than any of an earlier one: they only fill what is empty
        np.minimum.at(out, at, (h & np.uint64(0xFFFFFFFF)) | np.uint64(r << 32))
        open_doc = (out.reshape(-1, coordinates) == _EMPTY).any(axis=1)
        if not open_doc.any():
            break
        keep = open_doc[doc]
        if not keep.all():
            values, doc = values[keep], doc[keep]
    return out.reshape(-1, coordinates)


def bands(sketch: np.ndarray) -> np.ndarray:
    parts = sketch.reshape(len(sketch), BANDS, ROWS)
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2]).copy()
    for j in range(ROWS):
        h = _mix(h ^ parts[:, :, j], j + 1000)
    return h.view(np.int64)


def _keys(batch: pa.RecordBatch) -> list[pa.Array]:
    return [batch.column(c) for c in KEYS]


def _lists(rows: np.ndarray, has: np.ndarray) -> pa.ListArray:
    """The rows as lists; an empty list where has is false."""
    width = rows.shape[1]
    ends = np.concatenate([[0], np.cumsum(has * width)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows[has].reshape(-1)))


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes, and the bands of sets that are whole texts, or the sketches of sets that are parts of one."""
    for batch in batches:
        sets = batch.column("set")
        ends = np.asarray(sets.offsets)
        flat = np.asarray(sets.values).view(np.uint64)
        sizes, part = np.diff(ends), np.asarray(batch.column("part"))
        found, whole = np.zeros((len(sizes), BANDS), np.int64), np.zeros((len(sizes), COORDINATES if part.any() else 1), np.int64)
        at = 0
        while at < len(sizes):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + BLOCK, "right")) - 1)
            full = np.arange(at, to)[sizes[at:to] > 0]
            if len(full):
                sketch = sketches(flat[ends[at] : ends[to]], sizes[full])
                found[full] = bands(sketch)
                if part[full].any():
                    whole[full] = sketch.view(np.int64)
            at = to
        n, has = pa.array(sizes.astype(np.int64)), sizes > 0
        arrays = [*_keys(batch), batch.column("part"), n, _lists(found, has & ~part), _lists(whole, has & part)]
        yield pa.RecordBatch.from_arrays(arrays, names=[*KEYS, "part", "n", "bands", "sketch"])


def _merged_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sketch = np.asarray(batch.column("sketch").values).view(np.uint64).reshape(-1, COORDINATES)
        lists = _lists(bands(sketch), np.ones(len(sketch), bool))
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("h", "h2", "least", "n")], lists], names=["h", "h2", "least", "n", "bands"])


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    met = pairs.select("a", "b").join(left, "a").join(right, "b")
    both = F.size(F.array_intersect("sa", "sb"))
    met = met.select("a", "b", both.alias("x"), (F.size("sa") + F.size("sb")).alias("n"))
    return met.where(100 * F.col("x") >= similarity * (F.col("n") - F.col("x"))).select("a", "b")


def _fits(n: str, m: str, similarity: int) -> Column:
    return 100 * F.least(n, m) >= similarity * F.greatest(n, m)


def _pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _with_component(members: DataFrame, comps: DataFrame) -> DataFrame:
    named = comps.select(F.col("node"), "component")
    return members.join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _most_apart(n: Column, m: Column, similarity: int) -> Column:
    """How many shingles two linked sets of these sizes may not share: x / (n + m - x) >= s bounds n + m - 2 x."""
    return F.floor((n + m) * (100 - similarity) / (100 + similarity)).cast("int")


def _rest(members: DataFrame, leads: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """All pairs that may link different components, without looking at all pairs of a bucket.

    Where a bucket's members are in several components, each member x is described by its difference D(x) from the
    set of the bucket's leader. Two members of different components are not both linked to the leader, so if they are
    similar enough, at most T shingles apart, their differences must share (|D(x)| + |D(y)| - T) / 2 elements, which
    is above zero. Hence the T + 1 rarest elements of both share one, and at the first that they share enough must be
    left on both sides. Both conditions are exact: they only leave out pairs that cannot link.
    """
    mixed = members.groupBy("key").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"))
    open_ = members.join(mixed.where("_lo <> _hi").select("key"), "key").join(leads.select("key", "to"), "key")
    around = written(open_.select("to", "node", "n", "component").distinct(), "around")
    sizes = around.groupBy("to", "component").agg(F.count(F.lit(1)).alias("c"))
    main = sizes.groupBy("to").agg(F.max(F.struct("c", "component")).alias("m"))
    # stored, so that the join's sides are bare shuffles, whose large partitions can be split
    main = written(main.select("to", F.col("m.component").alias("main")), "main")
    around = around.join(main, "to").withColumn("apart", F.col("component") != F.col("main")).drop("main")
    met = around.join(sets.select("node", F.col("set").alias("sx")), "node")
    met = met.join(sets.select(F.col("node").alias("to"), F.col("set").alias("sl")), "to")
    missing = F.transform(F.array_except("sl", "sx"), lambda v: F.bitwise_not(v))
    met = met.withColumn("d", F.concat(F.array_except("sx", "sl"), missing)).drop("sx", "sl")
    each = written(met.withColumn("size", F.size("d")).withColumn("e", F.explode_outer("d")).drop("d").where("e is not null"), "differences")
    common = each.groupBy("to", "e").agg(F.count(F.lit(1)).alias("f"))
    rarest = Window.partitionBy("to", "node").orderBy("f", "e")
    each = each.join(common, ["to", "e"]).withColumn("place", F.row_number().over(rarest))
    largest = F.floor(F.col("n") * 100 / similarity).cast("int")
    each = each.where(F.col("place") <= _most_apart(F.col("n"), largest, similarity) + 1)
    each = written(each.where("f > 1").drop("f"), "prefixes")
    other = each.select("to", "e", *[F.col(c).alias(f"_{c}") for c in ("node", "n", "component", "size", "place")])
    need = (F.col("size") + F.col("_size") - _most_apart(F.col("n"), F.col("_n"), similarity)) / 2
    enough = 1 + F.least(F.col("size") - F.col("place"), F.col("_size") - F.col("_place")) >= need
    met = each.where("apart").join(
        other, (each["to"] == other["to"]) & (each["e"] == other["e"]) & (F.col("component") != F.col("_component")) & _fits("n", "_n", similarity) & enough
    )
    return met.select(*_pair(F.col("node"), F.col("_node"))).distinct()


def _links(members: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Confirmed pairs that connect what the members of a bucket (key, node, n, score) can connect."""
    leads = members.groupBy("key").agg(F.max(F.struct("score", "node", "n")).alias("lead"))
    leads = written(leads.select("key", F.col("lead.node").alias("to"), F.col("lead.n").alias("m")), "leads")
    met = members.join(leads, "key").where((F.col("node") != F.col("to")) & _fits("n", "m", similarity))
    first = written(met.select(*_pair(F.col("node"), F.col("to"))).distinct(), "pairs")
    links = written(_confirmed(first, sets, similarity), "links")
    now = written(_with_component(members, components(links)), "members")
    rest = written(_rest(now, leads, sets, similarity), "rest")
    return written(links.unionByName(_confirmed(rest, sets, similarity)), "links")


def _sets(docs: DataFrame, keep: list[Column], text: Column, words: int, long_text: int, run_words: int) -> DataFrame:
    """keep and (c, part, set): the shingles of whole texts, or, where part is true, those that begin in the c-th run of
    a long text's words."""
    runs = word_runs(F.col("_text"), BLANK, max(1, words - 1), long_text=long_text, run_words=run_words)
    # what is worked out of the text stands below the runs, so that these do not carry it
    keyed = docs.select(*keep, F.coalesce(text, F.lit("")).alias("_text"))
    each = keyed.select(*[c for c in keyed.columns if c != "_text"], F.posexplode_outer(runs).alias("c", "x"))
    joined = F.when(F.col("x.next").isNull(), F.col("x.run")).otherwise(F.concat_ws(" ", "x.run", "x.next"))
    first = F.coalesce(F.col("c") == 0, F.lit(True))
    part = ~first | F.col("x.next").isNotNull()
    return each.select("*", part.alias("part"), shingles(joined, words, first).alias("set")).drop("x")


def _of_long_texts(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (h, h2, least, n, bands) of the texts that were sketched in parts: the sketch of a union is the least of its
    parts' in every coordinate. sets has all their shingles."""
    by = ["h", "h2"]
    parts = rows.where("part")
    each = parts.select(*by, F.posexplode("sketch").alias("at", "v")).groupBy(*by, "at").agg(F.min("v").alias("v"))
    sketch = each.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias("sketch"))
    n = sets.select(*by, F.explode_outer("set").alias("x")).where("x is not null").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    least = parts.groupBy(*by).agg(F.min("doc_id").alias("least"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"h long, h2 long, least {id_type}, n long, bands array<long>"
    return sketch.join(n, by).join(least, by).select(*by, "least", "n", "sketch").mapInArrow(_merged_batches, schema)


def near_duplicates(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    similarity: int = SIMILARITY,
    long_text: int = LONG_TEXT,
    run_words: int = RUN_WORDS,
) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, the smallest id that links reach, group, a number of the linked
    texts, kept, true for one text of each group, and h and h2, hashes of the text. similarity is in per cent."""
    spark, body, long = docs.sparkSession, F.col(text), (words, long_text, run_words)
    hashes = [F.xxhash64(body).alias("h"), F.xxhash64(F.lit(7), body).alias("h2")]
    id_type = docs.select(F.col(doc_id)).schema[0].dataType.simpleString()
    schema = f"doc_id {id_type}, h long, h2 long, c int, part boolean, n long, bands array<long>, sketch array<long>"
    each = _sets(docs, [F.col(doc_id).alias("doc_id"), *hashes], body, *long).mapInArrow(_sketch_batches, schema)
    with small_batches(spark):
        rows = written(each, "sketches")
    nodes = rows.where("n > 0 and not part").groupBy("h", "h2").agg(
        F.min("doc_id").alias("least"),
        F.first("n").alias("n"),
        F.first("bands").alias("bands"),
    )
    any_long = rows.where("part").limit(1).count() > 0
    if any_long:
        beyond = _sets(docs.where(F.octet_length(body) > long_text), hashes, body, *long)
        with small_batches(spark):
            nodes = nodes.unionByName(written(_of_long_texts(rows, beyond), "long-sketches"))
    # ids may be shared by different texts, so the text makes the node
    nodes = written(nodes.withColumn("node", F.xxhash64("h", "h2")), "nodes")
    each = nodes.select("node", "n", F.explode("bands").alias("key"))
    counts = each.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    members = written(each.join(counts, "key"), "buckets")
    score = members.groupBy("node").agg(F.sum("c").alias("score"))
    members = written(members.drop("c").join(score, "node"), "scored")
    wanted = nodes.select("node", "h", "h2").join(score.select("node"), "node")
    # one row of each wanted text; copies have equal sets
    texts = docs.select(*hashes, body.alias("t")).join(wanted, ["h", "h2"]).groupBy("node").agg(F.first("t").alias("t"))
    if any_long:
        texts = written(texts, "texts")
        sets = texts.where(F.octet_length("t") <= long_text).select("node", shingles(F.col("t"), words).alias("set"))
        beyond = _sets(texts.where(F.octet_length("t") > long_text), [F.col("node")], F.col("t"), *long)
        sets = sets.unionByName(beyond.select("node", F.explode_outer("set").alias("x")).groupBy("node").agg(F.collect_set("x").alias("set")))
    else:
        sets = texts.select("node", shingles(F.col("t"), words).alias("set"))
    comps = components(_links(members, written(sets, "sets"), similarity))
    linked = comps.select("node", "component").join(nodes.select("node", "least"), "node")
    # the group's id is the smallest that is there, and its text the one that has it
    head = F.min(F.struct(F.col("least").isNull().alias("x"), "least", "node")).alias("_head")
    heads = written(linked.groupBy("component").agg(F.min("least").alias("_least"), head), "heads")
    linked = linked.select("node", "component").join(heads, "component")
    linked = linked.select("node", "_least", F.col("_head.node").alias("_to"), F.col("component").alias("_group"))
    named = nodes.select("h", "h2", "node", "n", "least").join(linked, "node", "left").select(
        F.col("h").alias("_h"),
        F.col("h2").alias("_h2"),
        F.col("n").alias("_n"),
        F.when(F.col("_to").isNotNull(), F.col("_least")).otherwise(F.col("least")).alias("_id"),
        F.coalesce("_group", "node").alias("group"),
        F.coalesce(F.col("_to") == F.col("node"), F.lit(True)).alias("_first"),
    )
    rows = rows.where("c is null or c = 0").select("doc_id", "h", "h2", "n")
    met = rows.join(named, same_rows([F.col("h"), F.col("h2")], [F.col("_h"), F.col("_h2")]) & (F.col("n") > 0), "left")
    some = F.col("_h").isNotNull()
    smallest = F.when(some, F.col("_id")).otherwise(F.col("doc_id"))
    return met.select(
        "doc_id",
        F.coalesce("_n", "n").alias("n_shingles"),
        smallest.alias("component_id"),
        "group",
        (~some | (F.col("_first") & F.col("doc_id").eqNullSafe(smallest))).alias("kept"),
        "h",
        "h2",
    )


def op4_near_duplicates(docs: DataFrame) -> DataFrame:
    """The contract's query: three-word shingles and a similarity of 0.85."""
    out = near_duplicates(docs, words=3, similarity=85)
    return out.select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )
