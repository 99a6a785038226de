"""Tab-separated logs whose header lines name the fields, read by splits.

A header holds until the next one, so a line's meaning may stand in another split. Lines are stored once with their file,
the start of their split and a number that rises within it. Header lines are few: what they set is carried forward within
each split, then from split to split by each split's last values, and gives segments of lines with one meaning. Lines
meet their segment by split and block of line numbers, so that a file is as many tasks as it has splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.operators.carry import carried
from logweave.operators.enrich import bounded
from logweave.scratch import written
from logweave.sources.json_formats import zeek_events

#: Lines of a block: a segment is joined once for each block that it has lines in.
BLOCK = 256
SPLIT = ["file", "start"]


def _separator(spec: Column) -> Column:
    """The character of a "\\x09" specification; anything else stands for itself."""
    digits = F.regexp_extract(spec, r"(?i)^\\x([0-9a-f]+)$", 1)
    return F.when(digits != "", F.char(F.conv(digits, 16, 10).cast("int"))).when(spec != "", spec).otherwise("\t")


def _quoted(sep: Column) -> Column:
    return F.concat(F.lit(r"\Q"), sep, F.lit(r"\E"))


def _last_places(n: Column) -> Column:
    """The places of the first n names, of equal ones the last."""
    return F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~F.array_contains(F.slice("names", i + 2, n - i - 1), F.get("names", i)))


def _segments(lines: DataFrame) -> DataFrame:
    """Stored rows (file, start, lo, hi, sep, path, unset, empty, names, keep): lines above lo and below hi are records
    with these settings; keep has the places of the fields, of equal names the last."""
    head = lines.where(F.col("value").startswith("#")).select(*SPLIT, "line", "value")
    # every split takes part, so that what stands before it reaches it
    opening = lines.groupBy(*SPLIT).agg((F.min("line") - 1).alias("line")).withColumn("value", F.lit(None).cast("string"))
    head = written(head.unionByName(opening), "headers")
    sep = F.when(F.col("value").startswith("#separator"), _separator(F.btrim(F.regexp_extract("value", r"^#separator\S* ?(.*)$", 1))))
    head = carried(head.withColumn("sep", sep), ["file"], "start", "line", ["sep"]).withColumn("sep", F.coalesce("sep", F.lit("\t")))
    at = F.instr(F.col("value"), F.col("sep"))
    key = F.btrim(F.when(at > 0, F.substring("value", F.lit(2), at - 2)).otherwise(F.substring("value", 2, 1 << 30)))
    rest = F.when(at > 0, F.substring("value", at + F.length("sep"), F.lit(1 << 30))).otherwise("")
    head = head.withColumn("key", F.when(~F.col("value").startswith("#separator"), key)).withColumn("rest", rest)
    value_of = lambda name: F.when(F.col("key") == name, F.btrim("rest"))
    head = head.select(
        *SPLIT, "line", "sep", F.when(F.col("key") == "fields", F.split("rest", _quoted(F.col("sep")), -1)).alias("names"),
        value_of("path").alias("path"), value_of("unset_field").alias("unset"), value_of("empty_field").alias("empty"),
    )
    head = carried(head, ["file"], "start", "line", ["names", "path", "unset", "empty"]).where("names is not null")
    following = Window.partitionBy(*SPLIT).orderBy("line")
    out = head.withColumn("hi", F.coalesce(F.lead("line").over(following), F.lit((1 << 63) - 1))).where("hi > line + 1")
    return written(
        out.select(*SPLIT, F.col("line").alias("lo"), "hi", "sep", F.coalesce("path", F.lit("conn")).alias("path"),
                   F.coalesce("unset", F.lit("-")).alias("unset"), F.coalesce("empty", F.lit("(empty)")).alias("empty"), "names", _last_places(F.size("names")).alias("keep")),
        "segments",
    )


def tsv_records(lines: DataFrame) -> DataFrame:
    """Rows (raw): the records of stored lines (file, start, line, value) as JSON objects, with the log's name in _path."""
    segments = _segments(lines)
    ends = lines.groupBy(*SPLIT).agg(F.max("line").alias("_end"))
    blocks = F.sequence(F.expr(f"(lo + 1) div {BLOCK}"), F.expr(f"least(hi - 1, _end) div {BLOCK}"))
    segments = segments.join(ends, SPLIT).where("lo < _end").select("*", F.explode(blocks).alias("block")).drop("_end")
    rows = lines.where((F.col("value") != "") & ~F.col("value").startswith("#")).withColumn("block", F.expr(f"line div {BLOCK}"))
    met = rows.join(bounded(written(segments, "segment-blocks")), [*SPLIT, "block"]).where("line > lo and line < hi")
    values = met.select("path", "unset", "empty", "names", "keep", F.split("value", _quoted(F.col("sep")), -1).alias("v"))
    # a line with fewer values than there are names has the first of them
    short = (F.size("v") < F.size("names")) & (F.size("keep") < F.size("names"))
    places = F.when(short, _last_places(F.size("v"))).otherwise(F.col("keep"))
    there = F.filter(places, lambda i: (i < F.size("v")) & ~F.get("v", i).isin(F.col("unset"), F.col("empty")))
    fields = F.map_from_entries(F.transform(there, lambda i: F.struct(F.get("names", i), F.get("v", i))))
    fields = F.map_filter(fields, lambda k, v: k != "_path")
    return values.select(F.to_json(F.map_concat(F.create_map(F.lit("_path"), F.col("path")), fields)).alias("raw"))


def zeek_tsv_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Events of log files, split as the file system allows."""
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"), "value"
    )
    return zeek_events(tsv_records(written(rows, "lines")))


def zeek_tsv(rows: DataFrame) -> DataFrame:
    """Events of rows whose column value is a whole file each."""
    texts = rows.select(F.monotonically_increasing_id().cast("string").alias("file"), "value")
    lines = texts.select("file", F.posexplode_outer(F.split("value", "\r?\n", -1)).alias("line", "value")).where("value is not null")
    return zeek_events(tsv_records(written(lines.select("file", F.lit(0).cast("long").alias("start"), F.col("line").cast("long").alias("line"), "value"), "lines")))
