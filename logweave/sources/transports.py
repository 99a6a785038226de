"""Collector envelopes, dispatch by format, and the CSV export."""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.sources.detect import PARSERS

_COUNTED = re.compile(rb"([0-9]+) (?=<)")

#: No message of a stream is longer; what follows is a sender's error.
LONGEST_MESSAGE = 1024 * 1024


def framed(stream: bytes) -> list[tuple[str, int]]:
    """Messages of a recorded TCP syslog stream, each with the number of its bytes beyond LONGEST_MESSAGE, which are left
    out: counted octets where a count stands before a priority, else lines. A counted message that the stream ends in
    goes, as it is not whole; a last line without an end is kept."""
    out, at = [], 0
    while at < len(stream):
        counted = _COUNTED.match(stream, at)
        if counted:
            first = counted.end()
            at = first + int(counted[1])
            if at > len(stream):
                break
            body = stream[first:at]
        else:
            line = stream.find(b"\n", at)
            line = len(stream) if line < 0 else line
            body, at = stream[at:line], line + 1
        text = body[:LONGEST_MESSAGE].decode("utf-8", "replace").strip()
        if text:
            out.append((text, max(0, len(body) - LONGEST_MESSAGE)))
    return out


def frames(stream: bytes) -> list[str]:
    return [text for text, _ in framed(stream)]


def syslog_streams(rows: DataFrame, column: str = "content") -> DataFrame:
    """Rows (value, cut) of the messages of recorded streams, a stream a row as spark.read.format("binaryFile") gives them;
    cut is the number of a message's bytes that are left out. Framing is sequential within a stream, so this is a vectorised function; null streams have no messages."""

    def split(batches):
        for batch in batches:
            for content in batch.column(0):
                found = framed(content.as_py())
                yield pa.RecordBatch.from_pydict({"value": pa.array([t for t, _ in found], pa.string()), "cut": pa.array([n for _, n in found], pa.int64())})

    return rows.select(column).where(F.col(column).isNotNull()).mapInArrow(split, "value string, cut long")


def ingested_before(files: DataFrame, batches: DataFrame) -> DataFrame:
    """Files (path, content) with their sha256 and the first batch that had the same content, null for new content:
    batches has batch_id, sha256. Contents are hashed at the scan and go no further."""
    hashed = files.select("path", F.sha2("content", 256).alias("sha256"))
    known = batches.groupBy("sha256").agg(F.min("batch_id").alias("batch_id"))
    return hashed.join(known, "sha256", "left")


def parse_mixed(rows: DataFrame) -> DataFrame:
    """Events of rows (format, value): each format in use is parsed by its own parser."""
    formats = [r[0] for r in rows.select("format").distinct().collect()]  # a closed vocabulary
    parts = [PARSERS[f](rows.where(F.col("format") == f).select("value")) for f in sorted(formats) if f in PARSERS]
    if not parts:
        return PARSERS["generic_syslog"](rows.select("value").limit(0))
    return reduce(DataFrame.unionByName, parts)


def guarded(value: Column) -> Column:
    """Text that a spreadsheet would read as a formula, with a quote in front."""
    return F.when(value.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), value)).otherwise(value)


def export_csv(rows: DataFrame, path: str) -> None:
    flat = [F.to_json(F.col(f"`{c}`")).alias(c) if kind.startswith(("array", "map", "struct")) else F.col(f"`{c}`") for c, kind in rows.dtypes]
    text = rows.select(*flat)
    text.select(*[guarded(F.col(f"`{c}`")).alias(c) if k == "string" else F.col(f"`{c}`") for c, k in text.dtypes]).write.mode("overwrite").csv(path, header=True)
