"""The live path: files to the store under Structured Streaming, with the transforms of the batch path.

A micro-batch is parsed, run through ingest.chain() and appended to the month-partitioned store; de-duplication holds
within the watermark in the stream and against the store's recent months in the sink. A failed batch is
replayed from the checkpoint, not discarded.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logweave.operators import analytics, ingest
from logweave.operators.correlate import Correlation
from logweave.operators.correlate import stream as correlation_stream
from logweave.scratch import scope, written
from logweave.sources.transports import parse_mixed


def read_lines(spark: SparkSession, path: str, *, files_per_batch: int = 100) -> DataFrame:
    """New text files of a folder, a line a row; the number of files bounds a batch, nothing is dropped."""
    return spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(path)


def read_events(spark: SparkSession, path: str, schema, *, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once within the watermark."""
    return (
        events.withColumn("dedup_hash", ingest.identity_hash())
        .withWatermark("event_time", late)
        .dropDuplicatesWithinWatermark(["dedup_hash"])
    )


#: Stands for a batch's time where no event needs it.
EPOCH = dt.datetime(1970, 1, 1)


def batch_time(spark: SparkSession, path: str) -> dt.datetime:
    """When a batch was first seen, for events without a time. It is stored beside the checkpoint before it is used, so
    that a batch that is replayed gets the same time and its events the same identity."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
        now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        spark.createDataFrame([(now.isoformat(),)], "value string").write.mode("overwrite").text(path)
    return dt.datetime.fromisoformat(spark.read.text(path).first()[0])


def store_batch(batch: DataFrame, store: str, now: dt.datetime, *, mappers=(), actions=(), models=None) -> tuple[DataFrame, dict[str, int]]:
    """Runs stored rows through the ingest order and appends what is new to the store: (the new events, the accounting).
    The events are computed once, by the job that stores them and counts on its way."""
    counted = ingest.Accounting()
    known = stored(batch.sparkSession, store)
    if known is not None:
        months = [r[0] for r in ingest.fallback_time(batch, now).select(F.date_format("event_time", "yyyy-MM")).distinct().collect()]
        known = known.where(F.col("event_month").isin(months))
    out = written(ingest.chain(batch, batch_time=now, mappers=mappers, actions=actions, models=models, store=known, counted=counted), "new-events")
    ingest.write_store(out, store)
    return out, counted.counts()


def to_store(
    events: DataFrame,
    store: str,
    checkpoint: str,
    *,
    mappers=(),
    actions=(),
    models=None,
    interval: str | None = None,
    after: Callable[[DataFrame, int], None] | None = None,
    account: Callable[[int, dict[str, int]], None] | None = None,
) -> StreamingQuery:
    """Starts the ingest of a stream of events. Without an interval it takes what is there and ends. after gets a batch's
    new events, account its counts."""

    def sink(batch: DataFrame, number: int) -> None:
        with scope():  # a batch's scratch tables go with it
            batch = written(batch, "parsed")
            now = EPOCH
            if batch.where("event_time is null").limit(1).count():
                now = batch_time(batch.sparkSession, f"{checkpoint.rstrip('/')}-times/{number}")
            out, counts = store_batch(batch, store, now, mappers=mappers, actions=actions, models=models)
            if after is not None:
                after(out, number)
            if account is not None:
                account(number, counts)

    writer = events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def dispatch(
    mixed: DataFrame, sinks: dict[str, Callable[[DataFrame, int], None]], checkpoint: str, *, interval: str | None = None
) -> StreamingQuery:
    """Starts a stream of rows (format, value) of many formats. A micro-batch is stored once, its formats (a closed
    vocabulary) fan out to their parsers, and each sink gets the batch's events and number. A sink that is done leaves a
    mark: when a later one fails and the batch is replayed, it is not called again."""

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        with scope():
            events = written(parse_mixed(written(batch, "mixed")), "mixed-events")
            for name, put in sinks.items():
                fs, mark = _path(spark, f"{checkpoint.rstrip('/')}-marks/{number}/{name}")
                if not fs.exists(mark):
                    put(events, number)
                    fs.create(mark, True).close()

    writer = mixed.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def stored(spark: SparkSession, store: str) -> DataFrame | None:
    """The store as a table, or None while it is empty."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.parquet(store)


def correlate_to(events: DataFrame, rule: Correlation, out: str, checkpoint: str, *, slide_s: int = 60, interval: str | None = None) -> StreamingQuery:
    """Windows of a rule, appended when the watermark has passed them."""
    found = correlation_stream(events, rule, slide_s)
    writer = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def baseline_update(batch: DataFrame, known: DataFrame | None) -> DataFrame:
    """Entity baselines after a batch: first and last sight, and counts of new rows only."""
    new = analytics.entities(batch)
    return new if known is None else analytics.merge_baseline(known, new, ["entity_type", "entity_value"], "event_count")
