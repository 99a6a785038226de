"""Scratch tables in the shared folder that the session names."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Vectored reads keep direct buffers as large as a column chunk for each thread that has ever read one; in runs of many
#: small tasks they outgrew the heap.
READ_OPTIONS = {"parquet.hadoop.vectored.io.enabled": "false"}
#: No marker of success: nothing reads it, and in a local folder the driver starts two child processes to set its
#: permissions, which share the driver's memory for a moment.
WRITE_OPTIONS = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}

_own_root: str | None = None
_written: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the session names in spark.checkpoint.dir. Where it is unset, a local session gets a temporary
    folder; on a cluster that is an error, since executors would not share it."""
    global _own_root
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_root is None:
        _own_root = tempfile.mkdtemp(prefix="logweave-")
    return f"file://{_own_root}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended: its files stay for whoever cleans the shared folder
        pass


def _remove_all(keep: int = 0) -> None:
    while len(_written) > keep:
        _remove(*_written.pop())


atexit.register(_remove_all)


@contextmanager
def scope() -> Iterator[None]:
    """Scratch tables written inside are removed at the end: for steps whose result has been stored elsewhere by then."""
    before = len(_written)
    try:
        yield
    finally:
        _remove_all(before)


def folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared scratch folder, removed at the end like scratch tables."""
    path = f"{scratch_root(spark)}/logweave/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The same rows, written as Parquet to the shared scratch folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/logweave/{name}-{uuid.uuid4().hex}"
    df.write.options(compression=compression, **WRITE_OPTIONS).parquet(path)
    _written.append((spark, path))
    return spark.read.options(**READ_OPTIONS).schema(df.schema).parquet(path)
